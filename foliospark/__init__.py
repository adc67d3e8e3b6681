"""Document-layout analytics on Spark: a corpus of PDF files as distributed tables."""

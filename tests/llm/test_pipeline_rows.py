"""Near duplicates go by row: repeated ids, repeated rows and null ids."""

import corpus_pipeline as C


def test_one_row_of_each_class_stays(spark):
    a, b, c = "one two three four five six seven", "ten red cats sat on nine mats", "some quite other words stand in here"
    d, e = "no id at all has this text here", "and this one is had by three rows"
    rows = [(1, a, "x"), (3, a, "x"), (3, b, "y"), (5, c, "z"), (5, c, "z"), (5, c, "z"), (7, b, "y"), (8, "", "e"), (8, "", "e"), (9, None, "n"), (None, a, "x"), (None, None, "n")]
    rows += [(None, d, "y"), (None, d, "x"), (None, d, "x"), (None, e, "x"), (11, e, "x"), (10, e, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = C.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    want = [(1, a, "x"), (3, b, "y"), (5, c, "z"), (8, "", "e"), (8, "", "e"), (9, None, "n"), (None, None, "n"), (None, d, "x"), (10, e, "x")]
    assert C.drop_near_duplicates(spark, docs.limit(0), "").count() == 0
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_clashing_names_go_along(spark):
    schema = "doc_id long, text string, row string, id int, hash int, class_set string, own_hash string, first string"
    rows = [(1, "a b c d e f", "r", 1, 2, "c", "o", "f"), (2, "a b c d e f", "r", 1, 2, "c", "o", "f"), (3, None, "r", 1, 2, "c", "o", "f")]
    out = C.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), "")
    assert out.schema == spark.createDataFrame(rows, schema).schema and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]

"""Query registry: named queries with their SQL oracles."""

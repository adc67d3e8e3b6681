"""Quarter turns of all rows, ties included: rounded half away from zero."""

from foliospark.plans.text_queries import QUERIES

TIES = {(0, 0): 0, (1, 1): 1, (2, 2): 1, (-1, 1): 2, (-2, 2): 2, (-1, -1): 2, (-2, -2): 2, (1, -1): 3, (2, -2): 3}


def test_every_row_has_a_turn(spark, tmp_path):
    pairs = [(p, s) for p in range(7) for s in range(5)]
    rows = [(k, 1, p, s) for k, (p, s) in enumerate(pairs)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {pairs[r["l_orderkey"]]: r["turn"] for r in QUERIES["orientation"](spark, str(tmp_path)).collect()}
    assert set(got) == set(pairs)
    assert {(a, b): got[a + 3, b + 2] for a, b in TIES} == TIES

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.llm import op01_quality as Q
from foliospark.llm import op07_urls as U
from foliospark.llm.registry import oracle_sql, queries

WHITE = " \t\n\v\f\r"


def words(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    w = words(text)
    seen, repeated = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            repeated |= {i + k for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(lines), sum(a == b for a, b in zip(w, w[1:])), len(repeated)


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcé#") for _ in range(rng.randint(1, 3)))
    out = [None, "", " \n\t ", "one", "\n".join(["same line here"] * 9), "a " * 500, "###", "x\xa0y", "one two three four five six seven eight", "word " * 50_000, "a b\x0bc\x0cd\re", "tab\tline\ntab\tline"]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(1, 60))]
        out.append(rng.choice([" ", "\n", " \t"]).join(base + base[: rng.randint(0, 60)] + [word()] * rng.randint(0, 20)))
    return out


def test_measures_equal_brute_force(spark):
    values = texts()
    df = spark.createDataFrame([(i if i != 4 else 3, t, "x", -1) for i, t in enumerate(values)], "doc_id long, text string, kept string, n_words int").coalesce(1)
    out = Q.quality_cascade(df.withColumn("_words", F.lit("stays")))
    rows = out.collect()
    assert len(rows) == len(values) and {r["_words"] for r in rows} == {"stays"}
    for r, every, t in zip(rows, Q.measure(df).collect(), values, strict=True):
        m = brute(t)
        assert tuple(every[c] for c in Q.MEASURES) == m
        assert all(r[c] == every[c] for c in Q.BASE_MEASURES)
        base = m[0] < 20 or 100 * m[6] > 30 * m[0]
        bad = base or 10 * m[2] > 2 * m[0] or m[1] > 20 * m[0] or m[1] < 2 * m[0] or 3 * m[5] > m[0] or (m[3] > 3 and 2 * m[3] > m[4])
        assert r["base_failed"] == base and r["kept"] == (not bad) and (r["failed_rule"] is None) == (not bad)
    assert Q.quality_cascade(df.limit(0)).count() == 0


def test_the_order_changes_the_cost_alone(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    order = Q.plan_cascade(df)
    assert sorted(order) == sorted(Q.RULES)
    told = lambda rules, given: {r["doc_id"]: r["failed_rule"] is None for r in Q.apply_cascade(df, rules, given=given).collect()}
    assert told(order, ()) == told(list(reversed(order)), ()) == told(order, Q.BASE_MEASURES)


def test_cheap_rules_that_reject_come_first(spark, monkeypatch):
    """With equal costs the rule that rejects most goes first, then the one that adds most."""
    rules = (Q.Rule("few", "n_words < 3"), Q.Rule("most", "n_words > 2"), Q.Rule("none", "n_words < 0"))
    df = spark.createDataFrame([(i, "a b c d" if i else "a") for i in range(9)], "doc_id long, text string")
    clock = iter(range(1000))
    monkeypatch.setattr(Q.time, "perf_counter", lambda: next(clock))
    assert [r.name for r in Q.plan_cascade(df, rules)] == ["most", "few", "none"]


def test_rejected_rows_are_not_measured(spark, monkeypatch):
    """A measure that fails wherever it is evaluated: only rows that reach its rule evaluate it."""
    monkeypatch.setitem(Q._SQL, "n_stutters", "CASE WHEN size(@words) < 3 THEN raise_error('measured') ELSE 0L END")
    df = spark.createDataFrame([(1, "a b"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    few, stutters = Q.Rule("few", "n_words < 3"), Q.Rule("stutters", "n_stutters > 1")
    got = Q.apply_cascade(df, [few, stutters]).orderBy("doc_id").collect()
    assert [r["failed_rule"] for r in got] == ["few", None, "few"]
    with pytest.raises(Exception, match="measured"):
        Q.apply_cascade(df, [stutters, few]).collect()


def test_the_sample_is_drawn_over_the_table(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    ids = [int(r["text"]) for r in Q._sample(df, "text", 200).collect()]
    assert 120 < len(ids) < 300 and min(ids) < 1000 and max(ids) > 19_000


def test_no_python_in_the_plan(spark):
    plan = Q.op1_quality(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


URLS = [
    (1, "http://a.example.net/en/x?q#f"), (2, "HTTPS://WWW.Example.NET/en/"), (3, "http://example.net/en"), (4, "x://example.com/de/1"), (5, "http://org/fr/"), (6, "http://a.org/fr"), (7, None), (8, "no scheme"),
    (9, "http://net"), (10, "http://net/"), (11, "http://x.net?y/"), (12, "http://notexample.com/de/"), (13, "://b.com#/de/"), (14, ""), (14, ""), (15, "http://a..net//"), (16, "http://x.example.com/de/" + "a/" * 500),
    (17, "http://" + "a." * 200_000 + "net/" + "/" * 500_000), (18, "http://x.example.com/d" + "e/" * 500_000), (19, "http://org/" + "x" * 500_000),
]


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    hits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(hits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("rules", [U.RULES, (), (("example.com", "/d", "block"), ("com", "/de/1", "allow"), ("x.example.com", "", "block"), ("example.com", "/de/a/a", "allow"), ("net", "", "block"), ("net", "", "allow"))])
def test_urls_equal_brute_force(spark, rules):
    df = spark.createDataFrame([(*u, "clash", "x") for u in URLS], "page_id long, url string, rule string, other string")
    table = spark.createDataFrame([*rules, *rules[:1], (None, "/", "block")], "host string, path string, verdict string")
    out = U.judge_urls(df, table)
    assert out.columns == ["page_id", "url", "other", "host", "path", "rule", "verdict"]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in out.collect())
    want = sorted((i, h, p, r or "", v) for i, (h, p, r, v) in ((i, judge(u, rules)) for i, u in URLS))
    assert got == want and U.judge_urls(df.limit(0), table).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    r = con.sql(oracle_sql()[name])
    df = queries()[name](spark, d).select(*r.columns)
    assert sorted(map(str, df.collect())) == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(r.columns, row, strict=True)) + ")" for row in r.fetchall())

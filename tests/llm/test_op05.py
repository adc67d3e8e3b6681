import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import op05_lm as M
from foliospark.llm import scratch
from foliospark.session import table


def split(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in low.split(" ") if w] + [None]


def brute(rows):
    """rows: (doc_id, text, held, deleted) -> per row (n_tokens, n_known, N, base); and the counts."""
    c, pairs = Counter(), Counter()
    for _, text, held, _ in rows:
        if not held:
            t = split(text or "")
            c.update(t)
            pairs.update(zip(["<s>", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    out = []
    for i, text, held, _ in rows:
        t = split(text or "")
        out.append((i, held, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)))
    return out, c, pairs


def check(got, rows):
    want, _, _ = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)


@pytest.mark.parametrize("block", [1 << 24, 400])
def test_base_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    texts = ["A b\tc a", "", None, "a  b", "Ünder Über\nüber", "z " * 500, "a b c", "a b c", "q"]
    rows = [(i if i != 7 else 6, t, i % 4 == 0, i % 4 == 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h boolean, d boolean, score int")
    got = M.lm_scores(df, F.col("h"), F.col("d")).collect()
    check([r[:6] for r in got], rows)
    assert all(r["score"] <= 1e-12 and math.isfinite(r["score"]) for r in got)
    assert M.lm_scores(df.limit(0), F.col("h"), F.col("d")).count() == 0
    none = M.lm_scores(df, F.lit(True), F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in none} == {(0, 0)}


@pytest.mark.parametrize("part", [1, 60, 300])
def test_parts_of_a_block_change_nothing(monkeypatch, part):
    """Asked keys and scores are those of the block in one part."""
    texts = ["a b c a", None, "", "x y " * 40, "a b", "c " * 100, "é a b c"] * 3
    n = len(texts)
    flags = [i % 3 != 0 for i in range(n)]
    docs = M.pa.table({"doc_id": list(range(n)), "text": M.pa.array(texts, M.pa.string()), "held_out": [not f for f in flags], "train": flags, "dev": [f and i % 2 == 0 for i, f in enumerate(flags)], "block": [3] * n})
    model = M.Model(700, 9, np.linspace(0, 0.9, M.BUCKETS), 0.8)

    def run():
        asked = M._ask(docs, 5)
        told = M.pa.concat_tables([M._answer(asked.slice(i, 1)) for i in range(5)])
        histogram = dict(zip(*(c.to_pylist() for c in M._histogram(docs, told, 50).columns), strict=True))
        return asked, histogram, M._scores(docs, told, model)

    want = run()
    monkeypatch.setattr(M, "BLOCK_BYTES", part)
    got = run()
    assert got[0].equals(want[0]) and got[1] == want[1] and got[2].combine_chunks().equals(want[2].combine_chunks())


def test_equal_rows_are_spread(spark, monkeypatch):
    """One row as a third of all is dealt to all blocks, and an input that shuffles is scored as its rows are."""
    monkeypatch.setattr(M, "BLOCK_BYTES", 2000)
    rows = [(1, "one and the same text here", False, False)] * 300 + [(i, f"text {i} a b", i % 2 == 0, i % 3 == 0) for i in range(2, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean, d boolean").repartition(5)
    got = M.lm_scores(df, F.col("h"), F.col("d")).collect()
    check([r[:6] for r in got], rows)
    scratch.release(spark)


def test_a_plan_that_shuffles_is_stored_first(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents").where("doc_id > 3").select("doc_id", F.upper("text").alias("text"))
    assert scratch.settled(d, "x") is d
    for other in (d.repartition(3), d.distinct(), d.orderBy("doc_id"), d.union(d)):
        assert scratch.settled(other, "x") is not other
    assert scratch.results() >= 4
    scratch.release(spark)
    assert scratch.results() == 0


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 10
    rows = [(r[0], r[1], r[2] == 0, r[2] == 1) for r in docs.select("doc_id", "text", fold).collect()]
    got = M.op5_lm(spark, d)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    check([r[:6] for r in got], rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_pair_counts_reach_the_score(spark):
    """With the weights known, a text's score is the sum that brute force gives."""
    rows = [(1, "a b a b c", False, False), (2, "a b", True, False), (3, "c c a", False, True)]
    _, c, pairs = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean, d boolean")
    seen = {}
    fit = M.fit_weights

    def kept(cells, n, distinct):
        seen["w"] = fit(cells, n, distinct)
        assert n.sum() == 4
        return seen["w"]

    M.fit_weights = kept
    try:
        got = {r["doc_id"]: r["score"] for r in M.lm_scores(df, F.col("h"), F.col("d")).collect()}
    finally:
        M.fit_weights = fit
    a, e = seen["w"]
    n, v = sum(c.values()), len(c)
    starts = 2
    for i, text, _, _ in rows:
        t, s = split(text), 0.0
        for x, w in zip(["<s>", *t], t, strict=False):
            context = starts if x == "<s>" else c[x]
            k = math.frexp(context)[1] if context else 0
            s += math.log10(a[k] * (pairs[x, w] / context if context else 0) + (1 - a[k]) * (e * c[w] / n + (1 - e) / (v + 1)))
        assert got[i] == pytest.approx(s, abs=1e-9)


def test_em_finds_the_mixture():
    """Tokens of which three in four come from the pair estimate."""
    cell = lambda bucket, pair, word: (bucket * M.LEVELS + pair) * M.LEVELS + word
    a, _ = M.fit_weights(np.array([cell(3, 1, 0), cell(3, 0, 3)]), np.array([75.0, 25.0]), 1000)
    assert a[3] == pytest.approx(0.75, abs=0.02)


def test_counts_are_packed_without_loss():
    for x in ([], [0, 1, 254], [255, 3, 256, 1 << 40, 0]):
        x = np.array(x, np.int64)
        assert (M._unpack(M._pack(x), len(x)) == x).all()

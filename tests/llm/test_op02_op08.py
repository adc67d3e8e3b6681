import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import op02_language as L
from foliospark.llm import op08_toxicity as X
from foliospark.llm import textkit
from foliospark.llm.textkit import Texts, word_hash, words
from foliospark.session import table

D = "/root/testdata/sf0.01"


def texts(*values):
    data = [v.encode() for v in values]
    return Texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_words_are_runs_between_ascii_blanks():
    values = ["", " ", "a b", "é x\ty\n", "x", "  End", "Long " * 100]
    w = words(texts(*values))
    assert list(w.counts) == [0, 0, 2, 2, 1, 1, 100]
    assert int(w.hashes[0]) == word_hash("A") and int(w.hashes[3]) == word_hash("y")
    assert w.hashes[2] == word_hash("é x")


def test_words_do_not_depend_on_the_chunk(monkeypatch):
    values = ["ab  cd é", "", "x" * 50, " y ", "a b" * 30, "zz"]
    want = words(texts(*values))
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(textkit, "CHUNK", size)
        for a, b in zip(words(texts(*values)), want, strict=True):
            assert (a == b).all()


def test_held_out_languages(spark):
    got = L.op2_language(spark, D)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    want = table(spark, D, "documents").select("doc_id", "lang")
    rows = got.join(want, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert got.count() == want.count()


def test_language_edge_cases(spark):
    docs = table(spark, D, "documents")
    net = L.train_language(docs.select("doc_id", "text", "lang"), F.lit(True), rows=60)
    rows = [(1, None, "fr", "x"), (2, "", None, "x"), (3, "12 34 !!", "fr", "x"), (4, "the and of that with " * 5000, "fr", "x"), (4, "the and of that with", "fr", "x"), (5, "Ж", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = L.identify_language(df, net)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    told = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert told[:3] == [(1, "und"), (2, "und"), (3, "und")] and told[3:5] == [(4, "en"), (4, "en")] and told[5][1] != "und"
    assert L.identify_language(df.limit(0), net).count() == 0
    none = L.train_language(docs.limit(0).select("doc_id", "text", "lang"), F.lit(True))
    assert {r["lang_pred"] for r in L.identify_language(df, none).collect()} == {"und"}


def test_prediction_equals_a_plain_forward_pass(spark):
    """Window by window, position by position, filter by filter, in plain loops."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    net = L.train_language(docs.select("doc_id", "text", "lang"), F.lit(True), rows=30)
    values = [r["text"] for r in docs.limit(8).collect()] + ["é" * 300, "a", "Ж1" * 200, "x " * 128]
    names, scores = L.predict(net, texts(*values))
    for value, name, score in zip(values, names, scores, strict=True):
        data, total = value.encode(), np.zeros(len(net.languages))
        for at in range(0, len(data), L.WINDOW):
            part = data[at : at + L.WINDOW]
            x = [net.embed[b].astype(float) for b in part.ljust(L.WINDOW, b"\0")]
            hidden = []
            for k in range(len(L.WIDTHS) * L.FILTERS):
                width = L.WIDTHS[k // L.FILTERS]
                weights = net.filters[: width * L.DIMS, k].astype(float)
                best = max(float(np.concatenate(x[i : i + width]) @ weights) for i in range(L.WINDOW - max(L.WIDTHS) + 1))
                hidden.append(max(best + float(net.shift[k]), 0.0))
            out = np.array(hidden) @ net.dense + net.bias
            total += len(part) * (out - out.max() - np.log(np.exp(out - out.max()).sum()))
        p = np.exp(total / len(data) - (total / len(data)).max())
        p /= p.sum()
        assert name == net.languages[int(p.argmax())] and abs(score - p.max()) < 1e-3


def test_no_language_is_left_out(spark, monkeypatch):
    """More languages than rows allow for: each is learned, from fewer rows; a copied row counts once."""
    monkeypatch.setattr(L, "TRAIN_ROWS", 400)
    rows = [(k * 10 + i, f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} " * 12 + str(i), f"l{k:03}") for k in range(250) for i in range(3)]
    rows += [(1, "copied text " * 5, "l001")] * 500
    seen = []
    monkeypatch.setattr(L, "fit", lambda x, labels: seen.append(labels) or L.Network(sorted(set(labels)), *[None] * 5))
    net = L.train_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(True))
    assert net.languages == [f"l{k:03}" for k in range(250)] and len(seen[0]) == 250


def test_toxicity_on_held_out_rows(spark):
    got = X.op8_toxicity(spark, D)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == table(spark, D, "documents").count()
    rows = got.join(table(spark, D, "labels"), "doc_id").where("held_out").collect()
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert np.mean(clean) < 0.03 and np.mean(toxic) > 0.5
    assert all((r["score"] >= 0.7) == (r["predicted"] == 1) for r in rows)


def test_factorization_learns_a_pair():
    """Neither term alone is toxic; both together are."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.4
        noise = rng.integers(1000, 1 << 18, 5).tolist()
        rows.append(np.unique([*([7] if a else []), *([9] if b else []), *noise]).astype(np.uint64))
        labels.append(int(a and b))
    m = X.fit(rows, np.array(labels))
    at = m.slot[[7, 9]]
    linear, pair = m.weight[at], float(m.factor[at[0]] @ m.factor[at[1]])
    p = [1 / (1 + np.exp(-(m.bias + x))) for x in (linear[0], linear[1], linear.sum() + pair)]
    assert p[0] < 0.5 and p[1] < 0.5 and p[2] > 0.7


@pytest.mark.parametrize("noise,vocabulary", [(5, 200_000), (20, 300), (100, 2000)])
def test_a_pair_of_neutral_terms_is_learned(noise, vocabulary):
    """label = a xor b: neither term tells anything alone. Held-out rows are scored right."""
    rng = np.random.default_rng(0)
    values, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        extra = [f"w{k}" for k in rng.integers(0, vocabulary, noise)]
        values.append(" ".join(["alpha"] * int(a) + ["beta"] * int(b) + extra))
        labels.append(int(a ^ b))
    found, first = X.buckets(texts(*values))
    rows = [found[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    m = X.fit(rows[:2000], np.array(labels[:2000]))
    told = X.predict(m, texts(*values[2000:])) >= 0.5
    assert np.mean(told == np.array(labels[2000:], bool)) > 0.99


def test_scores_equal_a_plain_machine(spark):
    """Bias, weights and all pairs of factors, summed pair by pair."""
    m = X.machine_for(table(spark, D, "documents"), spark, D)
    values = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").limit(60).collect()] + [None, "", "idiot", "idiot loser trash stupid"]
    got = X.predict(m, texts(*(v or "" for v in values)))
    for value, score in zip(values, got, strict=True):
        terms = re.findall("(?:[A-Za-z0-9]|[^\x00-\x7f])+", value or "")
        own = set()
        for t in terms:
            b = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).encode()
            own |= {int(X.buckets(texts(t))[0][i]) for i in range(len(X.buckets(texts(t))[0]))} if len(b) > X.STEM else {word_hash(t) >> (64 - X.HASH_BITS)}
        slots = [m.slot[k] for k in own if m.slot[k] >= 0]
        total = m.bias + sum(m.weight[k] for k in slots)
        total += sum(float(m.factor[a] @ m.factor[b]) for i, a in enumerate(slots) for b in slots[i + 1 :])
        assert abs(score - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-6


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None)], [(1, 0), (1, 1), (2, 1)]])
def test_toxicity_edge_cases(spark, labels):
    rows = [(1, None, "c"), (2, "", "c"), (2, "", "c"), (3, "word " * 100_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    m = X.train_toxicity(df, spark.createDataFrame(labels, "doc_id long, label int"), F.lit(True))
    out = X.score_toxicity(df, m)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = out.collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got) and got[1] == got[2]
    assert X.score_toxicity(df.limit(0), m).count() == 0

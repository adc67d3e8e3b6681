import random
import re
from collections import Counter
from math import log

import numpy as np
import pytest

from foliospark.llm import op06_decontaminate as Q
from foliospark.session import table

TERM = re.compile("(?:[A-Za-z0-9]|[^\x00-\x7f])+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items):
    """(doc row, item_id) of all leaks, from the definitions alone."""
    tok = [(i, t, terms(t)) for i, t in items if t is not None and terms(t)]
    n, mean = len(tok), sum(len(t) for _, _, t in tok) / max(len(tok), 1)
    df = Counter(x for _, _, t in tok for x in set(t))
    idf = {x: log(1 + (n - c + 0.5) / (c + 0.5)) for x, c in df.items()}
    weight = []
    for _, _, t in tok:
        w = {x: idf[x] * c * (Q.K1 + 1) / (c + Q.K1 * (1 - Q.B + Q.B * len(t) / mean)) for x, c in Counter(t).items()}
        weight.append({x: v / sum(w.values()) for x, v in w.items()})
    out = set()
    for d, (_, text) in enumerate(docs):
        t = terms(text)
        for (item, raw, own), w in zip(tok, weight, strict=True):
            if sum(v for x, v in w.items() if x in set(t)) < Q.SCORE - 1e-9:
                continue  # then no window has it either
            mark = raw.rfind("?")
            k = len(terms(raw[:mark])) if mark >= 0 else 0
            if not 0 < k < len(own):
                k = max(1, len(own) * 3 // 4) if len(own) > 1 else 1
            size, width = min(Q.RUN, k), 2 * len(own)
            runs = lambda x: {tuple(x[i : i + size]) for i in range(len(x) - size + 1)}  # noqa: E731, B023
            q, a = runs(own[:k]), set(own[k:])
            for s in range(max(len(t) - width, 0) + 1):
                p = t[s : s + width]
                have = set(p)
                if sum(v for x, v in w.items() if x in have) >= Q.SCORE - 1e-9 and len(q & runs(p)) >= Q.OVERLAP * len(q) and len(a & have) >= Q.OVERLAP * len(a):
                    out.add((d, item))
                    break
    return out


def made():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(2, 40))) for i in range(50)]
    items += [(50, "What is it? " + text(6)), (51, "one"), (52, ""), (53, None), (54, items[0][1]), (55, "Ünder? x")]
    docs = [(None, None), (1, ""), (2, "one"), (2, "one"), (3, "... ünder: X !")]
    for i in range(60):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            t = terms(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(t) // 4)):
                t[rng.randrange(len(t))] = word()
            parts += [", ".join(t).upper(), text(rng.randint(0, 80))]
        docs.append((10 + i, "\n".join(parts)))
    return docs, items


@pytest.mark.parametrize("shard", [1 << 20, 600])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(Q, "SHARD_BYTES", shard)
    docs, items = made()
    df = spark.createDataFrame([(*d, "clash", k) for k, d in enumerate(docs)], "doc_id long, text string, leaks string, item_id int")
    out = Q.find_leaks(df, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string"))
    assert out.columns == ["doc_id", "text", "item_id", "leaks"]
    rows = out.collect()
    assert len(rows) == len(docs)
    got = {(r["item_id"], x["item_id"]) for r in rows for x in r["leaks"]}
    want = brute(docs, items)
    assert got == want
    assert len(want) > 30


def test_other_items_lengths_change_nothing(spark):
    """Halves of items far apart are no leak, whole items are, with or without a very long item beside them."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(i, text(20)) for i in range(50)]
    far = [(i, " ".join([text(50), *t.split(" ")[:10], text(2400), *t.split(" ")[10:], text(50)])) for i, t in items]
    near = [(100 + i, text(3000) + " " + t + " " + text(3000)) for i, t in items]
    docs = spark.createDataFrame(far + near, "doc_id long, text string")
    for more in ([], [(99, text(4000))]):
        got = Q.find_leaks(docs, spark.createDataFrame(items + more, "item_id long, text string")).collect()
        assert {(r["doc_id"], x["item_id"]) for r in got for x in r["leaks"]} == {(100 + i, i) for i, _ in items}


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    docs, items = made()
    texts = [t for _, t in docs if t] + [" ".join(t for _, t in docs if t), "x" * 5000]
    names, own = zip(*((i, t) for i, t in items if t), strict=True)
    as_one = lambda v: Q.Texts(np.frombuffer("".join(v).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in v)]))
    indexes = Q.build_index(list(names), as_one(own), Q.statistics_of(as_one(own)))
    assert len(indexes) > 1
    want = [Q.search(indexes, as_one([t])) for t in texts]
    for cells, piece in ((1, 1 << 20), (1 << 21, 300), (64, 50)):
        monkeypatch.setattr(Q, "CELLS", max(cells, 8))
        monkeypatch.setattr(Q, "PIECE", piece)
        for t, w in zip(texts, want, strict=True):
            assert [x[:2] for x in Q.search(indexes, as_one([t]))] == [x[:2] for x in w]
            assert np.allclose([x[2:] for x in Q.search(indexes, as_one([t]))], [x[2:] for x in w])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert Q.find_leaks(docs.limit(0), items).count() == 0
    assert Q.find_leaks(docs, items.limit(0)).collect()[0]["leaks"] == []
    assert len(Q.find_leaks(docs, items).collect()[0]["leaks"]) == 1


def test_whole_table_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, d, "benchmark").select("item_id", "text").collect()]
    want = {}
    for k, i in brute(docs, items):
        want.setdefault(docs[k][0], []).append(i)
    got = {r["doc_id"]: r["items"] for r in Q.op6_decontaminate(spark, d).collect()}
    assert got == {k: ",".join(map(str, sorted(v))) for k, v in want.items()}
    planted = {k for k, t in docs for _, i in items if i in t}
    assert planted <= set(got) and np.mean([k in planted for k in got]) > 0.5

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from foliospark.llm import op04_token_output as O
from foliospark.llm import op09_packing as P
from foliospark.llm import tokens
from foliospark.session import table

D = "/root/testdata/sf0.001"
HARD = [
    None, "", " \n ", "Plain text, don't split's. ＡＢＣ ﬁ", "é ́x nbsp here wide", "a<|endoftext|>b <|startoftext|> c", "ΣΑΣ İstanbul ß",
    "x" * 30_000, "word " * 9_000, "数字 123456 🎉🎉 ..--..", "dup dup", "dup dup",
]


@pytest.fixture(scope="module")
def direct():
    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(direct, text):
    return [*direct.encode(text or "", add_special_tokens=False).ids, 2]


def hard(spark):
    return spark.createDataFrame([(i if i < 11 else 10, t, -1, "x") for i, t in enumerate(HARD)], "doc_id long, text string, start int, ids string")


def test_words_encode_as_whole_texts_do(direct):
    from foliospark.llm.textkit import as_texts
    import pyarrow as pa

    enc = tokens.Encoder(tokens.vocabulary_path())
    for _ in range(2):
        ids, first = enc.encode(as_texts(pa.array(HARD, pa.string())))
        for i, t in enumerate(HARD):
            assert ids[first[i] : first[i + 1]].tolist() == ids_of(direct, t)


def test_kept_words_are_bounded(direct, monkeypatch):
    from foliospark.llm.textkit import as_texts
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KEPT_WORDS", 4)
    enc = tokens.Encoder(tokens.vocabulary_path())
    for t in ("a b c", "d e f", "a b c d e f g h", "b"):
        ids, _ = enc.encode(as_texts(pa.array([t])))
        assert ids.tolist() == ids_of(direct, t)
    assert len(enc.keys) <= 8


def test_amount_tree():
    rng = np.random.default_rng(0)
    tree, have = O.AmountTree(100), []
    for _ in range(2000):
        a = int(rng.integers(0, 101))
        if a in have and rng.random() < 0.5:
            have.remove(a)
            tree.add(a, -1)
        else:
            have.append(a)
            tree.add(a)
        q = int(rng.integers(0, 101))
        assert tree.least_from(q) == min((x for x in have if x >= q), default=-1)
        assert tree.most_upto(q) == max((x for x in have if x <= q), default=-1)


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 51, 300)
    rows = O.best_fit(sizes, 50)
    assert sorted(i for r in rows for i in r) == list(range(300))
    room: list[int] = []
    for s in sorted(sizes.tolist(), reverse=True):
        fits = [r for r in room if r >= s]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - s)
        else:
            room.append(50 - s)
    assert sorted(room) == sorted(50 - int(sizes[r].sum()) for r in rows)


@pytest.mark.parametrize("source", ["hard", "table"])
def test_packed_rows_round_trip(spark, direct, source, tmp_path):
    docs = hard(spark) if source == "hard" else table(spark, D, "documents")
    packed = O.pack_documents(docs)
    O.write_packed(packed, str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    back = defaultdict(dict)
    for r in O.unpack(rows).collect():
        back[r["doc_id"]].setdefault(r["start"], []).append(r["ids"])
    for d in docs.collect():
        want, at = ids_of(direct, d["text"]), 0
        while at < len(want):
            piece = back[d["doc_id"]][at][0]
            assert piece == want[at : at + len(piece)] and len(piece) <= O.CAPACITY
            at += len(piece)
    for r in rows.collect():
        ends, place = r["cumulative"], np.frombuffer(r["positions"], "<i4")
        assert len(r["ids"]) == 4 * O.CAPACITY and ends[-1] == r["n_tokens"]
        assert place[: ends[-1]].tolist() == [i for a, b in zip(ends, ends[1:]) for i in range(b - a)]
    assert O.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("source", ["hard", "table"])
def test_pieces_cover_every_id_once(spark, direct, source):
    docs = hard(spark) if source == "hard" else table(spark, D, "documents")
    rows = P.pack_hierarchical(docs).collect() if source == "hard" else P.op9_packing(spark, D).collect()
    want = defaultdict(list)
    for d in docs.collect():
        want[d["doc_id"]].append(ids_of(direct, d["text"]))
    found, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(found) == set(want)
    for k, pieces in found.items():
        ids, n = want[k][0], len(want[k])
        assert sum(p["length"] for p in pieces) == n * len(ids)
        if n == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
                at += p["length"]
    used = padded = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        used += at
        padded += at if at & (at - 1) == 0 else 4096
    if source == "table":
        assert padded < 1.05 * used
    assert P.pack_hierarchical(docs.limit(0)).count() == 0


def test_tiers_and_steps():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 9000, 400).tolist()
    windows = P.pack_tiers(lengths)
    sizes = [sum(p[2] for p in w) for w in windows]
    assert sum(sizes) == sum(lengths) and sum(s not in P.TIERS for s in sizes) <= 1
    steps = P.balance(sizes)
    load = np.bincount(steps, weights=sizes)
    assert load.max() - load.min() <= 4096

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import op03_jaccard as J
from foliospark.llm import scratch
from foliospark.llm.components import connected_components
from foliospark.session import table


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """rows: (doc_id, text) -> per row (doc_id, class_id, n_links, n_copies)"""
    sets = [shingle_set(t) for _, t in rows]
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    links = [0] * len(rows)
    copies = [0] * len(rows)
    for i, s in enumerate(sets):
        seen = defaultdict(int)
        for x in s:
            for j in index[x]:
                seen[j] += 1
        for j, n in seen.items():
            if j != i and n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                copies[i] += sets[j] == s
                label[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return sorted((rows[i][0], min(groups[root(i)]), links[i], copies[i] + 1) for i in range(len(rows)))


def as_rows(df):
    assert df.columns == ["doc_id", "class_id", "n_links", "n_copies"]
    return sorted(map(tuple, df.collect()))


def made(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = [None, "", "  \n", "a b c", "A  b\nc", "a b c d", "one two three four five"]
    base = [word() for _ in range(200)]
    for k in range(60):  # one large group of near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(200)] = word()
        texts.append(" ".join(w))
    for _ in range(30):  # pairs around the threshold
        w = [word() for _ in range(120)]
        v = list(w)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            v[at] = word()
        texts += [" ".join(w), " ".join(v), " ".join(w).upper()]
    texts += [" ".join(word() for _ in range(30_000))] * 2
    return [(10 * i + 3, t) for i, t in enumerate(texts)] + [(3, texts[0]), (13, texts[10])]


@pytest.mark.parametrize("node", [512, 16])
def test_equals_brute_force(spark, monkeypatch, node):
    monkeypatch.setattr(J, "NODE", node)
    monkeypatch.setattr(J, "VERIFY_SETS", node)
    rows = made()
    got = as_rows(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute(rows)
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert len(wrong) <= 0.02 * len(want), wrong[:5]  # the forest's recall is RECALL at least


def test_recall_on_a_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, d, "documents").collect()]
    got, want = as_rows(J.op3_jaccard(spark, d)), brute(rows)
    assert sum(r[2] for r in got) >= 0.99 * sum(r[2] for r in want)
    assert sum(r[2] for r in got) <= sum(r[2] for r in want)
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.99


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, None), (8, "x")], "doc_id long, text string")
    got = sorted(map(tuple, J.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7, 1, 2), (7, 7, 1, 2), (None, None, 0, 1), (8, 8, 0, 1)], key=str)
    assert J.near_duplicates(df.limit(0)).count() == 0
    long = " ".join(map(str, range(80)))
    df = spark.createDataFrame([(None, long), (None, long + " x"), (1, "y " + long), (2, "other words altogether here now")], "doc_id long, text string")
    assert sorted((r["n_links"], r["class_id"]) for r in J.near_duplicates(df).collect()) == [(0, 2), (2, 1), (2, 1), (2, 1)]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (101, 100)]
    with scratch.Workspace(spark) as kept:
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), kept).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
        some = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), kept, rounds=1).collect()}
        assert set(some) == set(got) and all(got[some[k]] == got[k] and some[k] <= k for k in got)
        assert connected_components(spark.createDataFrame([], "a long, b long"), kept).count() == 0


def test_the_shallowest_depth_is_the_longest_that_reaches_the_recall():
    d = J.shallowest()
    assert J.chance(J.THRESHOLD, d) >= J.RECALL and (d == J.DEPTH or J.chance(J.THRESHOLD, d + 1) < J.RECALL)


def test_both_ways_of_counting_agreement_agree():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2, (220, J._ALL)).astype(np.uint16)
    assert (J.agreement(a, a) == np.vstack([[J.agreement(a[i : i + 1], a[j : j + 1])[0, 0] for j in range(220)] for i in range(220)])).all()


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_deepest_matched_prefix(rows):
    """By all pairs; the first and the last label may have any neighbour beyond."""
    rng = np.random.default_rng(3)
    labels = np.sort(rng.integers(0, 3, (400, J.DEPTH)).astype(">u2").view(f"S{2 * J.DEPTH}").ravel())
    tree = np.sort(rng.integers(0, 2, 400))
    raw = [x.ljust(2 * J.DEPTH, b"\0") for k in (0, 1) for x in labels[tree == k].tolist()]
    t = pa.table({"tree": pa.array(tree, pa.int32()), "label": pa.array(raw, pa.binary()), "set_id": pa.array(range(400), pa.int64())})
    got = {r["set_id"]: r["deep"] for b in J._matched(iter(t.to_batches(max_chunksize=rows)), 3) for r in b.to_pylist()}
    x = np.frombuffer(b"".join(raw), ">u2").reshape(-1, J.DEPTH)
    for i in range(400):
        same = np.logical_and.accumulate(x == x[i], 1).sum(1) * (tree == tree[i])
        same[i] = 0
        want = J.DEPTH if i in (0, 399) else int(same.max())
        assert got.get(i, 0) == (want if want >= 3 else 0)


def test_ties_connect_a_label_and_have_no_hub():
    rng = np.random.default_rng(5)
    ids = rng.permutation(5000).astype(np.int64)
    label = np.where(ids < 4000, 0, ids // 3)
    tie = J.tied(ids, label)
    to = J.joined(5000, ids, np.arange(5000), np.argsort(ids)[tie])
    groups = {}
    for v, k in zip(to.tolist(), label.tolist(), strict=True):
        groups.setdefault(k, set()).add(v)
    assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)
    assert np.bincount(tie).max() <= 200
    some = ids % 2 == 0
    assert np.mean(J.tied(ids[some], label[some]) == tie[some]) > 0.4  # the same sets are tied alike in other company


def test_prefixes_are_shortened_until_the_recall(spark, monkeypatch):
    """A set that has close neighbours is done at the first depth; one without goes on to the last."""
    asked = []
    real = J._asked_at

    def noted(forest, known, depth, last):
        out = real(forest, known, depth, last)
        asked.append((depth, {r["set_id"] for r in out.where("NOT done").select("set_id").collect()}))
        return out

    monkeypatch.setattr(J, "_asked_at", noted)
    monkeypatch.setattr(J, "SHORTEN", 1)
    rows = made()
    got = as_rows(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [d for d, _ in asked] == [8, 7, 6, 5]
    assert len(asked[0][1]) > 60 > len(asked[-1][1]) > 0
    assert sum(a != b for a, b in zip(got, brute(rows), strict=True)) <= 0.02 * len(got)


def test_only_the_result_stays_stored(spark, tmp_path):
    folder = Path(scratch.scratch_dir(spark).removeprefix("file://")) / "foliospark"
    scratch.release(spark)
    before = set(folder.iterdir()) if folder.exists() else set()
    J.near_duplicates(spark.createDataFrame(made()[:40], "doc_id long, text string")).count()
    assert len(set(folder.iterdir()) - before) == 1
    scratch.release(spark)
    assert set(folder.iterdir()) == before


def test_a_stored_file_is_one_file_and_damage_to_it_is_noticed(spark):
    """No files of checksums and no mark beside it, since each file made costs a child process of the JVM."""
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "id * id AS square")
    out, path = scratch.stored(df, "test", 1000, narrow=True)
    folder = Path(path.removeprefix("file://"))
    names = [p.name for p in folder.iterdir()]
    assert len(names) == 1 and names[0].endswith(".parquet")
    assert sorted(map(tuple, out.collect())) == [(i, i * i) for i in range(1000)]
    raw = bytearray((folder / names[0]).read_bytes())
    raw[100] ^= 1
    (folder / names[0]).write_bytes(raw)
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        out.collect()
    scratch.dropped(spark, path)
    assert not folder.exists()

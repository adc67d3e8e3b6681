"""Benchmark decontamination: a BM25 inverted index of the test items, searched by every passage
of every training text with block-max pruning (WAND), then a check that question and answer
both overlap.

What a leak is. An item of n terms is looked for in every window of WINDOW * n terms in a row (a
shorter text is one window). A window leaks the item if it scores SCORE or more on it and has
OVERLAP or more of the question's distinct runs of RUN terms and of the answer's distinct terms. An
item's question is its text up to the last question mark that has an answer behind it, else its
first three quarters of terms; the answer is the rest. Terms are runs of letters, digits and
non-ASCII bytes, A-Z lower-cased. So whether an item leaks depends on its own length and on the
term statistics, never on how long other items are.

Index. Items are the documents of BM25, passages the queries. The weight of a term in an item is
its BM25 weight divided by the item's whole weight, so a passage that has all of an item's terms
scores 1 on it, and all items share one threshold. Items of similar length are indexed together
(classes, each with windows up to STEP times as long as the class before) in blocks of BLOCK. A class
holds for each term its largest weight of all, its largest weight in each block that has it, and its postings.

Search, class by class. A text is cut into strides as long as the class's longest window; a passage is
two strides in a row, so it holds every window that begins in its first. Passages are pruned by
the sum of their terms' largest weights, then by the sums of each block's largest weights: a
passage of which every block stays below the threshold is skipped, as block-max WAND skips,
without changing what is found. What is left is scored exactly, and for every item at SCORE or
more all its windows in the passage are checked. All passages of a slice of texts are searched at
once by arrays, the blocks' sums for at most CELLS (stride, block) pairs at a time; nothing is capped.

Size. A text longer than PIECE bytes is searched in pieces that overlap by the longest window. The
index is broadcast in shards of at most SHARD_BYTES of item text (or one longer item), each a narrow
pass over the texts; term statistics are always those of all items. Nothing of the texts is shuffled.

Defined results: items without terms match nothing, and a null text has no passages. Rows of the item
table that are equal in id and text are one item; equal texts of other ids are all named. Repeated
rows of the texts are searched each for itself; extra columns stay (a column named ``leaks`` is
replaced), and empty tables give empty results. Of a leak's windows the largest score and overlaps are told.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.textkit import NOT_ALNUM, Texts, Words, as_texts, mix, slices, words
from foliospark.session import prepare, table

K1, B = 1.2, 0.75
SCORE, OVERLAP, RUN = 0.5, 0.5, 3
WINDOW, SHORTEST, STEP = 2, 16, 4
BLOCK = 4
SHARD_BYTES, PIECE, CELLS = 8 << 20, 4 << 20, 1 << 21
LEAK = "array<struct<item_id:{},score:double,question:double,answer:double>>"
#: Sums of weights that differ by less are equal.
_EQUAL = 1e-9


class Item(NamedTuple):
    """Terms with weights, distinct runs of the question (and terms in a run), terms of the answer."""

    window: int
    terms: np.ndarray
    weights: np.ndarray
    run: int
    question: np.ndarray
    answer: np.ndarray


class Index(NamedTuple):
    """The items of one class. terms: sorted hashes; most[term]; term i has the postings
    items[first[i]:first[i + 1]] with weights alike, and in blocks[block_first[i]:block_first[i + 1]]
    the largest weights block_most."""

    names: list
    stride: int
    terms: np.ndarray
    most: np.ndarray
    first: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_first: np.ndarray
    blocks: np.ndarray
    block_most: np.ndarray
    parts: list[Item]


class Statistics(NamedTuple):
    """Of all items: how many there are, their mean terms, and in how many each term occurs."""

    items: int
    mean: float
    terms: np.ndarray
    found: np.ndarray


def _runs(h: np.ndarray, n: int = RUN) -> np.ndarray:
    """Hashes of all runs of n terms, of the whole if it is shorter."""
    n = min(n, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(31) + h[k : len(h) - n + 1 + k])
    return out


def _question_terms(text: bytes, starts: np.ndarray) -> int:
    mark = text.rfind(b"?")
    n = int(np.searchsorted(starts, mark)) if mark >= 0 else 0
    if not 0 < n < len(starts):
        n = max(1, len(starts) * 3 // 4) if len(starts) > 1 else len(starts)
    return n


def statistics_of(texts: Texts) -> Statistics:
    w = words(texts, breaks=NOT_ALNUM)
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    terms, at = np.unique(w.hashes, return_inverse=True)
    pairs = np.unique(at.astype(np.int64) * max(len(w.counts), 1) + owner)
    n = w.counts[w.counts > 0]
    return Statistics(len(n), float(n.mean()) if len(n) else 1.0, terms, np.bincount(pairs // max(len(w.counts), 1), minlength=len(terms)))


def build_index(names: list, texts: Texts, of: Statistics) -> list[Index]:
    """One Index for each class that has items."""
    w = words(texts, breaks=NOT_ALNUM)
    by_class: dict[int, list[int]] = {}
    items: dict[int, Item] = {}
    for i in np.flatnonzero(w.counts).tolist():
        a, b = int(w.first[i]), int(w.first[i + 1])
        h, n = w.hashes[a:b], b - a
        terms, tf = np.unique(h, return_counts=True)
        found = of.found[np.searchsorted(of.terms, terms)]
        weight = np.log1p((of.items - found + 0.5) / (found + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / max(of.mean, 1e-9)))
        q = _question_terms(texts.text(i), w.starts[a:b] - texts.offsets[i])
        items[i] = Item(WINDOW * n, terms, weight / weight.sum(), min(RUN, q), np.unique(_runs(h[:q])), np.unique(h[q:]))
        stride = SHORTEST
        while stride < WINDOW * n:
            stride *= STEP
        by_class.setdefault(stride, []).append(i)
    up = lambda x: np.nextafter(x.astype(np.float32), np.float32(np.inf))  # noqa: E731  bounds stay bounds
    out = []
    for stride, own in sorted(by_class.items()):
        parts = [items[i] for i in own]
        owner = np.repeat(np.arange(len(own)), [len(p.terms) for p in parts])
        terms, at = np.unique(np.concatenate([p.terms for p in parts]), return_inverse=True)
        order = np.lexsort((owner, at))
        term, item, weight = at[order], owner[order], np.concatenate([p.weights for p in parts])[order]
        most = np.zeros(len(terms))
        np.maximum.at(most, term, weight)
        new = np.append(True, (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK))
        begin = np.flatnonzero(new)
        every = np.arange(len(terms) + 1)
        out.append(
            Index(
                [names[i] for i in own], stride, terms, up(most), np.searchsorted(term, every), item, weight,
                np.searchsorted(term[begin], every), item[begin] // BLOCK, up(np.maximum.reduceat(weight, begin)), parts,
            )
        )
    return out


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner], owner


def _ranges(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of each of ``of``, and which of them each belongs to."""
    return _spans(first[of], first[of + 1])


def _unskipped(index: Index, stride: np.ndarray, term: np.ndarray, live: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Those of the ``live`` passages of which some block may reach the threshold. ``stride`` and
    ``term``: the distinct terms of the strides, by stride."""
    n_blocks = -(-len(index.parts) // BLOCK)
    passages = np.flatnonzero(live)
    out = []
    step = max(1, CELLS // n_blocks // 2)
    for begin in range(0, len(passages), step):
        own = passages[begin : begin + step]
        ids = np.unique(np.concatenate([own, own[follows[own]] + 1]))
        low, high = np.searchsorted(stride, ids), np.searchsorted(stride, ids, "right")
        pick, row = _spans(low, high)
        bound = np.zeros(len(ids) * n_blocks, np.float32)
        for a in range(0, len(pick), CELLS // 8):
            at, owner = _ranges(index.block_first, term[pick[a : a + CELLS // 8]])
            bound += np.bincount(row[a : a + CELLS // 8][owner] * n_blocks + index.blocks[at], weights=index.block_most[at], minlength=len(bound)).astype(np.float32)
        bound = bound.reshape(len(ids), n_blocks)
        here = np.searchsorted(ids, own)
        total = bound[here] + np.where(follows[own][:, None], bound[np.minimum(here + 1, len(ids) - 1)], 0)
        out.append(own[(total >= SCORE - 1e-4).any(axis=1)])
    return np.concatenate([*out, np.zeros(0, np.int64)])


def _search(index: Index, w: Words) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(text, item of the class): the leaking windows' largest (score, question overlap, answer overlap)."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(w.hashes):
        return best
    at = np.minimum(np.searchsorted(index.terms, w.hashes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == w.hashes)
    counts = w.counts
    n_strides = np.maximum(1, -(-counts // index.stride))
    stride_first = np.concatenate([[0], np.cumsum(n_strides)])
    text_of = np.repeat(np.arange(len(n_strides)), n_strides)
    owner = np.repeat(np.arange(len(counts)), counts)[known]
    stride = stride_first[owner] + (known - w.first[owner]) // index.stride
    pairs = np.unique(stride * len(index.terms) + at[known])  # a term counts once in a stride
    stride, term = pairs // len(index.terms), pairs % len(index.terms)
    total = np.bincount(stride, weights=index.most[term], minlength=stride_first[-1])
    follows = np.append(text_of[1:] == text_of[:-1], False)  # the next stride is of the same text
    live = total + np.where(follows, np.append(total[1:], 0), 0) >= SCORE - 1e-4
    for p in _unskipped(index, stride, term, live, follows).tolist():
        low, high = np.searchsorted(stride, [p, p + 2 if follows[p] else p + 1])
        own = np.unique(term[low:high]) if follows[p] else term[low:high]
        post, _ = _ranges(index.first, own)
        items, of = np.unique(index.items[post], return_inverse=True)
        found = items[np.bincount(of, weights=index.weights[post], minlength=len(items)) >= SCORE - _EQUAL]
        if len(found):
            t = int(text_of[p])
            begin = int(w.first[t]) + (p - int(stride_first[t])) * index.stride
            passage = w.hashes[begin : min(begin + 2 * index.stride, int(w.first[t + 1]))]
            for item in found.tolist():
                told = best_window(index.parts[item], passage)
                if told:
                    best[t, item] = tuple(map(max, best.get((t, item), told), told))
    return best


def best_window(item: Item, passage: np.ndarray) -> tuple[float, float, float] | None:
    """The largest values of the leaking windows of a passage, or None."""
    n = max(len(passage) - item.window, 0) + 1
    score = _covered(passage, item.terms, item.weights, 1, item.window, n)
    runs = _runs(passage, item.run) if len(passage) >= item.run else passage[:0]
    question = _covered(runs, item.question, np.full(len(item.question), 1 / max(len(item.question), 1)), item.run, item.window, n)
    answer = _covered(passage, item.answer, np.full(len(item.answer), 1 / max(len(item.answer), 1)), 1, item.window, n) if len(item.answer) else np.ones(n)
    leaks = np.flatnonzero((score >= SCORE - _EQUAL) & (question >= OVERLAP - _EQUAL) & (answer >= OVERLAP - _EQUAL))
    return tuple(float(x[leaks].max()) for x in (score, question, answer)) if len(leaks) else None


def _covered(found: np.ndarray, keys: np.ndarray, weights: np.ndarray, size: int, window: int, n: int) -> np.ndarray:
    """For windows that begin at 0 .. n - 1: the weights of the distinct ``keys`` found in each. What
    begins at j and is ``size`` long counts for the windows that hold it and no earlier one like it."""
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    j = np.flatnonzero(keys[at] == found)
    key = at[j]
    order = np.lexsort((j, key))
    j, key = j[order], key[order]
    before = np.where(np.append(False, key[1:] == key[:-1]), np.append(-1, j[:-1]), -1)[: len(j)]
    low = np.maximum(np.maximum(before + 1, j + size - window), 0)
    high = np.minimum(j, n - 1)
    some = low <= high
    change = np.zeros(n + 1)
    np.add.at(change, low[some], weights[key[some]])
    np.add.at(change, high[some] + 1, -weights[key[some]])
    return np.cumsum(change[:n])


def _pieces(texts: Texts, overlap: int):
    """The words of all texts, or of one text of more than PIECE bytes in pieces with ``overlap`` words in common."""
    if len(texts.offsets) != 2 or len(texts.data) <= PIECE:
        yield words(texts, breaks=NOT_ALNUM)
        return
    at, size, data = 0, PIECE, texts.data
    while True:
        end = min(at + size, len(data))
        w = words(Texts(data[at:end], np.array([0, end - at])), breaks=NOT_ALNUM)
        if end == len(data):
            yield w
            return
        whole = len(w.starts) - (not NOT_ALNUM[data[end]])
        if whole < 2 * overlap:
            size *= 2
            continue
        yield Words(w.starts[:whole], w.ends[:whole], w.hashes[:whole], np.array([0, whole]))
        at, size = at + int(w.starts[whole - overlap]), PIECE


def search(indexes: list[Index], texts: Texts) -> list[tuple]:
    """(text, item's name, score, question overlap, answer overlap) of all leaks."""
    best: dict[tuple[int, int, int], tuple[float, float, float]] = {}
    if not indexes:
        return []
    for w in _pieces(texts, indexes[-1].stride):
        for k, index in enumerate(indexes):
            for (t, item), told in _search(index, w).items():
                best[t, k, item] = tuple(map(max, best.get((t, k, item), told), told))
    return [(t, indexes[k].names[i], *v) for (t, k, i), v in sorted(best.items())]


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``leaks``, the items (item_id, text) that each text leaks, by item_id."""
    spark = docs.sparkSession
    prepare(spark)
    items = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // SHARD_BYTES))
    kind = items.schema["item_id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    told = "term long, n long"
    if shards > 1:
        terms = items.mapInArrow(_item_terms, told)
        sums = terms.where("term IS NULL").agg(F.count("*"), F.avg("n")).first()
        found = terms.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
    out = docs.drop("leaks")
    schema = T.StructType([*out.schema.fields, T.StructField("leaks", T._parse_datatype_string(LEAK.format(kind)))])
    for s in range(shards):
        own = items.where(part == s)
        got = own.orderBy("item_id", "text").toArrow()
        texts = as_texts(got.column("text"))
        if shards == 1:
            of = statistics_of(texts)
        else:
            mine = own.mapInArrow(_item_terms, told).where("term IS NOT NULL").select("term").distinct()
            counted = found.join(mine, "term").toArrow()
            term = np.array(counted.column("term"), np.int64).view(np.uint64)
            order = np.argsort(term)
            of = Statistics(sums[0], float(sums[1] or 1.0), term[order], np.array(counted.column("n"), np.int64)[order])
        indexes = build_index(got.column("item_id").to_pylist(), texts, of)
        out = out.mapInArrow(_searcher(spark.sparkContext.broadcast(indexes), text, s > 0, got.schema.field("item_id").type), schema)
    return out


def _item_terms(batches):
    """A row for each distinct term of an item, and one with a null term and the item's length."""
    for batch in batches:
        w = words(as_texts(batch.column("text")), breaks=NOT_ALNUM)
        owner = np.repeat(np.arange(batch.num_rows), w.counts)
        order = np.lexsort((w.hashes, owner))
        h, o = w.hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        n = w.counts[w.counts > 0]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(h[new].view(np.int64)), pa.nulls(len(n), pa.int64())]), pa.array(np.concatenate([np.ones(int(new.sum()), np.int64), n]), pa.int64())], names=["term", "n"])


def _searcher(shared, text: str, more: bool, kind: pa.DataType):
    leak = pa.list_(pa.struct([("item_id", kind), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    def searched(batches):
        indexes = shared.value
        for batch, texts in slices(batches, text):
            rows = batch.column("leaks").to_pylist() if more else [[] for _ in range(batch.num_rows)]
            for t, item, score, question, answer in search(indexes, texts):
                rows[t].append({"item_id": item, "score": score, "question": question, "answer": answer})
            columns = batch.columns[:-1] if more else batch.columns
            names = batch.schema.names[:-1] if more else batch.schema.names
            rows = [sorted(r, key=lambda x: (x["item_id"] is not None, x["item_id"])) for r in rows]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, leak)], names=[*names, "leaks"])

    return searched


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that leaks an item; clean documents have none."""
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaks = found.where(F.size("leaks") > 0)
    return leaks.select(
        "doc_id",
        F.size("leaks").alias("n_items"),
        F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",").alias("items"),
        F.array_max(F.transform("leaks", lambda x: x["score"])).alias("score"),
    )


QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLE_SQL: dict[str, str] = {}

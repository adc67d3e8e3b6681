"""Token-ID output: best-fit-decreasing packing with a segment tree over capacities.

A text's ids are those of tokens.py with the end id last. Documents longer than a sequence are
split without loss into full pieces and a rest; pieces go, longest first, each to the sequence
with the least room that holds it, which a segment tree over the amounts of room finds in
log(capacity) steps. Documents are packed in groups of GROUP_TOKENS within a scan's partition,
so packing is a narrow stage of bounded memory, and waste is a part of a few sequences a group.

A packed row holds the id matrix row (little-endian int32, padded with PAD), the cumulative
segment lengths, the position of each token in its segment (int32, resets to 0), and the
documents and offsets of the segments; ``write_packed`` writes these to Parquet, and
``unpack`` gives each document's ids back.

Sequence numbers are the partition's number * 2^32 plus a counter, so they follow the order of the
rows: an input that shuffles is stored first (``scratch.settled``), and a task that runs again gives the same rows.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each for
itself; a null doc_id stays null; extra columns are not carried; an empty table packs to none.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.scratch import settled
from foliospark.llm.textkit import slices
from foliospark.llm.tokens import encoder, vocabulary_path
from foliospark.session import prepare, table

CAPACITY = 4096
GROUP_TOKENS = 1 << 20
PAD = 0


class AmountTree:
    """A multiset of whole amounts 0..most as a segment tree of counts."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, amount: int, n: int = 1) -> None:
        i = amount + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least_from(self, amount: int) -> int:
        """The smallest amount in the set that is at least ``amount``; -1 if there is none."""
        count, i = self.count, amount + self.leaves
        if amount >= self.leaves:
            return -1
        while not count[i]:
            while i & 1:  # a right child: what follows is to the right of its parent
                i >>= 1
            if not i:
                return -1
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        return i - self.leaves

    def most_upto(self, amount: int) -> int:
        """The largest amount in the set that is at most ``amount``; -1 if there is none."""
        count, i = self.count, min(amount, self.leaves - 1) + self.leaves
        while not count[i]:
            while not i & 1:
                i >>= 1
            if i <= 1:
                return -1
            i -= 1
        while i < self.leaves:
            i = 2 * i + 1 if count[2 * i + 1] else 2 * i
        return i - self.leaves


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Which of the pieces (1 to ``capacity`` long) each sequence holds."""
    room = AmountTree(capacity)
    open_: dict[int, list[int]] = defaultdict(list)
    out: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        have = room.least_from(size)
        if have < 0:
            out.append([])
            at, have = len(out) - 1, capacity
        else:
            at = open_[have].pop()
            room.add(have, -1)
        out[at].append(i)
        open_[have - size].append(at)
        room.add(have - size)
    return out


def split_long(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces: full ones, then the rest."""
    n = -(-lengths // capacity)
    owner = np.repeat(np.arange(len(lengths)), n)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * capacity
    return owner, start, np.minimum(lengths[owner] - start, capacity)


def token_groups(batches, text: str, path: str, tokens: int = GROUP_TOKENS):
    """(doc_ids, ids of all, index of each document's first id) of groups of documents of about
    ``tokens`` ids."""
    held: list = []
    n = 0
    enc = encoder(path)
    for batch, texts in slices(batches, text):
        ids, first = enc.encode(texts)
        held.append((batch.column("doc_id"), ids, np.diff(first)))
        n += len(ids)
        if n >= tokens:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list):
    lengths = np.concatenate([x[2] for x in held])
    return pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([[0], np.cumsum(lengths)])


_SCHEMA = "sequence_id long, n_tokens int, ids binary, cumulative array<int>, positions binary, doc_ids array<{}>, starts array<long>"


def pack_documents(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Packed rows of ``docs`` (doc_id, text); see above."""
    prepare(docs.sparkSession)
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType

    def packed(batches):
        number = TaskContext.get().partitionId() << 32
        for doc_ids, ids, first in token_groups(batches, text, path):
            owner, start, size = split_long(np.diff(first), capacity)
            rows = best_fit(size, capacity)
            names = doc_ids.to_pylist()
            for k in range(0, len(rows), 64):
                yield _rows(rows[k : k + 64], number + k, names, ids, first, owner, start, size, capacity, doc_ids.type)
            number += len(rows)

    return settled(docs.select("doc_id", text), "packing-rows").mapInArrow(packed, _SCHEMA.format(kind.simpleString()))


def _rows(rows, number, names, ids, first, owner, start, size, capacity, kind) -> pa.RecordBatch:
    matrix = np.full((len(rows), capacity), PAD, "<i4")
    place = np.zeros((len(rows), capacity), "<i4")
    used, cumulative = [], []
    for r, pieces in enumerate(rows):
        ends = np.cumsum(size[pieces])
        for p, end in zip(pieces, ends.tolist(), strict=True):
            n = int(size[p])
            a = int(first[owner[p]] + start[p])
            matrix[r, end - n : end] = ids[a : a + n]
            place[r, end - n : end] = np.arange(n)
        used.append(int(ends[-1]))
        cumulative.append([0, *ends.tolist()])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(number, number + len(rows)), pa.int64()),
            pa.array(used, pa.int32()),
            pa.array([m.tobytes() for m in matrix], pa.binary()),
            pa.array(cumulative, pa.list_(pa.int32())),
            pa.array([m.tobytes() for m in place], pa.binary()),
            pa.array([[names[owner[p]] for p in x] for x in rows], pa.list_(kind)),
            pa.array([[int(start[p]) for p in x] for x in rows], pa.list_(pa.int64())),
        ],
        names=["sequence_id", "n_tokens", "ids", "cumulative", "positions", "doc_ids", "starts"],
    )


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet: id matrices, cumulative segment lengths and positions."""
    packed.write.mode("errorifexists").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, start, ids as array<int>) of every segment."""
    kind = packed.schema["doc_ids"].dataType.elementType

    def segments(batches):
        for b in batches:
            out: list = []
            for ids, ends, docs, starts in zip(*(b.column(c).to_pylist() for c in ("ids", "cumulative", "doc_ids", "starts")), strict=True):
                row = np.frombuffer(ids, "<i4")
                out += [(d, s, row[a:e]) for d, s, a, e in zip(docs, starts, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], b.schema.field("doc_ids").type.value_type), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))],
                names=["doc_id", "start", "ids"],
            )

    return packed.mapInArrow(segments, T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select(
        "sequence_id",
        "n_tokens",
        F.size("doc_ids").alias("n_segments"),
        "doc_ids",
        "starts",
        "cumulative",
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("positions").alias("positions_crc32"),
    )


QUERIES = {"op4_token_output": op4_token_output}
ORACLE_SQL: dict[str, str] = {}

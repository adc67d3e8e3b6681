"""Packing: hierarchical multi-length packing.

Documents (ids of tokens.py with the end id) are routed to the shortest tier of context length
that holds them; longer ones than the longest tier are cut into full windows and a rest. Tiers
are packed from the longest down: each piece opens a window of its tier, and the gap behind it
is filled from the same and the shorter tiers, first with the longest whole pieces that fit
(found in a segment tree), then by cutting the longest piece left, whose rest is routed anew.
So all windows are full, and a group of documents leaves one part-filled sequence at most.
Full windows have a power of two of tokens and need no padding; the last one is padded to the
longest tier. The windows of a group are dealt to steps of about STEP_TOKENS tokens, each to the
step that has the fewest (longest windows first).

Documents are packed in groups of GROUP_TOKENS ids within a scan's partition: a narrow stage of
bounded memory. Sequence and step numbers are the partition's number * 2^32 plus a counter, so
they follow the order of the rows: an input that shuffles is stored first (``scratch.settled``), and a
task that runs again gives the same rows.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for
itself; a null doc_id stays null; extra columns are not carried; an empty table packs to none.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.op04_token_output import AmountTree, token_groups
from foliospark.llm.scratch import settled
from foliospark.llm.tokens import vocabulary_path
from foliospark.session import prepare, table

TIERS = (512, 1024, 2048, 4096)
GROUP_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16


def pack_tiers(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows, each a list of (document, start, length)."""
    top = tiers[-1]
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by length: (document, start)
    sizes = AmountTree(top)

    def put(doc: int, start: int, length: int) -> None:
        held[length].append((doc, start))
        sizes.add(length)

    def take(length: int) -> tuple[int, int]:
        sizes.add(length, -1)
        return held[length].pop()

    windows: list[list[tuple[int, int, int]]] = []
    for doc in range(len(lengths) - 1, -1, -1):  # taken from the end, so in document order
        n = lengths[doc]
        for start in range(0, n - n % top, top):
            windows.append([(doc, start, top)])
        if n % top:
            put(doc, n - n % top, n % top)
    while (first := sizes.most_upto(top)) > 0:
        tier = next(t for t in tiers if t >= first)
        window = [(*take(first), first)]
        gap = tier - first
        while gap and (fit := sizes.most_upto(gap)) > 0:
            window.append((*take(fit), fit))
            gap -= fit
        if gap and (longest := sizes.most_upto(top)) > 0:
            doc, start = take(longest)
            window.append((doc, start, gap))
            put(doc, start + gap, longest - gap)
        windows.append(window)
    return windows


def balance(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """The step of each window: longest first, each to the step with the fewest tokens."""
    steps = max(1, round(sum(sizes) / step_tokens))
    heap = [(0, s) for s in range(steps)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        have, step = heap[0]
        heapq.heapreplace(heap, (have + sizes[i], step))
        out[i] = step
    return out


_SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long, ids binary"


def pack_hierarchical(docs: DataFrame, text: str = "text", tiers: tuple[int, ...] = TIERS, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece; ``ids``: its ids (little-endian unsigned 32-bit), null if not ``with_ids``."""
    prepare(docs.sparkSession)
    path = path or vocabulary_path()

    def packed(batches):
        number = step_number = TaskContext.get().partitionId() << 32
        for doc_ids, ids, first in token_groups(batches, text, path, GROUP_TOKENS):
            lengths = np.diff(first).tolist()
            raw = memoryview(ids.astype("<u4").tobytes())
            windows = pack_tiers(lengths, tiers)
            sizes = [sum(p[2] for p in w) for w in windows]
            steps = balance(sizes)
            cols: list[list] = [[] for _ in range(9)]
            for w, (pieces, step, size) in enumerate(zip(windows, steps, sizes, strict=True)):
                at = 0
                tier = next(t for t in tiers if t >= size)
                for doc, start, length in pieces:
                    a = 4 * (int(first[doc]) + start)
                    own = raw[a : a + 4 * length]
                    for c, v in zip(cols, (doc, start, length, zlib.crc32(own), number + w, at, tier, step_number + step, own.tobytes() if with_ids else None), strict=True):
                        c.append(v)
                    at += length
            number += len(windows)
            step_number += max(steps, default=0) + 1
            docs_at = pa.array(cols[0], pa.int64())
            told = pa.RecordBatch.from_arrays(
                [
                    doc_ids.take(docs_at),
                    *(pa.array(c, pa.int64()) for c in cols[1:4]),
                    pa.array(np.array(lengths, np.int64)[cols[0]], pa.int64()),
                    *(pa.array(c, pa.int64()) for c in cols[4:6]),
                    pa.array(cols[6], pa.int32()),
                    pa.array(cols[7], pa.int64()),
                    pa.array(cols[8], pa.binary()),
                ],
                names=[x.split()[0] for x in _SCHEMA.split(", ")],
            )
            yield told

    return settled(docs.select("doc_id", text), "packing-rows").mapInArrow(packed, _SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_hierarchical(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


QUERIES = {"op9_packing": op9_packing}
ORACLE_SQL: dict[str, str] = {}

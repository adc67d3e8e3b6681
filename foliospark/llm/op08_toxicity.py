"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed terms of the
whole text, so that pairs of terms (an insult with a group mention) count beyond what each
adds alone. Terms are runs of letters, digits and non-ASCII bytes, A-Z lower-cased, and the
first STEM bytes of the longer ones (for inflected and compound words), hashed to
2**HASH_BITS buckets.

Training is on the driver, in numpy, on at most TRAIN_ROWS labelled rows (those with the
smallest id hashes; equal feature sets count once, so groups of copies don't outvote the
rest). What is collected are the rows' bucket numbers, not their texts. A bucket gets a weight and
factors if it is associated with the label by itself (in MIN_ROWS rows or more, |z| >= MIN_Z), or as
half of a pair: of all pairs of buckets that one row in PAIR_SHARE or more has, those that have the
label more often than either half does, or less often, by PAIR_Z standard deviations. So two terms
that tell nothing alone are learned where they tell something together. All such buckets are taken,
however many; the others' rows are too few to learn anything but noise from. Scoring is a narrow stage over all rows.

Defined results: null and empty texts have no terms and score sigmoid(w0). Without labelled
rows the score is 0.5; with labels of one kind only it is near that label. Repeated rows are
scored alike; null labels are not learned from; extra columns stay, and those named like an
output column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.textkit import NOT_ALNUM, Texts, slices, stems, unique_in_texts, words
from foliospark.session import prepare, table

HASH_BITS, STEM = 18, 6
#: Labelled rows at most that training sees.
TRAIN_ROWS = 6000
MIN_ROWS, MIN_Z = 4, 4.0
#: Pairs are looked for among buckets that one training row in so many has, and PAIR_ROWS at least.
PAIR_SHARE, PAIR_ROWS, PAIR_Z = 100, 16, 8.0
FACTORS, STEPS, RATE, DECAY = 4, 300, 0.1, 2e-5
THRESHOLD = 0.7


class Machine(NamedTuple):
    """slot: weight index of each bucket, or -1."""

    slot: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray


def buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of each text, and the index of each text's first."""
    w = words(texts, breaks=NOT_ALNUM)
    stem, first = stems(texts, w, STEM)
    n = len(texts.offsets) - 1
    owner = np.concatenate([np.repeat(np.arange(n), w.counts), np.repeat(np.arange(n), np.diff(first))])
    found = np.concatenate([w.hashes, stem]) >> np.uint64(64 - HASH_BITS)
    order = np.argsort(owner, kind="stable")
    return unique_in_texts(found[order], w.first + first)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def paired(owner: np.ndarray, flat: np.ndarray, y: np.ndarray, seen: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Buckets of which a pair tells more about the label than both of them alone. ``owner`` and
    ``flat``: row and bucket of each feature; ``seen``, ``hits``: rows and labelled rows of each bucket."""
    least = max(PAIR_ROWS, -(-len(y) // PAIR_SHARE))
    common = np.flatnonzero(seen >= least)
    slot = np.full(len(seen), -1)
    slot[common] = np.arange(len(common))
    positive = int(y.sum())
    edge = -(-positive // 64) * 64  # labelled rows fill the first words of 64 rows, the others the rest
    place = np.where(y == 1, np.cumsum(y == 1) - 1, edge + np.cumsum(y == 0) - 1)
    mark = np.zeros((len(common), -(-(edge + len(y) - positive) // 64) * 8), np.uint8)
    inside = slot[flat] >= 0
    at, row = slot[flat[inside]], place[owner[inside]]
    np.bitwise_or.at(mark, (at, row >> 3), (1 << (row & 7)).astype(np.uint8))
    mark = mark.view(np.uint64)
    rate, base = hits[common] / np.maximum(seen[common], 1), positive / max(len(y), 1)
    chosen = np.zeros(len(common), bool)
    for i in range(len(common) - 1):
        both = np.bitwise_count(mark[i + 1 :] & mark[i])
        n, hit = both.sum(1, dtype=np.int64), both[:, : edge // 64].sum(1, dtype=np.int64)
        high = np.maximum(np.maximum(rate[i], base), rate[i + 1 :])
        low = np.minimum(np.minimum(rate[i], base), rate[i + 1 :])
        more = hit - n * high > PAIR_Z * np.sqrt(n * high * (1 - high))
        less = n * low - hit > PAIR_Z * np.sqrt(n * low * (1 - low))
        found = (more | less) & (n >= least // 2)
        chosen[i] |= found.any()
        chosen[i + 1 :] |= found
    return common[chosen]


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Machine:
    """rows: the distinct buckets of each text; labels: 0 or 1."""
    slot = np.full(1 << HASH_BITS, -1, np.int32)
    if not len(rows):
        return Machine(slot, 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.uint64)]).astype(np.int64)
    y = labels.astype(np.float64)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    seen = np.bincount(flat, minlength=1 << HASH_BITS)
    hits = np.bincount(flat, weights=y[owner], minlength=1 << HASH_BITS)
    z = np.abs(hits - seen * rate) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    z[seen < MIN_ROWS] = 0
    chosen = np.union1d(np.flatnonzero(z >= MIN_Z), paired(owner, flat, y, seen, hits))
    slot[chosen] = np.arange(len(chosen))
    kept = slot[flat] >= 0
    owner, term = owner[kept], slot[flat[kept]]

    def by_row(of_terms: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(owner, weights=c[term], minlength=len(rows)) for c in of_terms.T], 1)

    def by_term(of_rows: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(term, weights=c[owner], minlength=len(chosen)) for c in of_rows.T], 1)

    rng = np.random.default_rng(seed)
    parts = [np.array([np.log(rate / (1 - rate))]), np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS))]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        bias, weight, factor = parts
        sums = by_row(np.column_stack([weight, (factor**2).sum(1), factor]))
        summed = sums[:, 2:]
        score = bias + sums[:, 0] + 0.5 * ((summed**2).sum(1) - sums[:, 1])
        g = (_sigmoid(score) - y) / len(y)
        pulls = by_term(np.column_stack([g, g[:, None] * summed]))
        pull = pulls[:, 0]
        grads = [g.sum()[None], pull + DECAY * weight, pulls[:, 1:] - pull[:, None] * factor + 4 * DECAY * factor]
        for k, grad in enumerate(grads):  # Adam
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad**2
            parts[k] = parts[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9)
    return Machine(slot, float(parts[0][0]), parts[1], parts[2])


def predict(m: Machine, texts: Texts) -> np.ndarray:
    n = len(texts.offsets) - 1
    if not len(m.weight):
        return np.full(n, _sigmoid(m.bias))
    found, first = buckets(texts)
    owner = np.repeat(np.arange(n), np.diff(first))
    at = m.slot[found.astype(np.int64)]
    owner, at = owner[at >= 0], at[at >= 0]
    linear = np.bincount(owner, weights=m.weight[at], minlength=n)
    square = np.bincount(owner, weights=(m.factor[at] ** 2).sum(1), minlength=n)
    pairs = sum(np.bincount(owner, weights=m.factor[at, k], minlength=n) ** 2 for k in range(m.factor.shape[1]))
    return _sigmoid(m.bias + linear + 0.5 * (pairs - square))


def _features(batches):
    for batch, texts in slices(batches):
        found, first = buckets(texts)
        flat = found.astype("<u4")
        rows = [flat[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("label").cast(pa.int32())], names=["buckets", "label"])


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> Machine:
    """Learns ``labels`` (doc_id, label) from ``docs`` (doc_id, text) where ``usable`` holds for doc_id."""
    prepare(docs.sparkSession)
    some = labels.select("doc_id", F.col("label").cast("int")).dropna().where(usable).distinct()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label")
    got = got.mapInArrow(_features, "buckets binary, label int").distinct().orderBy(F.xxhash64("buckets"), "buckets", "label").limit(rows).toArrow()
    x = [np.frombuffer(b, "<u4") for b in got.column("buckets").to_pylist()]
    return fit(x, np.array(got.column("label").to_pylist(), np.int64))


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= threshold)."""
    prepare(docs.sparkSession)
    docs = docs.drop("score", "predicted")

    def scored(batches):
        for batch, texts in slices(batches, text):
            s = predict(machine, texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(scored, schema)


#: Rows of this remainder are never learned from.
FOLDS, HELD_OUT = 3, 1


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def machine_for(docs: DataFrame, spark: SparkSession, sf_dir: str) -> Machine:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return train_toxicity(docs, labels, fold() != HELD_OUT)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, machine_for(docs, spark, sf_dir))
    return out.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}

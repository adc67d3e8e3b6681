"""Language ID: a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's largest response
in a window is kept, and a softmax layer turns these into languages. Trained in numpy on the
driver (Adam on minibatches) from labelled texts of every language that occurs: ROWS_PER_LANGUAGE
of each at most, or fewer, where that would be more than TRAIN_ROWS in all; never less than one. They
are chosen by a hash of id and text, rows that are equal in both count as one, and of each text
at most WINDOWS_PER_TEXT windows are taken, evenly spread over it; only these windows are collected.

Prediction covers every byte of every text: a text is cut into windows of WINDOW bytes (the
last one padded), their log probabilities are averaged by bytes, and the average is
normalised; score is the probability of the predicted language. It is a narrow stage in
batches of windows, so memory doesn't depend on a text's length beyond the text itself.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and where
nothing was learned. Null languages are not learned from; ties go to the first language in
string order. Repeated rows are predicted alike; extra columns stay, those named like an
output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.textkit import Texts, slices
from foliospark.session import prepare, table

WINDOW, STRIDE, DIMS = 256, 1, 6
WIDTHS, FILTERS = (2, 3, 4), 12
ROWS_PER_LANGUAGE, WINDOWS_PER_TEXT, TRAIN_ROWS = 300, 6, 60_000
EPOCHS, BATCH, RATE = 8, 64, 0.01
UNKNOWN = "und"
_WIDE = max(WIDTHS)
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_ANY_LETTER = re.compile(r"[^\W\d_]")
#: Which weights a filter has: the narrower ones end early.
_MASK = np.concatenate([np.repeat(np.arange(_WIDE * DIMS)[:, None] < w * DIMS, FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)


class Network(NamedTuple):
    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    dense: np.ndarray
    bias: np.ndarray


def windows(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows as bytes, bytes that each holds, its text); every text has one at least."""
    length = np.diff(texts.offsets)
    n = np.maximum(1, -(-length // WINDOW))
    owner = np.repeat(np.arange(len(n)), n)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = texts.offsets[:-1][owner] + part * WINDOW
    size = np.minimum(texts.offsets[1:][owner] - begin, WINDOW)
    padded = np.concatenate([texts.data, np.zeros(WINDOW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin]
    out[np.arange(WINDOW) >= size[:, None]] = 0
    return out, size, owner


def _responses(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of embedded bytes at each position, and the filters' responses there."""
    e = net.embed[x].reshape(len(x), -1)
    view = np.lib.stride_tricks.sliding_window_view(e, _WIDE * DIMS, axis=1)[:, :: STRIDE * DIMS]
    return view, np.matmul(view, net.filters)


def log_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(net.languages)), np.float32)
    for i in range(0, len(x), 256):
        pooled = _responses(net, x[i : i + 256])[1].max(axis=1)
        score = np.maximum(pooled + net.shift, 0) @ net.dense + net.bias
        score -= score.max(axis=1, keepdims=True)
        out[i : i + 256] = score - np.log(np.exp(score).sum(axis=1, keepdims=True))
    return out


def fit(x: np.ndarray, labels: list[str], seed: int = 1) -> Network:
    """x: windows as rows of bytes; labels: the language of each."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k = len(WIDTHS) * FILTERS
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, DIMS)).astype(np.float32),
        (rng.normal(0, 0.4, (_WIDE * DIMS, k)) * _MASK).astype(np.float32),
        np.zeros(k, np.float32),
        rng.normal(0, 0.3, (k, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    if len(languages) < 2:
        return net
    number = {v: i for i, v in enumerate(languages)}
    y = np.array([number[v] for v in labels])
    share = 1 / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    share = (share * len(y) / len(languages)).astype(np.float32)
    params = list(net[1:])
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            pick = shuffled[i : i + BATCH]
            step += 1
            for j, grad in enumerate(_gradients(Network(languages, *params), x[pick], y[pick], share)):
                first[j] = 0.9 * first[j] + 0.1 * grad
                second[j] = 0.999 * second[j] + 0.001 * grad**2
                params[j] = (params[j] - RATE * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, *params)


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, share: np.ndarray):
    view, z = _responses(net, x)
    best = z.argmax(axis=1)
    rows = np.arange(len(x))
    pooled = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + net.shift
    hidden = np.maximum(pooled, 0)
    score = hidden @ net.dense + net.bias
    p = np.exp(score - score.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[rows, y] -= 1
    p *= (share[y] / len(x))[:, None]
    back = (p @ net.dense.T) * (pooled > 0)
    columns = view[rows[:, None], best]  # window, filter, weights
    d_filters = np.einsum("bf,bfd->df", back, columns) * _MASK
    d_columns = back[:, :, None] * net.filters.T[None]
    d_embed = np.zeros_like(net.embed)
    for j in range(_WIDE):
        at = x[rows[:, None], np.minimum(best * STRIDE + j, WINDOW - 1)]
        np.add.at(d_embed, at, d_columns[:, :, j * DIMS : (j + 1) * DIMS])
    return d_embed, d_filters, back.sum(0), hidden.T @ p, p.sum(0)


def predict(net: Network, texts: Texts) -> tuple[list[str], np.ndarray]:
    n = len(texts.offsets) - 1
    if not net.languages:
        return [UNKNOWN] * n, np.zeros(n)
    x, size, owner = windows(texts)
    lp = log_probabilities(net, x).astype(np.float64) * size[:, None]
    mean = np.add.reduceat(lp, np.searchsorted(owner, np.arange(n)), axis=0) if n else lp
    mean /= np.maximum(np.diff(texts.offsets), 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    letters = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(_LETTER[texts.data], out=letters[1:])
    some = np.diff(letters[texts.offsets]) > 0
    for i in np.flatnonzero(~some):
        some[i] = bool(_ANY_LETTER.search(texts.text(int(i)).decode("utf-8", "replace")))
    names = [net.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
    return names, np.where(some, p[np.arange(n), best], 0.0)


def _some_windows(batches):
    """At most WINDOWS_PER_TEXT windows of each text, from its first to its last."""
    for batch, texts in slices(batches):
        x, size, owner = windows(texts)
        n = np.bincount(owner, minlength=batch.num_rows)
        place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        step = np.maximum(n[owner], WINDOWS_PER_TEXT)
        keep = (place * WINDOWS_PER_TEXT // step != (place - 1) * WINDOWS_PER_TEXT // step) & (size >= 16)
        owner = pa.array(owner[keep])
        yield pa.RecordBatch.from_arrays([batch.column(c).take(owner) for c in ("lang", "part")] + [pa.array([w.tobytes() for w in x[keep]], pa.binary())], names=["lang", "part", "bytes"])


def train_language(docs: DataFrame, usable: Column, rows: int = ROWS_PER_LANGUAGE) -> Network:
    """Learns ``lang`` from the texts of ``docs`` (doc_id, text, lang) where ``usable`` holds."""
    spark = docs.sparkSession
    prepare(spark)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    good = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("part", part)
    found = good.groupBy("lang").agg(F.approx_count_distinct("part").alias("n")).collect()  # as many as the model has outputs
    rows = max(1, min(rows, TRAIN_ROWS // max(len(found), 1)))
    rates = spark.createDataFrame([(r["lang"], min(1.0, (2.0 * rows + 8) / r["n"])) for r in found], "lang string, rate double")
    some = good.join(rates if len(found) > TRAIN_ROWS else F.broadcast(rates), "lang").where("part < rate")
    some = some.groupBy("lang", "part").agg(F.first("text").alias("text"))
    got = some.mapInArrow(_some_windows, "lang string, part double, bytes binary").toArrow()
    part_of, lang_of = np.array(got.column("part"), float), got.column("lang").to_pylist()
    taken: dict[str, set[float]] = {}
    keep = []
    for i in np.lexsort((part_of, np.array(lang_of, object).astype(str))).tolist():
        own = taken.setdefault(lang_of[i], set())
        if len(own) < rows or part_of[i] in own:
            own.add(part_of[i])
            keep.append(i)
    keep.sort(key=lambda i: (part_of[i], lang_of[i]))
    raw = got.column("bytes").to_pylist()
    x = np.frombuffer(b"".join(raw[i] for i in keep), np.uint8).reshape(-1, WINDOW)
    return fit(x, [lang_of[i] for i in keep])


def identify_language(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")

    def told(batches):
        for batch, texts in slices(batches, text, limit=1 << 20):
            names, score = predict(net, texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(told, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


#: Rows of this remainder are never learned from.
FOLDS, HELD_OUT = 5, 0


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    docs = table(spark, sf_dir, "documents")
    net = train_language(docs.select("doc_id", "text", "lang"), fold != HELD_OUT)
    out = identify_language(docs.select("doc_id", "text"), net)
    return out.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language": op2_language}
ORACLE_SQL: dict[str, str] = {}

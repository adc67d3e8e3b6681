"""LM scoring: a bigram model by deleted interpolation.

p(w | v) = a(b) c(v,w)/c(v) + (1 - a(b)) p(w),   p(w) = e c(w)/N + (1 - e) / (V + 1)

b is the bucket of the context's frequency, floor(log2 c(v)). The weights a(b) and e are learned
by expectation-maximisation on deleted training documents (one fold of the training rows),
whose own counts are taken off the counts that they are scored with. Tokens are the words of a
text, A-Z lower-cased, and one end; a text's first token has a start as its context.

How it is distributed. Rows are dealt to blocks by their place in the table, so equal rows are spread
like others. A block sends the distinct n-grams of its texts with their counts, as sorted arrays, to
key shards; a shard adds up all blocks' counts and answers each block with the totals, in the order in
which it asked; the block then scores its texts with arrays alone. A frequent word costs each block one
key, so there is no hot key. Blocks and shards hold BLOCK_BYTES of text up to 250 GB of input; beyond,
the square root of 1 KB times the bytes (320 MB at 100 TB), which keeps the messages between them,
blocks times shards, at about 1 KB or more. A block works through parts of BLOCK_BYTES of its text (or
one longer text), so beside that text it holds its distinct n-grams, and arrays over the tokens of
one part. All counts cover all training rows. Rows are read three times, so they must come in the
same partitions and order each time: an input that shuffles is stored first.

EM sees a histogram of the deleted tokens over (bucket, level of c(v,w)/c(v), level of c(w)/N) in
half octaves, which no input makes larger than BUCKETS * LEVELS^2 cells; scores use exact ratios.

Words and pairs are 64-bit fingerprints (see textkit).

Defined results: a null text is an empty one, with the end as its only token. Without training
rows N and V are 0 and every token has p = 1. Repeated rows count as often as they occur; extra
columns are not carried; an empty table gives an empty result. A null ``held_out`` is false.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.scratch import result, settled
from foliospark.llm.textkit import mix, slices, word_hash, words
from foliospark.session import prepare, table

BLOCK_BYTES = 16 << 20
BUCKETS, LEVELS = 48, 82
EM_STEPS = 60
_START, _END = np.uint64(word_hash("start") ^ 0xA5A5), np.uint64(word_hash("end") ^ 0x5A5A)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


class Model(NamedTuple):
    total: int
    distinct: int
    mixed: np.ndarray
    word: float


def _tokens(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and the index of each text's first token."""
    parts, counts = [], []
    for _, texts in slices(group.to_batches()):
        w = words(texts)
        size = w.counts + 1
        first = np.cumsum(size) - size
        own = np.full(int(size.sum()), _END, np.uint64)
        inner = np.ones(len(own), bool)
        inner[first + size - 1] = False
        own[inner] = w.hashes
        parts.append(own)
        counts.append(size)
    size = np.concatenate([*counts, np.zeros(0, np.int64)])
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _before(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty(len(tokens), np.uint64)
    out[1:] = tokens[:-1]
    out[first[:-1]] = _START
    return out


def _pairs(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + tokens)


def _cut(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin in sorted keys: shards are equal ranges of the top 32 bits."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))


def _pack(x: np.ndarray) -> bytes:
    """A byte for each count, and eight more behind them all for each of 255 or more."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<u8").tobytes()


def _unpack(b: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(b, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(b, "<u8", offset=n).astype(np.int64)
    return out


_ASKED = "block long, shard int, words binary, word_train binary, word_dev binary, pairs binary, pair_train binary, pair_dev binary"
_TOLD = "block long, shard int, n_words int, word_train binary, word_dev binary, n_pairs int, pair_train binary, pair_dev binary, total long, total_dev long, distinct_words long"


class Part(NamedTuple):
    """Tokens of some texts; ``words`` and ``pairs``: sorted distinct keys and the key of each token
    (of words, a start's for each text behind them)."""

    docs: pa.Table
    tokens: np.ndarray
    first: np.ndarray
    words: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]


def _part(docs: pa.Table) -> Part:
    tokens, first = _tokens(docs)
    found = np.unique(np.concatenate([tokens, np.full(len(first) - 1, _START)]), return_inverse=True)
    return Part(docs, tokens, first, found, np.unique(_pairs(_before(tokens, first), tokens), return_inverse=True))


def _parts(group: pa.Table):
    """Parts of at most BLOCK_BYTES of text, or one row."""
    size = pc.fill_null(pc.binary_length(group.column("text")), 0).to_numpy()
    total, begin = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
    while begin < group.num_rows or not begin:
        end = max(int(np.searchsorted(total, total[begin] + BLOCK_BYTES, "right")) - 1, begin + 1)
        yield _part(group.slice(begin, end - begin))
        begin = end


def _merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(sorted keys, sums...) of several (sorted keys, counts...)."""
    if len(found) == 1:
        return found[0]
    keys = np.unique(np.concatenate([x[0] for x in found]))
    sums = [np.zeros(len(keys), np.int64) for _ in found[0][1:]]
    for own, *counts in found:
        at = np.searchsorted(keys, own)
        for s, c in zip(sums, counts, strict=True):
            s[at] += c
    return keys, *sums


def _ask(group: pa.Table, shards: int) -> pa.Table:
    counted: tuple[list, list] = ([], [])
    for part in _parts(group):
        size = np.diff(part.first)
        marks = [np.array(part.docs.column(c), bool) for c in ("train", "dev")]
        of_tokens = [np.repeat(m, size) for m in marks]
        for out, (keys, at), weights in (
            (counted[0], part.words, [np.concatenate(x) for x in zip(of_tokens, marks, strict=True)]),
            (counted[1], part.pairs, of_tokens),
        ):
            out.append((keys, *(np.bincount(at[w], minlength=len(keys)) for w in weights)))
    cols: list[list[bytes]] = []
    for found in counted:
        distinct, *counts = _merged(found)
        cut = _cut(distinct, shards)
        cols.append([distinct[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])
        cols += [[_pack(c[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)] for c in counts]
    block = group.column("block")[0].as_py()
    data = [pa.array([block] * shards, pa.int64()), pa.array(range(shards), pa.int32()), *(pa.array(c, pa.binary()) for c in cols)]
    return pa.Table.from_arrays(data, names=["block", "shard", "words", "word_train", "word_dev", "pairs", "pair_train", "pair_dev"])


def _answer(group: pa.Table) -> pa.Table:
    """The totals of all blocks that asked this shard; its sums of words are told with one of them."""
    n = group.num_rows
    out: dict[str, list] = {}
    total = total_dev = distinct_words = 0
    for kind in ("word", "pair"):
        asked = [np.frombuffer(b, np.uint64) for b in group.column(f"{kind}s").to_pylist()]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        ends = np.cumsum([len(x) for x in asked])[:-1]
        out[f"n_{kind}s"] = [len(x) for x in asked]
        for part in ("train", "dev"):
            own = np.concatenate([_unpack(b, len(x)) for b, x in zip(group.column(f"{kind}_{part}").to_pylist(), asked, strict=True)])
            summed = np.bincount(at, weights=own, minlength=len(keys)).astype(np.int64)
            out[f"{kind}_{part}"] = [_pack(x) for x in np.split(summed[at], ends)]
            if kind == "word":
                summed = summed[keys != _START]
                if part == "train":
                    total, distinct_words = int(summed.sum()), int((summed > 0).sum())
                else:
                    total_dev = int(summed.sum())
    data = [group.column("block").combine_chunks(), group.column("shard").combine_chunks()]
    for kind in ("word", "pair"):
        data += [pa.array(out[f"n_{kind}s"], pa.int32()), *(pa.array(out[f"{kind}_{p}"], pa.binary()) for p in ("train", "dev"))]
    data += [pa.array([x] + [0] * (n - 1), pa.int64()) for x in (total, total_dev, distinct_words)]
    return pa.Table.from_arrays(data, names=[x.split()[0] for x in _TOLD.split(", ")])


def _counts(told: pa.Table, kind: str, part: str, n: int) -> np.ndarray:
    """The totals of all shards in shard order, which is the order of the sorted keys."""
    order = np.argsort(np.array(told.column("shard")), kind="stable")
    sizes, own = told.column(f"n_{kind}s").to_pylist(), told.column(f"{kind}_{part}").to_pylist()
    out = np.concatenate([_unpack(own[i], sizes[i]) for i in order])
    if len(out) != n:
        raise ValueError(f"shards told {len(out)} counts for {n} keys")
    return out


def _lookups(docs: pa.Table, told: pa.Table, kept_only: bool):
    """For each part of a block (part, c(w), c(v), c(v,w) of each token); ``kept_only``: less the deleted rows' counts."""
    small = docs.num_rows == 1 or (pc.sum(pc.binary_length(docs.column("text"))).as_py() or 0) <= BLOCK_BYTES
    parts = list(_parts(docs)) if small else None
    keys = [_merged([(getattr(p, kind)[0],) for p in (parts or _parts(docs))])[0] for kind in ("words", "pairs")]
    totals = []
    for kind, found in zip(("word", "pair"), keys, strict=True):
        own = _counts(told, kind, "train", len(found))
        totals.append(own - _counts(told, kind, "dev", len(found)) if kept_only else own)
    for p in parts or _parts(docs):
        word, pair = (t[np.searchsorted(k, own)][at] for t, k, (own, at) in zip(totals, keys, (p.words, p.pairs), strict=True))
        own = word[: len(p.tokens)]
        context = np.empty(len(own), np.int64)
        context[1:] = own[:-1]
        context[p.first[:-1]] = word[len(own) :]
        yield p, own, context, pair


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2 count)."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _level(ratio: np.ndarray) -> np.ndarray:
    """0 for a ratio of 0, else 1 + its half octaves below 1."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, 1 + np.minimum(np.rint(-2 * np.log2(ratio)), LEVELS - 2), 0).astype(np.int64)


def _histogram(docs: pa.Table, told: pa.Table, kept: int) -> pa.Table:
    """Cells of the tokens of a block of deleted rows."""
    sums: dict[int, int] = {}
    for _, own, context, pair in _lookups(docs, told, True):
        cell = (_bucket(context) * LEVELS + _level(pair / np.maximum(context, 1))) * LEVELS + _level(own / max(kept, 1))
        for c, k in zip(*(x.tolist() for x in np.unique(cell, return_counts=True)), strict=True):
            sums[c] = sums.get(c, 0) + k
    cells, n = list(sums), list(sums.values())
    return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})


def fit_weights(cells: np.ndarray, n: np.ndarray, distinct: int) -> tuple[np.ndarray, float]:
    """EM: the weight of the pair estimate in each bucket, and that of the word estimate."""
    bucket, rest = cells // (LEVELS * LEVELS), cells % (LEVELS * LEVELS)
    ratio = lambda level: np.where(level > 0, 2.0 ** (-(level - 1) / 2), 0.0)
    pair, word = ratio(rest // LEVELS), ratio(rest % LEVELS)
    flat = 1 / (distinct + 1)
    a, e = np.full(BUCKETS, 0.5), 0.5
    seen = np.bincount(bucket, weights=n, minlength=BUCKETS)
    for _ in range(EM_STEPS):
        low = e * word + (1 - e) * flat
        p = a[bucket] * pair + (1 - a[bucket]) * low
        from_pair = n * a[bucket] * pair / p
        from_word = n * (1 - a[bucket]) * e * word / p
        a = np.where(seen > 0, np.bincount(bucket, weights=from_pair, minlength=BUCKETS) / np.maximum(seen, 1), a)
        below = (n - from_pair).sum()
        e = float(from_word.sum() / below) if below > 0 else e
    a[0] = 0.0
    return np.clip(a, 0, 1 - 1e-6), min(max(e, 1e-6), 1 - 1e-6)


def _scores(docs: pa.Table, told: pa.Table, m: Model) -> pa.Table:
    return pa.concat_tables([_scored(*x, m) for x in _lookups(docs, told, False)])


def _scored(part: Part, own: np.ndarray, context: np.ndarray, pair: np.ndarray, m: Model) -> pa.Table:
    docs, first = part.docs, part.first
    a = m.mixed[_bucket(context)]
    flat = 1 / (m.distinct + 1)
    low = m.word * own / m.total + (1 - m.word) * flat if m.total else np.full(len(own), 1.0)
    p = a * pair / np.maximum(context, 1) + (1 - a) * low
    base = np.log10((own + 0.1) / (m.total + 0.1 * (m.distinct + 1)))
    at = first[:-1]
    known = np.concatenate([[0], np.cumsum(own > 0)])
    n = docs.num_rows
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "held_out": docs.column("held_out"),
            "n_tokens": pa.array(np.diff(first), pa.int64()),
            "n_known": pa.array(known[first[1:]] - known[at], pa.int64()),
            "train_tokens": pa.array(np.full(n, m.total), pa.int64()),
            "base_score": pa.array(np.add.reduceat(base, at), pa.float64()),
            "score": pa.array(np.add.reduceat(np.log10(p), at), pa.float64()),
        }
    )


def lm_scores(docs: DataFrame, held_out: Column, deleted: Column) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text) by a model of those that aren't ``held_out``; the
    mixture weights are learned on those of them that are ``deleted``."""
    spark = docs.sparkSession
    prepare(spark)
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = max(BLOCK_BYTES, int((bytes_ * 1024) ** 0.5))
    blocks = shards = max(1, -(-bytes_ // size))
    held = F.coalesce(held_out, F.lit(False))
    dev = ~held & F.coalesce(deleted, F.lit(False))
    docs = settled(docs.select("doc_id", "text", held.alias("held_out"), dev.alias("dev")), "lm-rows")
    held, dev = F.col("held_out"), F.col("dev")
    docs = docs.withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    by = F.col("place")  # deleted rows have blocks of their own, below 0
    block = F.when(dev, -1 - F.pmod(by, F.lit(-(-blocks // 8)))).otherwise(F.pmod(by, F.lit(blocks)))
    dealt = docs.select("doc_id", "text", "held_out", (~held).alias("train"), "dev", block.alias("block"))
    asked = dealt.groupBy("block").applyInArrow(lambda group: _ask(group, shards), _ASKED)
    told = result(asked.groupBy("shard").applyInArrow(_answer, _TOLD), "lm-counts")
    total, total_dev, distinct = (x or 0 for x in told.agg(F.sum("total"), F.sum("total_dev"), F.sum("distinct_words")).first())
    kept = total - total_dev
    dev_rows = dealt.where(dev).groupBy("block").cogroup(told.where("block < 0").groupBy("block"))
    asked_dev = dev_rows.applyInArrow(lambda d, t: _histogram(d, t, kept), "cell long, n long")
    cells = asked_dev.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    mixed, word = fit_weights(np.array(cells.column("cell"), np.int64), np.array(cells.column("n"), np.float64), distinct)
    model = Model(total, distinct, mixed, word)
    out = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda d, t: _scores(d, t, model), out.format(kind))


#: Rows of the first remainder are held out; of the others, those of the second weigh the mixture.
FOLDS, HELD_OUT, DELETED = 10, 0, 1


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), fold == HELD_OUT, fold == DELETED)


QUERIES = {"op5_lm": op5_lm}
ORACLE_SQL: dict[str, str] = {}

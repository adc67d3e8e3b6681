"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Texts are sets of shingles of SHINGLE words (A-Z lower-cased; a text of fewer words is one
shingle). Two texts are linked if the Jaccard similarity of their sets is THRESHOLD or more.

1. Sketch: each text gets a 64-bit fingerprint of its set and TREES * DEPTH minima (16 bits of each).
   Texts with equal sets are one *set* from here on, with a number of copies, so copies are never paired.
2. Forest: in each tree a set has a label of DEPTH minima. The labels of a tree, sorted, are its prefix
   trie: a node of depth d is a run of labels with d minima in common. All labels are sorted at once, by
   range, so no node is a task. A set's deepest matched prefix is the longer one of those that it
   shares with its two neighbours; sets that share less than the shallowest depth in use leave here.
3. Search: every set asks at depth DEPTH who is under its nodes, and then, with its prefixes made
   SHORTEN minima shorter each time, until the recall estimated for it reaches RECALL: the mean chance
   that a pair as similar as those found is found at this depth, 1 - (1 - s^d)^TREES, each pair
   weighted by the inverse of how often it is found. A set that has found nobody, or only sets near the
   threshold, goes on down to the shallowest depth: the deepest at which that chance reaches RECALL
   at the threshold itself (5 for 0.8), so no pair has a smaller chance than that unless both of its sets are done before.
   Under a node pairs are looked at by arrays, by the agreement of their minima (ESTIMATE_MARGIN
   standard deviations below the threshold still pass). No pair leaves as a row: a set leaves
   with one set that it is connected to there, never many with the same one. A node of more than NODE sets is dealt to blocks:
   before the last depth each block is looked at by itself and with one hub block, at the last depth only sets
   outside of the node's largest group so far ask all others. So a hot node costs its size, not its square.
4. Groups of candidates: the components of those connections. Within a group *all* pairs are verified
   whose minima agree enough, whether or not they met in a tree: a text goes to one group, once, or in
   groups of more than VERIFY_SETS sets or VERIFY_BYTES of text, which are dealt to blocks, once for each block.
   Similarities are counted from the shingle sets. A block gives, for each set, the copies it is
   linked to and one set that it is connected to there.
5. Components of the verified links are the groups of near duplicates.

Result, a row for each document: class_id, the smallest doc_id of its group; n_links, the number
of other documents (copies included) at THRESHOLD or more; n_copies, documents with its set. It is a
stored table; ``scratch.release`` deletes it, all others are deleted on the way.

Defined results: null, empty and blank texts have no shingle; they are linked to nothing and
their class is their own doc_id. Rows with equal doc_id are separate documents of one id. A
null doc_id takes part and gets the class of its group. Extra columns are not carried; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.components import connected_components
from foliospark.llm.scratch import Workspace, result
from foliospark.llm.textkit import mix, shingles, slices, unique_in_texts, words
from foliospark.session import prepare, table

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, SHORTEN, RECALL = 16, 8, 3, 0.995
NODE = 512
VERIFY_SETS, VERIFY_BYTES = 512, 16 << 20
FAN_BITS = 5
ESTIMATE_MARGIN = 4.0
_ALL = TREES * DEPTH
_rng = np.random.default_rng(20240601)
_FACTORS = _rng.integers(0, 1 << 32, _ALL, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, _ALL, dtype=np.uint32)


def chance(similarity, depth: int):
    """That a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def shallowest(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix that a pair at the threshold shares in some tree with this chance."""
    return next((d for d in range(DEPTH, 1, -1) if chance(threshold, d) >= recall), 1)


def shingle_sets(texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return unique_in_texts(*shingles(words(texts), size))


def minima(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """16 bits of each of the minima of each set, as rows of big-endian numbers."""
    have = first[1:] > first[:-1]
    begin = first[:-1][have]
    out = np.full((len(have), _ALL), 0xFFFF, ">u2")
    x = (found >> np.uint64(32)).astype(np.uint32)
    if len(begin):
        for k in range(_ALL):
            y = (x ^ _SHIFTS[k]) * _FACTORS[k]
            y ^= y >> np.uint32(15)
            least = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), begin)
            out[have, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    return out


def _sketch(batches, size: int):
    for batch, texts in slices(batches):
        found, first = shingle_sets(texts, size)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found), dtype=np.uint64)])
        n = np.diff(first)
        set_id = mix((total[first[1:]] - total[first[:-1]]) + n.astype(np.uint64)).view(np.int64)
        none = n == 0
        rows = minima(found, first)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(texts.offsets), pa.int64()), pa.array(set_id, pa.int64(), mask=none),
                pa.array([None if z else r.tobytes() for z, r in zip(none, rows, strict=True)], pa.binary()),
            ],
            names=["doc_id", "text_hash", "bytes", "set_id", "minima"],
        )


def _matched(batches, least: int):
    """Of labels sorted by tree, the depth of each one's deepest matched prefix, where that is ``least`` or
    more. What the first and the last label of a partition share with others isn't known here: all of it, perhaps."""

    def depths(t: pa.Table) -> np.ndarray:
        rows = np.frombuffer(b"".join(t.column("label").to_pylist()), ">u2").reshape(-1, DEPTH)
        tree = np.asarray(t.column("tree"))
        equal = (rows[1:] == rows[:-1]) & (tree[1:] == tree[:-1])[:, None]
        return np.logical_and.accumulate(equal, axis=1).sum(1)

    def told(t: pa.Table, before: int, shared: np.ndarray, after: int):
        deep = np.maximum(np.append(before, shared), np.append(shared, after))
        kept = deep >= least
        if kept.any():
            yield from t.append_column("deep", pa.array(deep, pa.int32())).filter(pa.array(kept)).combine_chunks().to_batches()

    held, before = None, DEPTH
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        shared = depths(t)
        n = t.num_rows - 1  # the last label waits for its neighbour
        if n:
            yield from told(t.slice(0, n), before, shared[: n - 1], int(shared[n - 1]))
            before = int(shared[n - 1])
        held = t.slice(n)
    if held is not None:
        yield from told(held, before, np.zeros(0, np.int64), DEPTH)


def _runs(batches, keys: list[str]):
    """Tables of whole groups from batches that are sorted by ``keys``, with the groups' bounds."""
    held: list[pa.RecordBatch] = []

    def whole(parts, last: bool):
        t = pa.Table.from_batches(parts).combine_chunks()
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in keys:
            x = np.asarray(t.column(k))
            change[1:] |= x[1:] != x[:-1]
        bounds = np.append(np.flatnonzero(change), t.num_rows)
        return t, bounds if last else bounds[:-1]

    rows = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        size += b.nbytes
        if rows < 2048 and size < 4 << 20:
            continue
        t, bounds = whole(held, False)
        rows = size = 0
        if len(bounds) > 1:
            yield t, bounds
            t = t.slice(int(bounds[-1]))
        held = t.to_batches()
    if held:
        yield whole(held, True)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, _ALL).astype(np.uint16)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima the rows of ``a`` and those of ``b`` have in common."""
    if len(a) * len(b) <= 4096:
        return (a[:, None, :] == b[None, :, :]).sum(-1)
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(_ALL):
        out += a[:, k, None] == b[None, :, k]
    return out


def least_agreement(threshold: float) -> float:
    return _ALL * threshold - ESTIMATE_MARGIN * (_ALL * threshold * (1 - threshold)) ** 0.5


def joined(n: int, ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the smallest of the ``ids`` that the pairs (i, j) connect it to."""
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        if (label == before).all():
            return label


def tied(ids: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row another id of its label, such that these ties connect all rows of a label and no id
    has many: the labels' ids hang in a trie of their hashes, FAN_BITS bits a level, each under the
    smallest hash of its branch. So the same sets are tied alike in whichever groups they meet."""
    h = mix(ids.view(np.uint64))
    order = np.lexsort((h, label))
    h, label = h[order], label[order]
    place = np.arange(len(ids))
    new = np.append(True, label[1:] != label[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(ids)))[np.cumsum(new) - 1]
    levels = np.ceil(np.log2(size) / FAN_BITS).astype(int) - 1
    to = place.copy()
    for level in range(int(levels.max(initial=0)), -1, -1):
        branch = h >> np.uint64(64 - FAN_BITS * level) if level else np.zeros_like(h)
        begins = new | np.append(True, branch[1:] != branch[:-1])
        first = np.maximum.accumulate(np.where(begins, place, 0))
        to = np.where((to == place) & (levels >= level), first, to)
    out = np.empty(len(ids), np.int64)
    out[order] = ids[order[to]]
    return out


_NODE_KEYS = ["node", "low", "high"]
#: Rows of a group: ALL are compared with each other and with ASKING ones, ASKED only with those.
_ALL_PAIRS, _ASKING, _ASKED = 0, 1, 2


def _candidates(batches, depth: int, least: float, threshold: float):
    """(set, a set that it is connected to, weight of its finds, their weighted chances) by node."""
    for t, bounds in _runs(batches, _NODE_KEYS):
        rows = _matrix(t.column("minima"))
        role, ids, group, done = (np.asarray(t.column(c)) for c in ("role", "set_id", "component", "done"))
        size = np.diff(bounds)
        left, right, agree, out = [], [], [], []
        twos = bounds[:-1][(size == 2) & (role[bounds[:-1]] == _ALL_PAIRS)]
        twos = twos[role[twos + 1] == _ALL_PAIRS]
        if len(twos):
            left.append(twos)
            right.append(twos + 1)
            agree.append((rows[twos] == rows[twos + 1]).sum(1))
        skip = set(twos.tolist())
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a < 2 or a in skip:
                continue
            own, asking, asked = (a + np.flatnonzero(role[a:b] == r) for r in (_ALL_PAIRS, _ASKING, _ASKED))
            for x, y in ((own, own), (own, asking), (asking, asked)):
                if len(x) and len(y):
                    found = agreement(rows[x], rows[y])
                    i, j = np.nonzero(np.triu(found, 1) >= least if x is y else found >= least)
                    left.append(x[i])
                    right.append(y[j])
                    agree.append(found[i, j])
        if not left:
            continue
        i, j, both = (np.concatenate(x) for x in (left, right, agree))
        keep = (both >= least) & (ids[i] != ids[j]) & (group[i] != group[j]) & ~(done[i] & done[j])
        i, j, both = i[keep], j[keep], both[keep].astype(float)
        if not len(i):
            continue
        s = np.clip((both - depth) / (_ALL - depth), threshold, 1.0)  # the shared prefix itself tells nothing
        weight = s**-depth
        sums = [np.bincount(np.append(i, j), weights=np.append(w, w), minlength=len(ids)) for w in (weight, weight * chance(s, depth))]
        some = np.unique(np.append(i, j))
        label = joined(len(ids), ids, i, j)[some]
        out = [pa.array(ids[some], pa.int64()), pa.array(tied(ids[some], label), pa.int64()), *(pa.array(x[some], pa.float64()) for x in sums)]
        yield pa.RecordBatch.from_arrays(out, names=["set_id", "tie", "weight", "chances"])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs in ``mask``."""
    out = np.zeros(mask.shape, np.int64)
    pairs = np.argwhere(mask)
    if len(pairs) <= 2 * (len(left) + len(right)):
        for i, j in pairs:
            out[i, j] = len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True))
        return out
    both = np.concatenate([sets[i] for i in left] + [sets[j] for j in right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(sets[i]) for i in left] + [len(sets[j]) for j in right])
    names, at, often = np.unique(both, return_inverse=True, return_counts=True)
    keep = often[at] > 1
    at, owner = (np.cumsum(often > 1) - 1)[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for base in range(0, int((often > 1).sum()), 4096):
        span = slice(*np.searchsorted(at, [base, base + 4096]))
        part = np.zeros((len(left) + len(right), 4096), np.float32)
        part[owner[span], at[span] - base] = 1
        out += (part[: len(left)] @ part[len(left) :].T).astype(np.int64)
    return out


_GROUP_KEYS = ["component", "low", "high"]


def _verified(batches, size: int, threshold: float):
    least = least_agreement(threshold)
    for t, bounds in _runs(batches, _GROUP_KEYS):
        rows = _matrix(t.column("minima"))
        side, ids, copies = (np.asarray(t.column(c)) for c in ("side", "set_id", "copies"))
        sets: list[np.ndarray] = []
        for _, texts in slices(iter(t.select(["text"]).to_batches())):
            found, first = shingle_sets(texts, size)
            sets += [found[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        length = np.array([len(s) for s in sets])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            left = right = a + np.flatnonzero(side[a:b] == 0)
            if len(left) < b - a:
                right = a + np.flatnonzero(side[a:b] == 1)
            mask = agreement(rows[left], rows[right]) >= least
            if left is right:
                mask = np.triu(mask, 1)
            common = overlaps(sets, left, right, mask)
            linked = mask & (common >= threshold * (length[left][:, None] + length[right][None, :] - common) - 1e-9)
            if not linked.any():
                continue
            links = np.zeros(b - a, np.int64)
            np.add.at(links, left - a, linked @ copies[right])
            np.add.at(links, right - a, copies[left] @ linked)
            i, j = np.nonzero(linked)
            some = links > 0
            label = joined(b - a, ids[a:b], left[i] - a, right[j] - a)[some]
            out.append((ids[a:b][some], tied(ids[a:b][some], label), links[some]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out, strict=True)], names=["set_id", "tie", "links"])


def _by_group(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, "set_id")


def _pairs_of_blocks(df: DataFrame, block, blocks) -> DataFrame:
    """A row for each pair (low, high) of blocks that has the row's ``block``; side 1: it is the higher of two."""
    out = df.withColumns({"own": block, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return out.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other")


def _asked_at(forest: DataFrame, known: DataFrame | None, depth: int, last: bool) -> DataFrame:
    """The sets under the nodes of a depth at which some set still asks, dealt to groups."""
    at = forest.where(F.col("deep") >= depth).select("set_id", F.xxhash64("tree", F.substring("label", 1, 2 * depth)).alias("node"))
    if known is None:
        at = at.withColumns({"component": F.col("set_id"), "done": F.lit(False)})
    else:
        at = at.join(known, "set_id", "left").withColumns({"component": F.coalesce("component", "set_id"), "done": F.coalesce("done", F.lit(False))})
    groups = at.groupBy("node", "component").agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("asking"))
    nodes = groups.groupBy("node").agg(F.sum("n").alias("n"), F.sum("asking").alias("asking"), F.count("*").alias("groups"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"))
    nodes = nodes.where("asking > 0 AND groups > 1").select("node", "n", "largest", (F.col("n") - F.col("most")).alias("outside"))
    at = at.join(nodes, "node").withColumn("blocks", F.ceil(F.col("n") / NODE).cast("int"))
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    zero, several = F.lit(0), F.col("blocks") > 1
    row = lambda low, high, role: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(role).alias("role"))
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    if last:
        parts = F.ceil(F.col("outside") / NODE).cast("int")
        asked = upto(parts, lambda x: row(block, x, _ASKED))
        asking = upto(F.col("blocks"), lambda x: row(x, F.pmod(F.xxhash64("set_id"), parts), _ASKING))
        places = F.when(F.col("component") == F.col("largest"), asked).otherwise(F.concat(asked, asking))
    else:
        hub = F.transform(F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1))), lambda x: row(x, zero, _ASKING))
        places = F.when(block == 0, F.concat(F.array(row(zero, zero, _ALL_PAIRS)), hub)).otherwise(F.array(row(block, zero, _ALL_PAIRS)))
    places = F.when(several, places).otherwise(F.array(row(zero, zero, _ALL_PAIRS)))
    return at.withColumn("place", F.explode(places)).select("set_id", "node", "place.low", "place.high", "place.role", "component", "done")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_copies."""
    return row_classes(docs, threshold, size, recall).select("doc_id", "class_id", "n_links", "n_copies")


def row_classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """near_duplicates with text_hash, which with doc_id tells a row's text, and class_set, a number of
    the class that other classes of the same class_id don't have; null for a text without a word."""
    spark = docs.sparkSession
    prepare(spark)
    with Workspace(spark) as kept:
        return result(*_row_classes(docs, threshold, size, recall, kept))


def _row_classes(docs: DataFrame, threshold: float, size: int, recall: float, kept: Workspace) -> tuple[DataFrame, str, int]:
    kind = docs.schema["doc_id"].dataType.simpleString()
    floor, least = shallowest(threshold, recall), least_agreement(threshold)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketches = kept.stored(texts.mapInArrow(lambda b: _sketch(b, size), f"doc_id {kind}, text_hash long, bytes long, set_id long, minima binary"), "sketches")
    rows = sketches.count()
    one = F.min_by(F.struct("text_hash", "bytes"), F.struct(F.col("doc_id").isNull(), "doc_id"))
    sets = sketches.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), one.alias("one"), F.max("minima").alias("minima"))
    sets = kept.stored(sets.select("set_id", "first_doc", "copies", "one.text_hash", "one.bytes", "minima"), "sets", rows)

    labels = F.array(*(F.struct(F.lit(t).alias("tree"), F.substring("minima", 2 * DEPTH * t + 1, 2 * DEPTH).alias("label")) for t in range(TREES)))
    placed = sets.select("set_id", F.explode(labels).alias("at")).select("at.tree", "at.label", "set_id")
    tries = placed.repartitionByRange("tree", "label", "set_id").sortWithinPartitions("tree", "label", "set_id")
    forest = kept.stored(tries.mapInArrow(lambda b: _matched(b, floor), "tree int, label binary, set_id long, deep int"), "forest", 16 * rows)
    placed_rows = forest.count()
    known = edges = None
    for depth in [*range(DEPTH, floor, -SHORTEN), floor]:
        asked = _asked_at(forest, known, depth, depth == floor).join(sets.select("set_id", "minima"), "set_id")
        found = _by_group(asked, _NODE_KEYS).mapInArrow(lambda b, d=depth: _candidates(b, d, least, threshold), "set_id long, tie long, weight double, chances double")
        found = kept.stored(found, "candidates", placed_rows)
        pairs = found.where("set_id <> tie").select(F.col("set_id").alias("a"), F.col("tie").alias("b"))
        edges = pairs if known is None else pairs.union(known.where("set_id <> component").select("set_id", "component"))
        if depth > floor:
            recalls = found.groupBy("set_id").agg((F.sum("chances") >= recall * F.sum("weight")).alias("done"))
            if known is not None:
                recalls = recalls.union(known.where("done").select("set_id", "done")).groupBy("set_id").agg(F.max("done").alias("done"))
            groups = connected_components(edges, kept, rounds=1).withColumnRenamed("node", "set_id")
            known = kept.stored(groups.join(recalls, "set_id", "left").select("set_id", "component", F.coalesce("done", F.lit(False)).alias("done")), "known", rows, narrow=True)
    groups = connected_components(edges, kept).withColumnRenamed("node", "set_id")

    wanted = sets.join(groups, "set_id")
    totals = wanted.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / VERIFY_SETS), F.ceil(F.sum("bytes") / VERIFY_BYTES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    fetched = texts.join(wanted.select("set_id", "first_doc", F.col("text_hash").alias("its_hash")), texts.text_hash.eqNullSafe(F.col("its_hash")) & texts.doc_id.eqNullSafe(F.col("first_doc")))
    fetched = fetched.select("set_id", "text").dropDuplicates(["set_id"])
    whole = wanted.select("set_id", "component", "copies", "minima").join(fetched, "set_id")
    ready = _pairs_of_blocks(whole.join(totals, "component"), block, F.col("blocks")).select("set_id", *_GROUP_KEYS, "side", "copies", "minima", "text")
    checked = kept.stored(_by_group(ready, _GROUP_KEYS).mapInArrow(lambda b: _verified(b, size, threshold), "set_id long, tie long, links long"), "links", rows)

    grouped = connected_components(checked.where("set_id <> tie").select(F.col("set_id").alias("a"), F.col("tie").alias("b")), kept).withColumnRenamed("node", "set_id")
    links = checked.groupBy("set_id").agg(F.sum("links").alias("links"))
    # Stored sides: a join straight over two tables can split a group or a set that holds many rows.
    firsts = kept.stored(grouped.join(sets.select("set_id", "first_doc"), "set_id").groupBy("component").agg(F.min("first_doc").alias("class_doc")), "classes", rows, narrow=True)
    classes = grouped.join(firsts, "component").select("set_id", "class_doc", "component")
    named = sets.select("set_id", "first_doc", "copies").join(classes, "set_id", "left").join(links, "set_id", "left")
    named = kept.stored(named.select("set_id", F.coalesce("class_doc", "first_doc").alias("class_doc"), F.coalesce("component", "set_id").alias("class_set"), "copies", F.coalesce("links", F.lit(0)).alias("links")), "named-sets", rows, narrow=True)
    out = sketches.select("doc_id", "text_hash", "set_id").join(named, "set_id", "left")
    out = out.select(
        "doc_id",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_doc")).alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        "text_hash",
        "class_set",
    )
    return out, "near-duplicates", rows


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_jaccard": op3_jaccard}
ORACLE_SQL: dict[str, str] = {}

"""Secret scans: one combined deterministic automaton scans the bytes of a text once for all
rules; only the stretches in which a rule ends are looked at again for exact bounds.

Matches are leftmost, longest and non-overlapping for each kind. A rule may name a smallest
length of its matched text or of its tail; shorter matches are found and then dropped, as if
the expression had matched without the length. Offsets are code points, ends exclusive.

A stretch is a run of bytes in which the automaton is out of its start state, so no match
crosses its bounds. Where matches begin in it, one pass of the rule's mirrored automaton from the
stretch's end tells; from the first such place the rule is walked to its longest end, then from the
first one behind that. So a place from which nothing matches is never walked, and the time is linear
in the text, however often a match nearly begins, for rules that, like all of RULES, can't go on
after an end without ending again at once (else a walk may pass the end that it returns).
Scanning is a narrow stage: no shuffle, and memory is bounded by one slice of texts (1 MB, or
a single longer text; a very long text costs about 30 times its bytes).

Defined results: null and empty texts have no spans. Extra columns stay; those named ``spans``
or ``redacted`` are replaced. Repeated rows are scanned each for itself, and an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.automaton import as_rows, beginnings, compile_rules, longest, scan
from foliospark.llm.textkit import as_texts, slices
from foliospark.session import prepare, table


class Rule(NamedTuple):
    """``least``: the smallest length of a match that stays. ``tail``: the same for its trailing
    characters of ``tail_set``. Long counts stand here and not in the expression, where each
    would multiply the automaton's states; a count on a rule's first class costs only itself."""

    kind: str
    pattern: str
    either_case: bool = False
    least: int = 0
    tail: int = 0
    tail_set: str = ""


# The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, tail=6, tail_set="A-Za-z0-9+/_.=-"),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Rules that the method adds.
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("pem", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
)
RULES = (*BASE_RULES, *MORE_RULES)
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
MASK = "[SECRET]"


class Scanner:
    """The compiled rules: one automaton for the pass, two for each rule for exact bounds."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.all = compile_rules([(r.pattern, r.either_case) for r in rules])
        self.each = [as_rows(compile_rules([(r.pattern, r.either_case)], anchored=True)) for r in rules]
        self.mirrored = [as_rows(compile_rules([(r.pattern, r.either_case)], backward=True)) for r in rules]
        self.tails = [re.compile(f"[{r.tail_set}]*\\Z".encode()) if r.tail else None for r in rules]

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, start, end, rule) in bytes, for the texts that ``offsets`` bound."""
        states = scan(self.all, data, offsets[:-1])
        ends = np.flatnonzero(self.all.accepts[states])
        if not len(ends):
            return []
        stop = np.zeros(len(data) + 1, bool)
        stop[offsets] = True
        calm = np.flatnonzero((states == 0) | stop[1:])  # a stretch ends with these at the latest
        begin_of = np.searchsorted(calm, ends)  # number of calm bytes before each end
        found, raw = [], data.tobytes()
        for g in np.unique(begin_of):
            hits = ends[begin_of == g] if len(ends) < 64 else ends[np.searchsorted(begin_of, g) : np.searchsorted(begin_of, g, "right")]
            begin = int(calm[g - 1]) + 1 if g else 0
            end = min(int(calm[g]) + 1, len(data)) if g < len(calm) else len(data)
            wanted = int(np.bitwise_or.reduce(self.all.accepts[states[hits]]))
            text = int(np.searchsorted(offsets, begin, "right")) - 1
            for r in range(len(self.rules)):
                if wanted >> r & 1:
                    found += self._bounds(raw, begin, end, r, text)
        return found

    def _bounds(self, raw: bytes, at: int, end: int, r: int, text: int):
        tail, passed = self.tails[r], at
        for at in beginnings(self.mirrored[r], raw, at, end):
            to = longest(self.each[r], raw, at, end) if at >= passed else -1
            if to < 0:
                continue
            passed = to
            if passed - at >= self.rules[r].least and (tail is None or self._tail(raw, at, passed, r) >= self.rules[r].tail):
                yield text, at, passed, r

    def _tail(self, raw: bytes, at: int, to: int, r: int) -> int:
        """Length of the last part of the match: what follows the separator and its quote."""
        m = re.fullmatch(_tail_pattern(self.rules[r]), raw[at:to])
        return len(m[1]) if m else to - at


def _tail_pattern(rule: Rule) -> re.Pattern:
    """The rule's expression with its trailing ``[tail_set]+`` as the only group."""
    head = rule.pattern[: -len(f"[{rule.tail_set}]+")].replace("(", "(?:")
    return re.compile(f"{head}([{rule.tail_set}]+)".encode(), re.IGNORECASE if rule.either_case else 0)


def _spans_of(batches, scanner: Scanner, text: str):
    for batch, texts in slices(batches, text):
        byte = scanner.spans(texts.data, texts.offsets)
        rows: list[list] = [[] for _ in range(batch.num_rows)]
        if byte:
            points = np.zeros(len(texts.data) + 1, np.int64)
            np.cumsum((texts.data & 0xC0) != 0x80, out=points[1:])
            for t, a, b, r in byte:
                zero = points[texts.offsets[t]]
                rows[t].append((int(points[a] - zero), r, int(points[b] - zero)))
        out = [[{"kind": scanner.rules[r].kind, "start": a, "end": b} for a, r, b in sorted(x)] for x in rows]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "spans"])


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``spans``: array of (kind, start, end) by start, then by the order of the rules."""
    prepare(docs.sparkSession)
    docs = docs.drop("spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("spans", SPAN)])
    scanner = Scanner(rules)
    return docs.mapInArrow(lambda batches: _spans_of(batches, scanner, text), schema)


def _redact(text: str | None, spans: list) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] > at or not out:
            out += [text[at : s["start"]], MASK]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def _redacted_of(batches, scanner: Scanner, text: str):
    for batch in _spans_of(batches, scanner, text):
        own = batch.column(text)
        spans = batch.column(batch.num_columns - 1)
        hit = np.flatnonzero(np.asarray(pa.compute.list_value_length(spans)) > 0)
        values = own.to_pylist() if len(hit) else own
        for i in hit:
            values[i] = _redact(values[i], spans[int(i)].as_py())
        cols = [pa.array(values, own.type) if n == text else c for n, c in zip(batch.schema.names, batch.columns)]
        yield pa.RecordBatch.from_arrays(cols[:-1], names=batch.schema.names[:-1])


def redact_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows with each stretch of overlapping spans in ``text`` replaced by MASK."""
    prepare(docs.sparkSession)
    scanner = Scanner(rules)
    schema = docs.schema
    return docs.drop("spans").mapInArrow(lambda batches: _redacted_of(batches, scanner, text), T.StructType([f for f in schema.fields if f.name != "spans"]))


def digest(spans: str | None) -> str:
    return hashlib.sha256((spans or "").encode()).hexdigest()


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


QUERIES = {"op10_secrets": op10_secrets}
ORACLE_SQL: dict[str, str] = {}

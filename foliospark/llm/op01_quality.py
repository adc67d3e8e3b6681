"""Quality rules: a short-circuit cascade of native expressions.

``plan_cascade`` estimates, on a bounded sample of the table, the cost and the rejections of each
rule and orders the rules greedily by rejections per second among the rows that the earlier ones
leave; ``apply_cascade`` tests them in that order in one CASE. A measure that only a rule needs is
computed inside that rule's branch, so a row that one rule rejects is neither measured for nor shown
to the later ones. Measures that are asked for as columns are computed for every row and cost the
rules nothing more. The order changes the cost alone: ``kept`` is false exactly where any rule rejects.

Words are runs ``[^\\x20\\x09-\\x0D]+``. Everything on the main path is a built-in expression;
the repeated windows of a text are found by sorting its window hashes (64 bits), so a text
of n words costs n log n whatever it repeats.

The sample: SAMPLE_ROWS rows or so, drawn at random over the whole table (one read of the text column,
no shuffle); texts alone are fetched, and those longer than SAMPLE_BYTES are left out of the sample
(and of nothing else).

Defined results: a null or empty text has no words and fails the base rule. A rule whose
test is null does not reject. Extra columns stay, those named like a result are replaced
(working columns take names that the table doesn't use), repeated rows are measured each for
itself, and an empty table gives an empty result.
"""

from __future__ import annotations

import re
import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import table

#: Words in a window whose repetition counts.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Rows of the sample that orders the rules; never more than twice as many.
SAMPLE_ROWS = 500
#: Longer texts are left out of that sample (and of nothing else), which bounds its size.
SAMPLE_BYTES = 1 << 16
#: Runs of each rule on the sample; the shortest counts.
TIMINGS = 2


class Rule(NamedTuple):
    """A rule rejects where its SQL condition over the text or the measures is true."""

    name: str
    rejects: str


BASE_RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_windows", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
)
#: The method's own rules. Counts are compared in whole numbers, so every engine agrees.
RULES = (
    *BASE_RULES,
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("stuttering", "3 * n_stutters > n_words"),
    Rule("repeated_lines", "n_dup_lines > 3 AND 2 * n_dup_lines > n_text_lines"),
)
#: What every row gets as columns; the other measures are computed for the rules that need them.
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words() -> str:
    """SQL for the words in windows found twice or more, from the array of words."""
    at = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
    windows = f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({at}))"
    begins = (
        "transform(filter(transform(s, (x, i) -> CASE WHEN (i > 0 AND s[i - 1].h = x.h) OR (i + 1 < size(s) AND s[i + 1].h = x.h) THEN x.p END), p -> p IS NOT NULL), p -> p)"
    )
    covered = f"aggregate(transform(b, (p, i) -> CASE WHEN i + 1 < size(b) THEN least({WINDOW}, b[i + 1] - p) ELSE {WINDOW} END), 0L, (a, x) -> a + x)"
    found = _let("array_sort(transform(w, (x, i) -> named_struct('h', x, 'p', i)))", "s", _let(f"array_sort({begins})", "b", covered))
    checked = _let(windows, "w", f"CASE WHEN size(array_distinct(w)) = size(w) THEN 0L ELSE {found} END")
    return f"CASE WHEN size(@words) <= {WINDOW} THEN 0L ELSE {_let('transform(@words, x -> xxhash64(x))', 'h', checked)} END"


#: SQL of each measure over the working columns, whose prefix takes the place of @.
_SQL = {
    "n_words": "size(@words) + 0L",
    "word_chars": "length(array_join(@words, '')) + 0L",
    "n_symbols": "octet_length(@text) - octet_length(regexp_replace(@text, '[#*$%&|<>]+', '')) + 0L",
    "n_dup_lines": "size(@lines) - size(array_distinct(@lines)) + 0L",
    "n_text_lines": "size(@lines) + 0L",
    "n_stutters": _let("@words", "w", "size(filter(transform(w, (x, i) -> i > 0 AND x = w[i - 1]), b -> b))") + " + 0L",
    "n_repeat_words": _repeat_words(),
}
MEASURES = tuple(_SQL)


def _split(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """Adds the working columns; their prefix."""
    at = "_"
    while any(c.lower().startswith(at) for c in docs.columns):
        at += "_"
    whole = docs.withColumn(f"{at}text", F.coalesce(F.col(text), F.lit("")))
    parts = {
        f"{at}words": F.array_remove(F.split(f"{at}text", r"[\x20\x09-\x0D]+"), ""),
        f"{at}lines": F.filter(F.split(f"{at}text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    }
    return whole.withColumns(parts), at


def _condition(rule: str, have: tuple[str, ...], at: str) -> str:
    """The rule's SQL, in which each measure that isn't a column is computed where it stands."""
    for name in MEASURES:
        if name not in have and re.search(rf"\b{name}\b", rule):
            rule = _let(_SQL[name].replace("@", at), name, rule)
    return rule


def measure(docs: DataFrame, text: str = "text", measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Adds ``measures`` (long) of each whole text."""
    split, at = _split(docs.drop(*measures), text)
    return split.withColumns({m: F.expr(_SQL[m].replace("@", at)) for m in measures}).drop(f"{at}text", f"{at}words", f"{at}lines")


def _sample(docs: DataFrame, text: str, rows: int) -> DataFrame:
    some = docs.select(F.col(text).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    share = rows / max(docs.count(), 1)
    return (some.sample(share, 1) if share < 1 else some).limit(2 * rows)


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, text: str = "text", given: tuple[str, ...] = ()) -> list[Rule]:
    """The rules in the order in which the cascade should test them, from about ``rows`` rows.

    A rule's cost is the time that testing it takes on the sample, with all measures that it names
    and that aren't ``given`` as columns anyway. Rejections are those among the sample rows that
    the rules before leave. Ties keep the given order."""
    spark = docs.sparkSession
    drawn = measure(_sample(docs, text, rows), measures=given)
    sample, at = _split(spark.createDataFrame(drawn.collect(), drawn.schema), "text")
    tests = {r: F.coalesce(F.expr(_condition(r.rejects, given, at)), F.lit(False)) for r in rules}

    def seconds(test) -> float:
        took = []
        for _ in range(TIMINGS):
            began = time.perf_counter()
            sample.agg(F.count_if(test)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    base = seconds(F.col("text").isNull())
    cost = {r: max(seconds(tests[r]) - base, 1e-4) for r in rules}
    marks = sample.groupBy(*(tests[r].alias(f"r{i}") for i, r in enumerate(rules))).count().collect()
    order: list[Rule] = []
    left = list(enumerate(rules))
    while left:
        alive = [m for m in marks if not any(m[f"r{i}"] for i, r in enumerate(rules) if r in order)]
        gain = {i: sum(m["count"] for m in alive if m[f"r{i}"]) / cost[r] for i, r in left}
        best = max(left, key=lambda x: (gain[x[0]], -cost[x[1]] if gain[x[0]] == 0 else 0, -x[0]))
        order.append(best[1])
        left.remove(best)
    return order


def apply_cascade(docs: DataFrame, order: list[Rule], text: str = "text", given: tuple[str, ...] = ()) -> DataFrame:
    """Adds the measures ``given`` and failed_rule, the first rule in this order that rejects, else null."""
    split, at = _split(docs.drop("failed_rule", *given), text)
    measured = split.withColumns({m: F.expr(_SQL[m].replace("@", at)) for m in given})
    case = F.lit(None).cast("string")
    for r in reversed(order):
        case = F.when(F.expr(_condition(r.rejects, given, at)), F.lit(r.name)).otherwise(case)
    return measured.withColumn("failed_rule", case).drop(f"{at}text", f"{at}words", f"{at}lines")


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """BASE_MEASURES, base_failed, failed_rule and kept for every row of ``docs``."""
    order = plan_cascade(docs, rules, given=BASE_MEASURES)
    out = apply_cascade(docs.drop("base_failed", "kept"), order, given=BASE_MEASURES)
    base = F.expr(" OR ".join(f"({r.rejects})" for r in BASE_RULES))
    return out.withColumns({"base_failed": base, "kept": ~base & F.col("failed_rule").isNull()})


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cascade(docs).select("doc_id", *BASE_MEASURES, "base_failed", "kept")


QUERIES = {"op1_quality": op1_quality}
_ANY = " OR ".join(f"({r.rejects})" for r in RULES)
ORACLE_SQL = {
    "op1_quality": f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), win AS (
  SELECT rid, p, list_slice(ws, p, p + {WINDOW - 1}) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM w)
), rep AS (
  SELECT rid, p FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), cov AS (
  SELECT rid, count(DISTINCT p + k) AS n FROM rep, range({WINDOW}) AS r(k) GROUP BY rid
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_text_lines,
         len(list_filter(list_zip(ws[2:], ws[:len(ws) - 1]), lambda p: p[1] = p[2]))::BIGINT AS n_stutters, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)
)
SELECT doc_id, {", ".join(BASE_MEASURES)}, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed, NOT ({_ANY}) AS kept FROM m
"""
}

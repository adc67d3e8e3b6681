import re
import time

import numpy as np
import pytest

from foliospark.llm import op10_secrets as S
from foliospark.llm.automaton import as_rows, beginnings, compile_rules, longest, scan
from foliospark.session import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6 and m[1].isascii()]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return [(S.RULES[k].kind, a, b) for a, k, b in sorted(out)]


CASES = [
    "", None, "a" * 24, "é" * 9 + "f" * 25 + "g", "token=token: abcdefgh", "PassWord\"  :  'abc123 secret==x secret=:abcdef",
    "AKIAAKIA" + "A" * 20 + " AKIA123 api_key=abcdef apikey= 'zzzzzz' token", "tokentoken = " + "0123456789abcdef" * 4, "secret=" + "x" * 5,
    "passwd=" + "a" * 100_000, "token " + " " * 50_000 + "= abcdefg", "ſecret=abcdefgh toKen=abcdefgh",
]


def test_spans_equal_brute_force(spark):
    rows = [(i, t, "clash", None) for i, t in enumerate(CASES)] + [(3, CASES[3], "clash", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, x string")
    got = S.find_secrets(df)
    assert got.columns == ["doc_id", "text", "x", "spans"]
    for r in got.collect():
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in ("assign", "access", "hex")]
        assert base == brute(r["text"]), r["doc_id"]
    assert got.count() == len(rows)
    assert S.find_secrets(df.limit(0)).count() == 0


def test_whole_table_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    text = {r["doc_id"]: r["text"] for r in table(spark, d, "documents").collect()}
    rows = S.op10_secrets(spark, d).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = brute(text[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == S.digest(joined)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))


def test_redaction_takes_all_spans_out(spark):
    df = spark.createDataFrame([(1, "é token = abcdef0123456789abcdef01 end", 3), (2, None, 1), (3, "clean", 1)], "doc_id long, text string, n int")
    got = {r["doc_id"]: r["text"] for r in S.redact_secrets(df).collect()}
    assert got == {1: "é [SECRET] end", 2: None, 3: "clean"}


@pytest.mark.parametrize("lanes", [1, 3, 4096])
def test_scan_agrees_with_one_lane(lanes):
    a = compile_rules([("ab+c", False), ("[0-9]{3,5}", False), ("x(yz)*", True)])
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abc123xyzXYZ ", np.uint8), 5000)
    begins = np.array([0, 100, 101, 2500])
    state, want = 0, []
    for i, b in enumerate(data):
        state = a.table[0 if i in begins else state, a.klass[b]]
        want.append(state)
    assert (scan(a, data, begins, lanes) == want).all()


@pytest.mark.parametrize("pattern", ["a{2,3}b?", "(ab|a)(c|bcd)(d*)", "[^a-c]+z", r"\x41\d\.", "x|yy|"])
def test_longest_equals_longest_over_all_ends(pattern):
    a = as_rows(compile_rules([(pattern, False)], anchored=True))
    back = as_rows(compile_rules([(pattern, False)], backward=True))
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = bytes(rng.choice(list(b"abcdxyzA1."), rng.integers(0, 9)).astype(np.uint8))
        ends = [e for e in range(1, len(s) + 1) if re.fullmatch(pattern.encode(), s[:e])]
        assert longest(a, s, 0, len(s)) == max(ends, default=-1)
        begin = [i for i in range(len(s)) if any(re.fullmatch(pattern.encode(), s[i:e]) for e in range(i + 1, len(s) + 1))]
        assert beginnings(back, s, 0, len(s)) == (begin if not re.fullmatch(pattern.encode(), b"") else list(range(len(s))))


def test_bad_patterns_are_refused():
    for p in ("(a", "*a", "a)", "^a"):
        with pytest.raises(ValueError):
            compile_rules([(p, False)])


@pytest.mark.parametrize("unit,end", [("eyJ", "token=eyJa.b.c" + "d" * 40), ("token=", " secret=abcdefgh"), ("gh", "ghp_" + "a" * 40), ("AKIA ", "a" * 24), ("-----BEGIN ", "PRIVATE KEY-----"), ("0123456789abcdef", " token = abcdefgh")])
def test_hostile_texts_take_linear_time(unit, end):
    scanner = S.Scanner()

    def seconds(n):
        data = np.frombuffer((unit * (n // len(unit)) + end).encode(), np.uint8)
        began = time.perf_counter()
        spans = scanner.spans(data, np.array([0, len(data)]))
        assert spans
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(100_000), seconds(1_000_000)
    assert large < 4 and large < 40 * small + 0.2

"""The encoding queries over whole tables."""

from foliospark.plans.font_queries import QUERIES

D = "/root/testdata/sf0.001"


def test_upper_halves_are_shown(spark):
    got = {(r["encoding"], r["code"]): r["text"] for r in QUERIES["base_encodings"](spark, D).collect()}
    assert got["WinAnsiEncoding", 0x80] == "€" and got["MacRomanEncoding", 0x80] == "Ä" and got["WinAnsiEncoding", 0xFF] == "ÿ"
    assert [sum(e == name for e, _ in got) for name in ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding")] == [218, 223, 95]


def test_upper_codes_are_decoded(spark):
    got = {r["code"]: r["encoded"] for r in QUERIES["encoding_decode"](spark, D).collect()}
    upper = {c: t for c, t in got.items() if 126 < c < 256 and c % 10 and c % 15}
    assert upper and all(t == (bytes([c]).decode("cp1252") if c not in (0x7F, 0x81, 0x8D, 0x8F, 0x90, 0x9D) else None) for c, t in upper.items())

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from foliospark.functions import characters as ch
from foliospark.functions.bidi import is_rtl, levels_of, reorder
from foliospark.functions.lines import regions
from tests.helpers import line_texts, painted

LAM_ALEF = "ﻻ"


def row(text, x=0.0, y=0.0, advance=5.0, gap=0.0):
    return [(x + k * (advance + gap), y, advance, c) for k, c in enumerate(text)]


def test_reordering_comes_before_normalising():
    visual = "ﻻﻭ"  # painted left to right: lam-alef, waw; read: waw, lam-alef
    assert ch.finish(reorder(visual, True)) == "ولا"
    assert reorder(__import__("unicodedata").normalize("NFKC", visual), True) != "ولا"
    assert line_texts(painted(row(visual))) == ["ولا"]


def test_marks_do_not_split_words():
    xs = [(366.517, 7.2), (374.063, 3.3), (377.418, 13.2), (381.103, 0.0), (390.629, 4.0), (394.974, 5.0)]
    rows = [(x, 610.16, a, t) for (x, a), t in zip(xs, ["د", "ا", "م", "ﱠ", "ح", "م"], strict=True)]
    (text,) = line_texts(painted(rows))
    assert " " not in text and sum(c in "مد" for c in text) == 3 and any(0x64B <= ord(c) <= 0x65F for c in text)


def test_gaps_with_and_without_painted_spaces():
    loose = [(0, 0, 5, "A"), (5, 0, 5, "B"), (12.34, 0, 5, "C")]  # a gap of 0.18 em at 13
    assert line_texts(painted(loose, size=13)) == ["AB C"]
    spaced = [(0, 0, 5, "A"), (5, 0, 5, " "), (10, 0, 5, "B"), (17.34, 0, 5, "C")]
    assert line_texts(painted(spaced, size=13)) == ["A BC"]


def test_drift_is_measured_from_the_first_glyph():
    assert len(line_texts(painted([(0, 100, 5, "a"), (5, 101.5, 5, "b")], size=12))) == 1
    assert len(line_texts(painted([(0, 100, 5, "a"), (5, 101.5, 5, "b")], size=4))) == 2
    slow = [(5 * k, 100 - 2 * k, 5, "x") for k in range(4)]
    assert [len(t) for t in line_texts(painted(slow, size=12))] == [2, 2]
    line_texts(painted([(0, float("nan"), 5, "a"), (5, 10, 5, "b")]))


def test_lost_and_declared_empty_glyphs():
    p = painted([(0, 0, 5, "a"), (5, 0, 5, None), (10, 0, 5, "�"), (15, 0, 5, "b")])
    (line,) = p.lines(np.arange(4))
    assert line.text == "a�b" and line.unresolved == 1 and line.glyphs == 4 and line.rate == 0.75


def test_several_digits_in_a_glyph_keep_their_order():
    assert line_texts(painted([(0, 0, 5, "ب"), (5, 0, 9, "٢٠"), (14, 0, 5, "ا")])) == ["ا٢٠ب"]
    assert line_texts(painted([(0, 0, 9, "لا"), (9, 0, 5, "و")])) == ["ولا"]


@pytest.mark.parametrize(("text", "want"), [("20١7", "2017"), ("١٢٣6", "١٢٣٦"), ("12 ٣٤", "12 ٣٤"), ("۱۲3", "۱۲۳"), ("1٢", "12"), ("", ""), ("٢۳", "٢٣")])
def test_digit_runs(text, want):
    assert ch.unify_digits(text) == want


@pytest.mark.parametrize(("text", "want"), [("بــب", "بب"), ("بــ", "بــ"), ("ـب", "ـب"), ("aـb", "aـb"), ("ب ـب", "ب ـب")])
def test_bars(text, want):
    assert ch.drop_joins(text) == want


def test_hamza_overlays():
    assert ch.composed_base("إ") == "ا" and ch.composed_base("ب") is None and ch.composed_base("ab") is None
    assert ch.merge_composed("لا", "ا", "إ") == "لإ"
    assert ch.merge_composed("اا", "ا", "إ") is None and ch.merge_composed("إ", "ا", "إ") == "إ"
    rows = [(0, 0, 5, "ب"), (6, 0, 0, "إ"), (5, 0, 5, "ا")]
    assert line_texts(painted(rows)) == ["إب"]


def test_overlaid_spaces_go_and_tidying():
    assert line_texts(painted([(0, 0, 8, "a"), (3, 0, 0, " "), (8, 0, 5, "b")])) == ["ab"]
    assert ch.tidy("  a　\tb\n ") == "a b" and ch.drop_mark_bases("ب َ") == "بَ"
    assert ch.is_mark(" َ") and ch.is_mark("ﹰ") and not ch.is_mark("") and not ch.is_mark("aَ")


def test_stated_text_replaces_glyphs():
    rows = row("xyz")
    assert line_texts(painted(rows, spans=[(0, 2, "fi")])) == ["fiz"]
    assert line_texts(painted(rows, spans=[(0, 2, "one"), (1, 9, "two")])) == ["onetwo"]
    logical = [(10 - 5 * k, 0, 5, c) for k, c in enumerate("ابج")]  # painted from the right
    for stated in ("ابج", "جبا"):
        assert line_texts(painted(logical, spans=[(0, 3, stated)])) == ["ابج"]


def test_dominant_style_box_and_baseline():
    p = painted(row("abc", x=10, y=100), size=8)
    (line,) = p.lines(np.arange(3))
    assert line.box == (10, 98, 25, 106) and line.baseline == 100 and line.style.size == 8 and not line.rtl


def test_regions_read_columns_from_the_right_side():
    left, right = [], []
    for k in range(8):
        left += row("abcdefghijk", x=0, y=100 - 12 * k)
        right += row("ابتثجحخدذرز", x=150, y=100 - 12 * k)
    got = regions(painted(left + right), [])
    assert len(got) == 2 and got[0].lines[0].rtl and not got[1].lines[0].rtl
    got = regions(painted(left), [(0.0, 300.0, 50.0, 350.0)])
    assert [r.extras for r in got] == [[0], []]
    stated = regions(painted(row("ab") + row("cd", y=50)), [], [[(2, 4)], [(0, 2)], []])
    assert [r.lines[0].text for r in stated] == ["cd", "ab"]


@pytest.mark.parametrize(("text", "base", "levels"), [
    ("abc", 0, [0, 0, 0]), ("אבג", 0, [1, 1, 1]), ("אב 12", 1, [1, 1, 1, 2, 2]), ("ا1", 1, [1, 2]), ("a (א) b", 0, [0, 0, 0, 1, 0, 0, 0]),
    ("א (a) ב", 1, [1, 1, 1, 2, 1, 1, 1]), ("1,2", 1, [2, 2, 2]), ("‫a‬", 0, [0, 2, 0]), ("⁧a⁩b", 0, [0, 2, 0, 0]), ("a ", 1, [2, 1]), ("אָ1", 0, [1, 1, 2]),
])
def test_levels(text, base, levels):
    assert levels_of(text, base) == levels


@given(st.text(alphabet="ab אבا٢1,.()َ", max_size=12), st.booleans())
def test_reordering_keeps_all_characters(text, rtl):
    out = reorder(text, rtl)
    assert sorted(out) == sorted(text)
    assert rtl or is_rtl(text) or "٢" in text or out == text

import math

import numpy as np
import pytest

from foliospark.functions.interpreter import Interpreter, quarter_turns, rule_of, text_string
from foliospark.sources.pdf_pages import RawForm
from tests.helpers import interpret


def test_places_codes_along_the_pen():
    g = interpret(b"BT /F1 12 Tf 100 200 Td (AB) Tj ET")
    assert list(zip(g.x, g.y, strict=True)) == [(100, 200), (106, 200)]
    assert g.code.tolist() == [65, 66] and (g.size == 12).all() and (g.advance == 6).all()


def test_size_comes_from_the_whole_matrix():
    g = interpret(b"BT /F1 1 Tf 20.5559 0 0 20.5559 10 10 Tm (A) Tj ET")
    assert g.size[0] == pytest.approx(20.5559, abs=1e-5)


def test_composite_fonts_take_two_bytes():
    g = interpret(b"BT /F1 10 Tf <011A015800> Tj ET", "Type0")
    assert g.code.tolist() == [0x11A, 0x158]


def test_restore_brings_text_parameters_back():
    g = interpret(b"BT /F1 10 Tf q 50 Tz 4 Ts 3 Tr (A) Tj Q (A) Tj ET")
    assert [g.styles[s].mode for s in g.style] == [3, 0]
    assert g.advance.tolist() == [2.5, 5.0] and g.y.tolist() == [4.0, 0.0]


def test_spacing_moves_the_pen_but_is_not_ink():
    g = interpret(b"BT /F1 10 Tf -7.5 Tc (AAA) Tj ET")
    assert (g.advance == 5).all() and g.x.tolist() == [0.0, -2.5, -5.0]
    g = interpret(b"BT /F1 10 Tf 3 Tw (A A) Tj ET")
    assert g.x.tolist() == [0.0, 5.0, 13.0]
    g = interpret(b"BT /F1 10 Tf [(A) -500 (B) 200 (C)] TJ ET")
    assert g.x.tolist() == [0.0, 10.0, 13.0]


def test_line_operators():
    g = interpret(b"BT /F1 10 Tf 14 TL 5 100 Td (A) Tj (B) ' 0 -20 TD (C) Tj T* (D) Tj 2 1 (E) \" ET")
    assert g.y.tolist() == [100, 86, 66, 46, 26]


def test_tracking_never_gives_negative_ink():
    g = interpret(b"BT /F1 10 Tf -0.75 Tc (abc) Tj ET", widths=[-300.0] * 256)
    assert (g.advance >= 0).all()


def test_colors_follow_their_spaces():
    g = interpret(b"BT /F1 9 Tf 1 0 0 rg (A) Tj /DeviceCMYK cs 0 0 0 1 sc (B) Tj 1 2 sc (C) Tj 1 Tr .5 G (D) Tj ET")
    assert [g.styles[s].color for s in g.style] == [("rgb", 1.0, 0.0, 0.0), ("cmyk", 0.0, 0.0, 0.0, 1.0), ("unknown",), ("gray", 0.5)]


def test_unbalanced_stacks_are_ignored():
    g = interpret(b"Q Q " + b"q " * 100 + b"BT /F1 10 Tf (A) Tj ET EMC EMC")
    assert len(g) == 1


@pytest.mark.parametrize(("source", "rules"), [
    (b"0 0 100 1 re f", [(0, 0.5, 100, 0.5)]), (b"0 0 100 1 re W n", []), (b"0 0 m 100 0 l S", [(0, 0, 100, 0)]), (b"0 0 m 100 40 l S", []),
    (b"0 0 2 50 re f", [(1, 0, 1, 50)]), (b"0 0 3 3 re f", []), (b"2 0 0 2 10 10 cm 0 0 m 0 20 l S", [(10, 10, 10, 50)]),
    (b"0 0 m 10 0 l 10 10 l h s", [(0, 0, 10, 0), (10, 0, 10, 10)]), (b"0 0 m 1 1 2 2 50 0 c 90 0 l S", [(50, 0, 90, 0)]),
])
def test_painted_rules(source, rules):
    assert interpret(source).rules == rules


def test_rule_ends():
    assert rule_of(False, 0, 0, 3.9, 0) is None and rule_of(False, 0, 0, 4, 0.5) is not None and rule_of(True, 0, 0, 10, 3.5) is None


def test_marked_content_and_its_text():
    g = interpret(b"BT /F1 9 Tf /P <</MCID 3>> BDC (AB) Tj /Span <</ActualText <FEFF0627>>> BDC (C) Tj EMC EMC /P <</MCID 4>> BDC EMC ET")
    assert [tuple(s) for s in g.spans] == [(2, 3, "ا", None), (0, 3, None, 3)]
    assert text_string(b"\xe9") == "é" and text_string(b"\xfe\xff\x06\x27\x06") == "ا"


def test_forms_are_entered_once_each_level_and_bounded():
    form = RawForm("Fm1", b"BT /F1 10 Tf (A) Tj ET /Fm1 Do", (1, 0, 0, 1, 50, 60))
    g = Interpreter({}, [form]).page(b"q 2 0 0 2 0 0 cm /Fm1 Do Q BT /F1 5 Tf (B) Tj ET")
    assert [u[0] for u in g.uses] == ["Fm1", "Fm1/Fm1"] and (g.x[0], g.y[0]) == (100, 120) and len(g) == 2
    assert g.styles[g.style[0]].font == "Fm1/F1" and g.uses[0][1][:2] == (2, 0)


def test_inline_images_and_garbage_are_passed_over():
    g = interpret(b"BI /W 2 /H 1 ID \x00(Tj ET EI BT /F1 10 Tf (A\\051\\)) Tj ET ] >> ) nonsense")
    assert bytes(g.code.tolist()) == b"A))"


@pytest.mark.parametrize("degrees", [0, 90, 180, 270, 44, 46, -44, -46, 359])
def test_quarter_turns(degrees):
    a = math.radians(degrees)
    assert quarter_turns(math.cos(a), math.sin(a)) == round(degrees / 90) % 4


def test_upward_text_runs_along_y():
    g = interpret(b"BT /F1 10 Tf 0 1 -1 0 30 40 Tm (AB) Tj ET")
    assert g.turn.tolist() == [1, 1] and g.along.tolist() == [40, 45] and np.allclose(g.across, -30)

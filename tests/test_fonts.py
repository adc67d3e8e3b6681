import struct

import numpy as np
import pytest

from foliospark.functions.cff import glyph_names
from foliospark.functions.cmap import CMap, parse_cmap
from foliospark.functions.font_text import Font, letter_confusion, map_is_wrong, resolves_ambiguity, same_meaning
from foliospark.functions.glyph_names import BASE, Encoding, glyph_name_text
from foliospark.functions.truetype import glyph_characters
from foliospark.sources.pdf_pages import RawFont, cid_width_ranges, flatten_differences
from foliospark.sources.pdf_syntax import Name

CMAP = b"""/CIDInit /ProcSet findresource begin % comment <0001>
(skipped \\) <0002> (nested)) pop << /Registry (Adobe) >>
1 begincodespacerange <0000> <FFFF> endcodespacerange
3 beginbfchar <0003> <0020> <0113> <0627> <01AE> <0651064B> endbfchar
3 beginbfrange <0100> <0102> <0041> <0200> <0203> [<0061> <0062>] <0202> <0203> <0078> endbfrange"""


def test_cmaps():
    m = parse_cmap(CMAP)
    assert [m.get(c) for c in (3, 0x113, 0x1AE, 0x100, 0x102, 0x103)] == [" ", "\u0627", "\u0651\u064b", "A", "C", None]
    assert m.get(0x201) == "b" and m.get(0x202) == "x" and m.code_bytes == 2 and len(m) == 3 + 3 + 4 + 2
    assert len(parse_cmap(b"beginbfrange <0000> <FFFF> <0000> endbfrange")) == 65_536
    m = parse_cmap(b"beginbfchar <41> <0042> <41> <0043> endbfchar beginbfrange <41> <41> <0044> endbfrange")
    assert m.get(0x41) == "C"
    assert parse_cmap(b"beginbfchar <1 <2> junk <03> <0041> endbfchar").get(3) == "A" and len(parse_cmap(b"")) == 0
    assert parse_cmap(b"beginbfchar <01> <D800> endbfchar").get(1) == "�"


def test_base_encodings():
    assert BASE["WinAnsiEncoding"].get(0x81) is None and BASE["WinAnsiEncoding"][0x80] == "€" and BASE["WinAnsiEncoding"][0xE9] == "é"
    assert BASE["StandardEncoding"][0x27] == "’" and BASE["StandardEncoding"].get(0xE9) is None and BASE["MacRomanEncoding"][0x8E] == "é"
    e = Encoding("WinAnsiEncoding", [(65, "nosuch"), (66, "alpha"), (67, "uni0628")])
    assert e.get(65) is None and e.get(67) == "ب" and e.get(68) == "D" and e.get(256) is None and len(Encoding(None, [])) == 0


@pytest.mark.parametrize(("name", "text"), [
    ("A", "A"), ("eacute", "é"), ("uni0627", "ا"), ("uni06440627", "لا"), ("uni0644_uni0627.liga", "لا"), ("u1F600", "😀"), ("hyphenminus", "-"), ("f_i.alt", "fi"), ("uni0627_nosuch", None),
    ("uniD800", "\ufffd"), ("uniD83DuniDE00", "😀"), ("uniD83DDE00", "😀"), ("alpha", "α"), ("Alphatonos", "Ά"), ("iotadieresistonos", "ΐ"), ("Omega", "Ω"), ("Deltagreek", "Δ"), ("lambda", "λ"),
    ("afii10017", "А"), ("afii10049", "Я"), ("afii10071", "ё"), ("afii57664", "א"), ("acyrillic", "а"), ("Becyrillic", "Б"), ("alef", "א"), ("finalkafhebrew", "ך"), ("behfinalarabic", "ﺐ"), ("alefhamzaabovearabic", "أ"),
    ("ahiragana", "あ"), ("Aogonek", "Ą"), ("Gcommaaccent", "Ģ"), ("scommaaccent", "ș"), ("Odieresis", "Ö"), ("summation", "∑"), ("mu", "µ"), ("g42", None), ("cid1234", None), ("uni06", None), (".notdef", None), ("uni062", None), ("u110000", None), ("afii57410", "آ"), ("", None), ("comma", ","), ("uni0627uni0628", "اب"),
])
def test_glyph_names(name, text):
    assert glyph_name_text(name) == text


def font(**kw):
    return Font(RawFont(**({"name": "F", "subtype": "Type1"} | kw)))


def cmap_of(pairs):
    return b"beginbfchar " + b" ".join(b"<%04X> <%s>" % (c, t.encode("utf-16-be").hex().encode()) for c, t in pairs) + b" endbfchar"


def test_the_fonts_names_overrule_a_wrong_separator():
    f = font(to_unicode=cmap_of([(0xA1, "."), (0x41, "B")]), differences=[(0xA1, "uni066B"), (0x41, "A")])
    assert f.decode(0xA1) == "٫" and f.decode(0x41) == "B"


def truetype(pairs, outlines=None):
    """A program with a format 4 cmap of (character, glyph) and, if given, outlines by glyph."""
    segs = [*sorted((ord(c), ord(c), g) for c, g in pairs), (0xFFFF, 0xFFFF, 0)]
    n = len(segs)
    body = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + b"".join(struct.pack(">H", s[1]) for s in segs) + b"\0\0" + b"".join(struct.pack(">H", s[0]) for s in segs)
    body += b"".join(struct.pack(">H", (s[2] - s[0]) & 0xFFFF) for s in segs) + b"\0\0" * n
    tables = {b"cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + body}
    if outlines:
        loca, glyf = [0], b""
        for g in range(max(outlines) + 1):
            glyf += struct.pack(">hhhhh", *outlines[g]) if g in outlines else b""
            loca.append(len(glyf) // 2)
        tables |= {b"head": bytes(50) + b"\0\0" + bytes(2), b"loca": b"".join(struct.pack(">H", x) for x in loca), b"glyf": glyf, b"maxp": struct.pack(">IH", 0x10000, max(outlines) + 1)}
    out, at = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), 12 + 16 * len(tables)
    for tag, t in tables.items():
        out += struct.pack(">4sIII", tag, 0, at, len(t))
        at += len(t)
    return out + b"".join(tables.values())


def test_truetype_characters():
    got = glyph_characters(truetype([("ا", 3), ("ﺍ", 3), ("b", 4), ("a", 4), ("\ue000", 5), ("z", 0)]))
    assert got == {3: "ﺍ", 4: "a"}
    assert glyph_characters(b"") == {} and glyph_characters(b"\0" * 40) == {}


def test_stretched_bars_are_bars():
    shape = (1, 0, -10, 300, 50)
    got = glyph_characters(truetype([("ـ", 1), ("x", 3)], {1: shape, 2: (1, 0, -10, 900, 50), 3: shape, 4: (1, 0, -10, 300, 51)}))
    assert got == {1: "ـ", 2: "ـ", 3: "x"}


ALPHABET = "ابةتثجحخدذ"


def composite(shift):
    program = truetype([(c, 10 + k) for k, c in enumerate(ALPHABET)])
    mapped = [(10 + k, ALPHABET[(k + shift) % 10]) for k in range(10)]
    return font(subtype="Type0", to_unicode=cmap_of(mapped), truetype=program)


def test_a_map_that_contradicts_the_font_is_overruled():
    assert not composite(0).wrong_map and composite(0).decode(11) == "ب"
    assert composite(1).wrong_map and composite(1).decode(11) == "ب"
    few = {k: c for k, c in enumerate(ALPHABET[:7])}
    assert not map_is_wrong(CMap({k: "z" for k in few}), few)


def test_meanings():
    assert same_meaning("ي", "ى") and same_meaning("1", "١") and same_meaning(",", "٬") and not same_meaning("a", "b") and same_meaning("ﺍ", "ا")
    assert letter_confusion(" ", "ب") and letter_confusion("ت", "ب") and not letter_confusion("a", "ب")
    assert resolves_ambiguity("ی", "ي") and resolves_ambiguity("لا", "ﻻ") and not resolves_ambiguity("ب", "ت")


def test_cid_to_gid_and_widths():
    table = np.array([0, 0, 7], ">u2").tobytes()
    f = font(subtype="Type0", truetype=truetype([("q", 7)]), cid_to_gid=table, cid_widths=[(5, 9, 300.0), (7, 7, 900.0)], default_width=800.0)
    assert f.decode(2) == "q" and f.decode(1) is None and f.decode(3) is None
    assert f.widths(np.array([5, 7, 10])).tolist() == [0.3, 0.3, 0.8]
    g = font(first_char=65, widths=[100.0, 200.0], missing_width=50.0)
    assert g.widths(np.array([64, 65, 66, 67])).tolist() == [0.05, 0.1, 0.2, 0.05]
    assert not g.resolvable and font(base_encoding="WinAnsiEncoding").resolvable


def test_width_arrays_and_differences():
    assert cid_width_ranges([1, [10, 20], 5, 7, 30, 9]) == [(1, 1, 10.0), (2, 2, 20.0), (5, 7, 30.0)]
    assert cid_width_ranges([1, [1], Name("x"), 4]) == [(1, 1, 1.0)] and cid_width_ranges([1 << 31, [1] * 2]) == [(1 << 31, 1 << 31, 1.0), ((1 << 31) + 1, (1 << 31) + 1, 1.0)]
    assert flatten_differences([254, Name("a"), Name("b"), Name("c"), 1, Name("d")]) == [(254, "a"), (255, "b"), (1, "d")]


def cff(names, encoding=None, ros=False):
    def index(items):
        if not items:
            return b"\0\0"
        at, offs = 1, [1]
        for x in items:
            at += len(x)
            offs.append(at)
        return struct.pack(">HB", len(items), 2) + b"".join(struct.pack(">H", o) for o in offs) + b"".join(items)

    num = lambda v: b"\x1d" + struct.pack(">i", v)
    strings = index([n.encode() for n in names])
    places = (0, 0, 0)
    for _ in range(2):  # the second time with the places that the first found
        charset, codes, chars = places
        top = (num(0) * 3 + b"\x0c\x1e" if ros else b"") + num(charset) + b"\x0f" + num(codes) + b"\x10" + num(chars) + b"\x11"
        head = b"\1\0\4\1" + index([b"F"]) + index([top]) + strings + index([])
        cs = b"\0" + b"".join(struct.pack(">H", 391 + k) for k in range(len(names)))
        enc = bytes([0, len(encoding or [])]) + bytes(encoding or [])
        places = (len(head), len(head) + len(cs), len(head) + len(cs) + len(enc))
    return head + cs + enc + index([b"\x0e"] * (len(names) + 1))


def test_cff_names():
    program = cff(["uni0627", "custom"], [65, 66])
    assert glyph_names(program) == {65: "uni0627", 66: "custom"}
    assert font(cff=program).decode(65) == "ا" and font(cff=program).decode(66) is None
    assert glyph_names(cff(["a"], [65], ros=True)) == {} and glyph_names(b"\1\0\4") == {} and glyph_names(b"") == {}

import zlib

import pytest

from foliospark.functions.page import page_inputs, process
from foliospark.sources.pdf_file import PdfFile
from foliospark.sources.pdf_filters import ascii85, ascii_hex, decode, inflate, lzw, run_length, undo_predictor
from foliospark.sources.pdf_pages import A4, PdfPages
from foliospark.sources.pdf_syntax import Name, PdfError, Reader, Ref
from foliospark.synth import PdfWriter, document_pdf, literal, simple_pdf

FONT = "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding/FirstChar 0/Widths[" + "500 " * 256 + "]>>"


def texts(data):
    return [[x.text for x in process(p).lines] for p in page_inputs(data)]


def test_objects():
    r = Reader(b"<</A 1/B[1 0 R -2.5 (a(b)\\)\\101\\\n)]/C#20D<41 4>/E true /F null>>")
    assert r.next() == {"A": 1, "B": [Ref(1, 0), -2.5, b"a(b))A"], "C D": b"A@", "E": True, "F": None}
    assert isinstance(Reader(b"/N").next(), Name) and Reader(b"0.1").next() != 0.1 and abs(Reader(b"0.1").next() - 0.1) < 1e-8


def test_filters():
    assert inflate(zlib.compress(b"abc" * 100)[:-4]) == b"abc" * 100 and inflate(b"junk") == b""
    assert ascii_hex(b"41 4>") == b"A@" and ascii85(b"<~87cURD]~>") == b"Hello"[:5] and run_length(b"\x02abc\xfed\x80") == b"abcddd"
    assert lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = b"\x02\x01\x02\x03\x02\x01\x01\x01\x01\x05\x01\x01\x04\x01\x01\x01\x03\x02\x02\x02"
    assert undo_predictor(rows, 15, 1, 8, 3) == bytes([1, 2, 3, 2, 3, 4, 5, 6, 7, 6, 7, 8, 5, 8, 10])
    assert undo_predictor(b"\1\1\1\2\2\2", 2, 1, 8, 3) == bytes([1, 2, 3, 2, 4, 6])
    assert decode(b"\xff\xd8", ["DCTDecode"], [{}]) == b"\xff\xd8"


def test_a_plain_file():
    data = simple_pdf([{"content": b"BT /F1 12 Tf 10 100 Td (Hi) Tj ET"}, {"content": b"", "rotate": -90, "box": (0, 0, 100, 50)}, {"content": b"", "rotate": 45, "box": (100, 50, 0, 0)}])
    p = PdfPages(data)
    assert [i.rotation for i in p.pages] == [0, 270, 0] and p.pages[1].box == p.pages[2].box == (0, 0, 100, 50)
    assert texts(data) == [["Hi"], [], []]


def test_attributes_are_inherited_and_default():
    w = PdfWriter()
    tree = w.reserve()
    font = w.add(FONT)
    content = w.stream(b"BT /F1 12 Tf (in) Tj ET")
    page = w.add(f"<</Type/Page/Parent {tree} 0 R/Contents[{content} 0 R {content} 0 R]>>")
    mid = w.add(f"<</Type/Pages/Parent {tree} 0 R/Kids[{page} 0 R]/Count 1>>")
    w.set(tree, f"<</Type/Pages/Kids[{mid} 0 R]/Count 1/Resources<</Font<</F1 {font} 0 R>>>>>>")
    data = w.file(w.add(f"<</Type/Catalog/Pages {tree} 0 R>>"))
    assert PdfPages(data).pages[0].box == A4
    assert texts(data) == [["iinn"]]  # both streams paint at the same place


def packed():
    """A file with an object stream and a cross-reference stream with a predictor."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 9]/Contents 5 0 R/Resources<</Font<</F1 4 0 R>>>>>>", 4: FONT.encode()}
    head, body = b"", b""
    for n, o in objects.items():
        head += b"%d %d " % (n, len(body))
        body += o + b" "
    out = bytearray(b"%PDF-1.5\n")
    places = {}

    def put(number, info, data):
        places[number] = len(out)
        data = zlib.compress(data)
        out.extend(b"%d 0 obj\n<<%s/Filter/FlateDecode/Length %d>>stream\n" % (number, info, len(data)) + data + b"\nendstream\nendobj\n")

    put(5, b"", b"BT /F1 12 Tf (packed) Tj ET")
    put(6, b"/Type/ObjStm/N %d/First %d" % (len(objects), len(head)), head + body)
    at = len(out)
    rows = [(0, 0, 255), *((2, 6, k) for k in range(4)), (1, places[5], 0), (1, places[6], 0), (1, at, 0)]
    raw = [bytes([t]) + v.to_bytes(2, "big") + bytes([x]) for t, v, x in rows]
    up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, q, strict=True)) for r, q in zip(raw, [bytes(4), *raw[:-1]], strict=True))
    put(7, b"/Type/XRef/Size 8/W[1 2 1]/Root 1 0 R/DecodeParms<</Predictor 12/Columns 4>>", up)
    return bytes(out) + b"startxref\n%d\n%%%%EOF" % at


def test_object_and_cross_reference_streams():
    assert not PdfFile(packed()).repaired and texts(packed()) == [["packed"]]


def test_broken_tables_are_repaired():
    good = simple_pdf([{"content": b"BT /F1 12 Tf (ok) Tj ET"}])
    for data in (good.replace(b"startxref", b"startxxxx"), good[: good.rindex(b"xref\n0")], b"%PDF-1.4\n" + b"x" * 500 + good[9:], packed().replace(b"startxref", b"stopxref ")):
        assert PdfFile(data).repaired or data is good
        assert texts(data) in ([["ok"]], [["packed"]])


@pytest.mark.parametrize("data", [b"", b"not a pdf", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2", simple_pdf([{"content": b""}]).replace(b"/Root", b"/Encrypt 9 0 R/Root")])
def test_unreadable_files_say_so(data):
    with pytest.raises(PdfError):
        list(page_inputs(data))


def test_forms_images_and_their_resources():
    w = PdfWriter()
    catalog, tree = w.reserve(), w.reserve()
    font = w.add(FONT)
    image = w.stream(bytes(3), "/Type/XObject/Subtype/Image/Width 1/Height 1/BitsPerComponent 8/ColorSpace/DeviceRGB")
    inner = w.stream(b"BT /G1 10 Tf 5 5 Td (inner) Tj ET", f"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 0 50]/Resources<</Font<</G1 {font} 0 R>>>>")
    palette = w.stream(b"\0\1", f"/Type/XObject/Subtype/Image/Width 2/Height 1/BitsPerComponent 8/ColorSpace[/Indexed/DeviceRGB 1 <{'00' * 6}>]")
    content = w.stream(b"q 20 0 0 20 100 100 cm /Im0 Do Q /Fm1 Do BT /F1 10 Tf (outer) Tj ET")
    page = w.add(f"<</Type/Page/Parent {tree} 0 R/MediaBox[0 0 200 200]/Contents {content} 0 R/Resources<</Font<</F1 {font} 0 R>>/XObject<</Im0 {image} 0 R/Fm1 {inner} 0 R/Fm2 {inner} 0 R/Im1 {palette} 0 R>>>>>>")
    w.set(tree, f"<</Type/Pages/Kids[{page} 0 R]/Count 1>>")
    w.set(catalog, f"<</Type/Catalog/Pages {tree} 0 R>>")
    (p,) = page_inputs(w.file(catalog))
    assert [f.name for f in p.fonts] == ["F1", "Fm1/G1"] and [f.name for f in p.forms] == ["Fm1"] and [i.space for i in p.images] == ["rgb", "indexed"]
    r = process(p)
    assert [x.text for x in r.lines] == ["inner", "outer"] and [(b.kind, b.box) for b in r.blocks][-1] == ("image", None)
    assert (100, 100, 120, 120) in [b.box for b in r.blocks]


def tagged(share_tagged=True):
    """Two pages; three elements in an order of their own, the last on the second page."""
    w = PdfWriter()
    font = w.add(FONT)
    root, body, one, two, tree = (w.reserve() for _ in range(5))
    line = lambda mark, y, text: b"/Span <</MCID %d>> BDC 1 0 0 1 33 %d Tm (%s) Tj EMC " % (mark, y, text)
    first = b"BT /F1 9 Tf " + line(4, 610, b"green hills") + line(2, 455, b"far away") + (b"" if share_tagged else b"1 0 0 1 33 300 Tm (no tag holds these many words) Tj ") + b"ET"
    second = b"BT /F1 9 Tf " + line(4, 77, b"the end") + b"ET"
    for page, content in ((one, first), (two, second)):
        w.set(page, f"<</Type/Page/Parent {tree} 0 R/MediaBox[0 0 333 700]/Contents {w.stream(content)} 0 R/Resources<</Font<</F1 {font} 0 R>>>>>>")
    kids = [
        w.add(f"<</S/Verse/P {body} 0 R/Pg {one} 0 R/K 2>>"),
        w.add(f"<</S/H2/P {body} 0 R/K[<</Type/MCR/Pg {one} 0 R/MCID 4>>]/Pg {one} 0 R>>"),
        w.add(f"<</S/Verse/P {body} 0 R/Pg {two} 0 R/K[4]>>"),
    ]
    w.set(body, f"<</S/Part/P {root} 0 R/K[{' '.join(f'{k} 0 R' for k in [*kids, kids[0]])}]>>")
    w.set(root, f"<</Type/StructTreeRoot/K {body} 0 R/RoleMap<</Verse/P>>>>")
    w.set(tree, f"<</Type/Pages/Kids[{one} 0 R {two} 0 R]/Count 2>>")
    return w.file(w.add(f"<</Type/Catalog/MarkInfo<</Marked true>>/StructTreeRoot {root} 0 R/Pages {tree} 0 R>>"))


def test_tags_state_the_order():
    pdf = PdfPages(tagged())
    marked, elements = pdf.structure()
    assert marked and [e.tag for e in elements] == ["Part", "P", "H2", "P"] and [e.mcids for e in elements] == [[], [2], [4], [4]]
    pages = list(map(process, page_inputs(tagged())))
    assert all(r.tagged for r in pages) and [[x.text for x in r.lines] for r in pages] == [["far away", "green hills"], ["the end"]]
    loose, whole = map(process, page_inputs(tagged(share_tagged=False)))
    assert not loose.tagged and whole.tagged and [x.text for x in loose.lines] == ["green hills", "far away", "no tag holds these many words"]


def test_only_wanted_pages_are_read():
    data = simple_pdf([{"content": b"BT /F1 12 Tf (%d) Tj ET" % k} for k in range(5)])
    assert [p.info.number for p in page_inputs(data, {2, 4, 9})] == [2, 4]


def test_literals_and_documents():
    assert Reader(literal(b"a(\\)\r")).next() == b"a(\\)\r"
    assert texts(document_pdf(1, "one\n\n two  (x) \\ \n")) == [["one", "two (x) \\"]]
    assert texts(document_pdf(10, "hidden")) == [[]] and texts(document_pdf(22, "ab\ncd")) == [["ab", "c�"]]

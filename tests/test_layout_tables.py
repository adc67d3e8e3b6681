import numpy as np
import pytest

from foliospark.functions.blocks import assemble, place_pictures, placement
from foliospark.functions.grids import Grid, Table, borderless_grids, fill_from_lines, merged, ruled_grids
from foliospark.functions.interpreter import BLACK, PageGlyphs, Style
from foliospark.functions.layout import boxes, segment, widest_gap
from foliospark.functions.lines import Line, PlacedGlyphs
from foliospark.functions.pictures import Picture, cmyk_to_rgb, picture
from foliospark.functions.structure import stated_order
from foliospark.sources.pdf_pages import Element, RawImage
from foliospark.functions.interpreter import Span


def card(x, y, width=110.0, lines=2, step=14.0, size=11.0):
    return [(x, x + width, y - k * step, y - k * step + size, size) for k in range(lines)]


def counts(items, rtl=False):
    return [sorted(r.tolist()) for r in segment(boxes(items), rtl)]


def test_one_column_stays_whole():
    assert counts(card(0, 100, lines=4)) == [[0, 1, 2, 3]]


def test_three_cards_from_the_right():
    items = card(100, 100) + card(250, 100) + card(400, 100)
    assert counts(items, rtl=True) == [[4, 5], [2, 3], [0, 1]] and counts(items) == [[0, 1], [2, 3], [4, 5]]


def test_a_heading_is_cut_away_first():
    items = [(0, 400, 150, 161, 11.0), *card(0, 100, 150, 4), *card(250, 100, 150, 4)]
    assert counts(items) == [[0], [1, 2, 3, 4], [5, 6, 7, 8]]


def test_tall_regions_need_narrower_gutters():
    tall = card(0, 400, 150, 20) + card(164, 400, 150, 20)
    short = card(0, 400, 150, 3) + card(164, 400, 150, 3)
    assert len(counts(tall)) == 2 and len(counts(short)) == 1


def test_a_narrow_strip_is_no_column():
    strip = card(0, 400, 20, 20) + card(60, 400, 200, 20)
    assert len(counts(strip)) == 1


def test_widest_gap_is_the_first_of_equals():
    low, high = np.array([0.0, 10, 20, 30]), np.array([5.0, 15, 25, 35])
    assert widest_gap(low, high, 0) == (5.0, 5.0) and widest_gap(low, high, 16) == None and widest_gap(low[:1], high[:1], 0) is None  # noqa: E711
    assert segment(boxes([]), False) == []


def grid_rules(rows, cols, x=0.0, y=0.0, skip=()):
    flat = [(x, y + 20 * r, x + 100 * cols, y + 20 * r) for r in range(rows + 1)]
    up = [(x + 100 * c, y, x + 100 * c, y + 20 * rows) for c in range(cols + 1) if c not in skip]
    return flat + up


def test_ruled_grids():
    (g,) = ruled_grids(grid_rules(3, 4))
    assert len(g.ys) == 4 and len(g.xs) == 5 and g.confidence == 1.0 and g.box == (0, 0, 400, 60)
    assert len(ruled_grids(grid_rules(3, 4) + [(0, -400, 400, -400)])) == 1
    assert len(ruled_grids(grid_rules(3, 4) + grid_rules(3, 4, y=400))) == 2
    (g,) = ruled_grids(grid_rules(3, 4, skip=(2,)) + [(200, 0, 200, 30)])
    assert 0.7 < g.confidence < 1 and ruled_grids(grid_rules(1, 4)) == [] and ruled_grids([]) == []


def test_rules_merge_with_the_first_of_a_run():
    at = np.array([0.0, 1.5, 3.0])
    assert merged(at, np.array([0.0, 5, 0]), np.array([9.0, 20, 9]), 2.0).tolist() == [[0, 0, 20], [3, 0, 9]]


def test_cells_count_from_where_reading_begins():
    g = Grid([0, 10, 20], [20, 10, 0], (0, 0, 20, 20), 1.0, True)
    assert [(r, c, b[0]) for r, c, b in g.cells(True)][:2] == [(0, 0, 10), (0, 1, 0)]


def line(text, x, y, w=10.0):
    return Line(text, y, (x, y, x + w, y + 4), False, Style(BLACK, "F", 10, 0), 0, len(text))


def test_lines_fill_cells_and_edges_are_shared():
    g = Grid([0, 50, 100], [40, 20, 0], (0, 0, 100, 40), 1.0, True)
    lines = [line("b", 20, 22), line("a", 5, 30), line("edge", 45, 5), line("out", 300, 5)]
    t, taken = fill_from_lines(g, lines, False)
    assert t.texts == [["a b", ""], ["edge", "edge"]] and taken == [0, 1, 2]
    assert not t.plausible() and Table([[("x", g.box)] * 4], g.box, 1.0).plausible()


def aligned(rows=10, cols=5, cell=60.0, pitch=14.0, drop=None):
    return [(c * cell, c * cell + 30, 500 - r * pitch - (3 if c == drop else 0), 510 - r * pitch, 10.0) for r in range(rows) for c in range(cols)]


def test_borderless_grids():
    (g,) = borderless_grids(boxes(aligned()))
    assert len(g.ys) == 11 and len(g.xs) == 6 and g.confidence == 0.5 and not g.ruled
    (g,) = borderless_grids(boxes(aligned(cols=6, drop=5)))
    assert len(g.ys) == 11
    assert borderless_grids(boxes(aligned(cols=3))) == [] and borderless_grids(boxes(aligned(rows=4))) == []


def page_of(words, rules=()):
    """words: (x, y, text); 6 points a letter at 12."""
    rows = [(x + 6 * k, y, c) for x, y, t in words for k, c in enumerate(t)]
    n = len(rows)
    g = PageGlyphs(np.array([ord(r[2]) for r in rows], int), np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float), np.full(n, 6.0), np.zeros(n, int), np.zeros(n, int), [Style(BLACK, "F", 12, 0)], rules=list(rules))

    class Ascii:
        two_byte, resolvable = False, True

        def decode(self, code):
            return chr(code)

    return g, PlacedGlyphs(g, {"F": Ascii()})


def test_a_table_stands_where_its_first_line_is():
    words = [(0, 200, "Heading")] + [(100 * c + 10, 45 - 20 * r, f"column{r}{c}word") for r in range(3) for c in range(3)]
    g, placed = page_of(words, grid_rules(3, 3))
    blocks, lines = assemble(g, placed, [], (0, 0, 600, 800))
    assert [b.kind for b in blocks] == ["text", "table"] and blocks[1].table.texts[0] == ["column00word", "column01word", "column02word"]
    assert blocks[1].text.split("\n")[1] == "column10word\tcolumn11word\tcolumn12word" and len(lines) >= 2


def test_a_doubled_picture_frame_is_no_table():
    frame = [(0, y, 300, y) for y in (0, 5, 195, 200)] + [(x, 0, x, 200) for x in (0, 5, 295, 300)]
    g, placed = page_of([(100, 100, "caption")], frame)
    blocks, _ = assemble(g, placed, [], (0, 0, 600, 800))
    assert [b.kind for b in blocks] == ["text"]


def test_images_are_backgrounds_placed_or_left_over():
    p = Picture("Im0", 1, 1, "png", b"x", None, False)
    placed = place_pictures([p, p._replace(name="Im1")], [("Im0", (200, 0, 0, 100, 50, 600), 0), ("Im0", (600, 0, 0, 800, 0, 0), 0)])
    assert [b for _, b in placed] == [(50, 600, 250, 700), (0, 0, 600, 800), None]
    g, glyphs = page_of([(0, 100, "word")])
    blocks, _ = assemble(g, glyphs, placed, (0, 0, 600, 800))
    assert [(b.kind, b.background) for b in blocks] == [("image", True), ("image", False), ("text", False), ("image", False)]
    assert placement((0, 10, -20, 0, 5, 5)) == (-15, 5, 5, 15)


def test_stated_order():
    e = [Element("P", 1, 1, [0]), Element("H1", 1, 1, [1])]
    spans = [Span(0, 5, None, 1), Span(5, 10, None, 0)]
    assert [r[2] for r in stated_order(e, 1, spans, 10)] == [[(5, 10)], [(0, 5)]]
    assert stated_order(e, 1, spans, 13) is None and stated_order(e, 2, spans, 10) is None and stated_order(e, 1, [], 10) is None
    e = [Element("P", 1, None, []), *(Element("Span", 2, None, [k]) for k in (0, 1))]
    assert len(stated_order(e, 7, spans, 10)) == 1


def raw(**kw):
    return RawImage(**({"name": "Im", "width": 2, "height": 2, "bits": 8, "space": "cmyk", "palette": None, "filters": [], "data": bytes(16), "has_mask": False} | kw))


@pytest.mark.parametrize(("image", "reason"), [
    (raw(data=bytes(15)), "truncated: 15 sample bytes for a 2x2 CMYK image needing 16"), (raw(bits=1), "1-bit samples are not yet unpacked"), (raw(space="other"), "unresolved colour space"),
    (raw(space="indexed"), "indexed image with no palette"), (raw(filters=["JBIG2Decode"]), "JBIG2Decode is not decoded"), (raw(space="gray", data=b"abc"), "truncated: 3 sample bytes for a 2x2 image needing 4"),
])
def test_images_that_are_refused(image, reason):
    p = picture(image)
    assert p.data is None and p.reason == reason


def test_images_that_are_written():
    assert picture(raw()).data.startswith(b"\x89PNG") and picture(raw(filters=["DCTDecode"], data=b"jpeg")).data == b"jpeg"
    assert cmyk_to_rgb(np.array([[0, 255, 100, 55]], np.uint8)).tolist() == [[200, 0, 121]]
    indexed = picture(raw(space="indexed", palette=("rgb", b"\1\2\3"), data=b"\0\1\0\1"))
    import zlib

    body = indexed.data[indexed.data.index(b"IDAT") + 4 :]
    assert zlib.decompressobj().decompress(body) == b"\0\1\2\3\0\0\0" * 2

"""Typed blocks of a page in reading order."""

from __future__ import annotations

from dataclasses import dataclass

from foliospark.functions.grids import Table, borderless_grids, fill_from_lines, ruled_grids
from foliospark.functions.interpreter import Matrix, PageGlyphs, apply
from foliospark.functions.layout import Boxes
from foliospark.functions.lines import Line, PlacedGlyphs, Rect, regions
from foliospark.functions.pictures import Picture
from foliospark.params import PARAMS, Params


@dataclass
class Block:
    """kind: text (lines), table (table) or image (picture, background)."""

    kind: str
    box: Rect | None
    confidence: float = 1.0
    lines: list[Line] | None = None
    table: Table | None = None
    picture: Picture | None = None
    background: bool = False

    @property
    def text(self) -> str:
        if self.kind == "text":
            return "\n".join(x.text for x in self.lines)
        return "\n".join("\t".join(r) for r in self.table.texts) if self.kind == "table" else ""


def placement(ctm: Matrix) -> Rect:
    """The unit square's bounds on the page."""
    xs, ys = zip(*(apply(ctm, x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)), strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def place_pictures(pictures: list[Picture], uses: list[tuple[str, Matrix, int]]) -> list[tuple[Picture, Rect | None]]:
    """A picture for each time that the page draws it, one without a box if it never does."""
    out: list[tuple[Picture, Rect | None]] = []
    for p in pictures:
        drawn = [placement(ctm) for name, ctm, _ in uses if name == p.name]
        out += [(p, box) for box in drawn or [None]]
    return out


def visible_area(box: Rect, page: Rect) -> float:
    return max(0.0, min(box[2], page[2]) - max(box[0], page[0])) * max(0.0, min(box[3], page[3]) - max(box[1], page[1]))


def _overlap(a: Rect, b: Rect) -> bool:
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def confidence(lines: list[Line]) -> float:
    glyphs = sum(x.glyphs for x in lines)
    return 1.0 - sum(x.unresolved for x in lines) / glyphs if glyphs else 1.0


def assemble(page: PageGlyphs, placed: PlacedGlyphs, images: list[tuple[Picture, Rect | None]], box: Rect, order=None, p: Params = PARAMS) -> tuple[list[Block], list[Line]]:
    """Backgrounds, then regions with their prose, tables and images, then images that found no
    place; and all lines in reading order."""
    area = (box[2] - box[0]) * (box[3] - box[1])
    image = lambda k, behind=False: Block("image", images[k][1], picture=images[k][0], background=behind)
    behind = {k for k, (_, b) in enumerate(images) if b and area > 0 and visible_area(b, box) / area >= p.background_share}
    beside = [k for k, (_, b) in enumerate(images) if b and k not in behind]
    found = regions(placed, [images[k][1] for k in beside], order)
    lines = [x for r in found for x in r.lines]
    rtl = bool(lines) and lines[0].rtl
    tables, owner = _tables(page, placed, lines, rtl, p)
    blocks = [image(k, True) for k in sorted(behind)]
    at, told, shown = 0, set(), set()
    for r in found:
        prose: list[Line] = []

        def flush(r=r) -> None:
            nonlocal prose
            if prose:
                blocks.append(Block("text", r.box, confidence(prose), lines=prose))
            prose = []

        for x in r.lines:
            table, at = owner.get(at), at + 1
            if table is None:
                prose.append(x)
            elif table not in told:
                told.add(table)
                flush()
                blocks.append(Block("table", tables[table].box, tables[table].confidence, table=tables[table]))
        flush()
        shown.update(r.extras)
        blocks += [image(beside[k]) for k in r.extras]
    blocks += [image(k) for i, k in enumerate(beside) if i not in shown]
    blocks += [image(k) for k, (_, b) in enumerate(images) if b is None]
    return blocks, lines


def _tables(page: PageGlyphs, placed: PlacedGlyphs, lines: list[Line], rtl: bool, p: Params) -> tuple[list[Table], dict[int, int]]:
    """Plausible tables, and which of them owns each line: the first that takes it."""
    size = placed.size
    grids = ruled_grids(page.rules, p)
    for g in borderless_grids(Boxes(page.x, page.x + page.advance, page.y, page.y + size, size), p):
        if not any(_overlap(g.box, other.box) for other in grids):
            grids.append(g)
    tables: list[Table] = []
    owner: dict[int, int] = {}
    for g in grids:
        if g.ruled:
            table, taken = fill_from_lines(g, lines, rtl)
        else:
            rows: list[list[tuple[str, Rect]]] = [[] for _ in g.ys[1:]]
            for row, _, cell in g.cells(rtl):
                rows[row].append((placed.within(cell), cell))
            table, taken = Table(rows, g.box, g.confidence), [i for i, x in enumerate(lines) if _overlap(x.box, g.box)]
        if taken and table.plausible(p):
            for i in taken:
                owner.setdefault(i, len(tables))
            tables.append(table)
    return tables, owner

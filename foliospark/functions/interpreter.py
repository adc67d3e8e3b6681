"""Content streams: a fold over operators that leaves positioned glyphs, rules and image uses.

Glyphs are columns of arrays. The codes of one show operator are placed together: their
advances are summed along the pen's direction, so a string costs a few array operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np

from foliospark.functions.font_text import UNKNOWN_WIDTH, Font
from foliospark.params import PARAMS, Params
from foliospark.sources.pdf_pages import RawForm
from foliospark.sources.pdf_syntax import Name, operations

STACK, NESTING, FORMS = 64, 64, 8
Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Color space names of content streams, by the space that they count as.
SPACES = {"DeviceGray": "gray", "CalGray": "gray", "G": "gray", "DeviceRGB": "rgb", "CalRGB": "rgb", "RGB": "rgb", "Lab": "rgb", "DeviceCMYK": "cmyk", "CMYK": "cmyk"}
_PARTS = {"gray": 1, "rgb": 3, "cmyk": 4}
BLACK = ("gray", 0.0)


def times(m: Matrix, n: Matrix) -> Matrix:
    """m, then n."""
    a, b, c, d, e, f = m
    return (
        a * n[0] + b * n[2], a * n[1] + b * n[3],
        c * n[0] + d * n[2], c * n[1] + d * n[3],
        e * n[0] + f * n[2] + n[4], e * n[1] + f * n[3] + n[5],
    )


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def quarter_turns(a: float, b: float) -> int:
    """0 rightward, 1 upward, 2 leftward, 3 downward: the nearest to the direction (a, b)."""
    return int(math.floor(math.degrees(math.atan2(b, a)) / 90 + 0.5)) % 4


def color_of(space: str, parts: list[float]) -> tuple:
    """(space, parts...), or ("unknown",) where the number of parts doesn't fit the space."""
    return (space, *(float(np.float32(p)) for p in parts)) if _PARTS.get(space) == len(parts) else ("unknown",)


class Style(NamedTuple):
    color: tuple
    font: str
    size: float
    mode: int

    def merges(self, other: Style) -> bool:
        return self.color == other.color and self.font == other.font and self.mode == other.mode and abs(self.size - other.size) < 0.01


class Span(NamedTuple):
    """Glyphs start..end; text: their ActualText, mcid: their marked-content number, else None."""

    start: int
    end: int
    text: str | None
    mcid: int | None


@dataclass
class PageGlyphs:
    code: np.ndarray
    x: np.ndarray
    y: np.ndarray
    advance: np.ndarray
    turn: np.ndarray
    style: np.ndarray
    styles: list[Style]
    rules: list[tuple[float, float, float, float]] = field(default_factory=list)
    uses: list[tuple[str, Matrix, int]] = field(default_factory=list)
    spans: list[Span] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.code)

    @property
    def size(self) -> np.ndarray:
        return np.array([s.size for s in self.styles])[self.style] if len(self.styles) else np.zeros(0)

    @property
    def along(self) -> np.ndarray:
        return np.choose(self.turn, [self.x, self.y, -self.x, -self.y]) if len(self) else self.x

    @property
    def across(self) -> np.ndarray:
        return np.choose(self.turn, [self.y, -self.x, -self.y, self.x]) if len(self) else self.y


@dataclass
class _State:
    ctm: Matrix = IDENTITY
    fill: tuple = BLACK
    stroke: tuple = BLACK
    fill_space: str = "gray"
    stroke_space: str = "gray"
    font: str = ""
    size: float = 0.0
    spacing: float = 0.0
    words: float = 0.0
    stretch: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


def text_string(data: bytes) -> str:
    """UTF-16BE after its mark, else Latin-1."""
    if data[:2] == b"\xfe\xff":
        return data[2 : len(data) // 2 * 2].decode("utf-16-be", "replace")
    return data.decode("latin-1")


class Interpreter:
    def __init__(self, fonts: dict[str, Font], forms: list[RawForm] = (), params: Params = PARAMS) -> None:
        self.fonts, self.params = fonts, params
        self.forms: dict[str, RawForm] = {}
        for f in forms:
            self.forms.setdefault(f.name, f)
        self.state, self.saved = _State(), []
        self.tm = self.line = IDENTITY
        self.inside: list[str] = []
        self.path: list[tuple[bool, float, float, float, float]] = []
        self.start: tuple[float, float] | None = None
        self.cursor: tuple[float, float] | None = None
        self.marked: list[tuple[int, str | None, int | None]] = []
        self.chunks: list[tuple] = []
        self.n = 0
        self.styles: dict[Style, int] = {}
        self.rules: list[tuple[float, float, float, float]] = []
        self.uses: list[tuple[str, Matrix, int]] = []
        self.spans: list[Span] = []

    def page(self, content: bytes) -> PageGlyphs:
        self.run(content)
        cols = [np.concatenate(c) for c in zip(*self.chunks, strict=True)] if self.chunks else [np.zeros(0, t) for t in (np.int64, float, float, float, np.int64, np.int64)]
        return PageGlyphs(*cols, list(self.styles), self.rules, self.uses, self.spans)

    def run(self, content: bytes) -> None:
        for operator, operands in operations(content):
            act = _ACTIONS.get(operator)
            if act is not None:
                act(self, operator, operands, [x for x in operands if type(x) in (int, float)])

    # graphics state
    def save(self, *_) -> None:
        if len(self.saved) < STACK:
            self.saved.append(replace(self.state))

    def restore(self, *_) -> None:
        if self.saved:
            self.state = self.saved.pop()

    def concat(self, _, __, n) -> None:
        if len(n) == 6:
            self.state.ctm = times(tuple(map(float, n)), self.state.ctm)

    def device_color(self, op, _, n) -> None:
        space = {"g": "gray", "rg": "rgb", "k": "cmyk"}[op.lower()]
        self._paint_with(op.isupper(), space, color_of(space, n))

    def _paint_with(self, stroking: bool, space: str, color: tuple | None) -> None:
        s = self.state
        if stroking:
            s.stroke_space, s.stroke = space, s.stroke if color is None else color
        else:
            s.fill_space, s.fill = space, s.fill if color is None else color

    def space(self, op, operands, _) -> None:
        if operands and isinstance(operands[0], Name):
            self._paint_with(op == "CS", SPACES.get(operands[0], "other"), None)

    def color(self, op, _, n) -> None:
        stroking = op[0] == "S"
        space = self.state.stroke_space if stroking else self.state.fill_space
        self._paint_with(stroking, space, color_of(space, n))

    # text
    def begin(self, *_) -> None:
        self.tm = self.line = IDENTITY

    def qualified(self, name: str) -> str:
        return "/".join([*self.inside, name])

    def font(self, _, operands, n) -> None:
        if operands and isinstance(operands[0], Name):
            self.state.font = self.qualified(operands[0])
        if n:
            self.state.size = float(n[0])

    def number(self, op, _, n) -> None:
        x = float(n[0]) if n else 100.0 if op == "Tz" else 0.0
        if op == "Tr":
            self.state.mode = int(x) if 0 <= int(x) <= 7 else 0
        else:
            setattr(self.state, {"Tc": "spacing", "Tw": "words", "Tz": "stretch", "TL": "leading", "Ts": "rise"}[op], x / 100 if op == "Tz" else x)

    def move(self, op, _, n) -> None:
        if len(n) == 2:
            if op == "TD":
                self.state.leading = -float(n[1])
            self._down(float(n[0]), float(n[1]))

    def _down(self, x: float, y: float) -> None:
        self.tm = self.line = times((1.0, 0.0, 0.0, 1.0, x, y), self.line)

    def text_matrix(self, _, __, n) -> None:
        if len(n) == 6:
            self.tm = self.line = tuple(map(float, n))

    def next_line(self, *_) -> None:
        self._down(0.0, -self.state.leading)

    def show(self, op, operands, n) -> None:
        if op == '"' and len(n) == 2:
            self.state.words, self.state.spacing = float(n[0]), float(n[1])
        if op != "Tj":
            self.next_line()
        at = 2 if op == '"' else 0
        if len(operands) > at and isinstance(operands[at], bytes):
            self._emit([operands[at]])

    def show_many(self, _, operands, __) -> None:
        if operands and isinstance(operands[0], list):
            self._emit([x for x in operands[0] if type(x) in (int, float, bytes)])

    def _emit(self, items: list) -> None:
        """Places the codes of strings; numbers between them shift the pen back by thousandths."""
        s, font = self.state, self.fonts.get(self.state.font)
        wide = font is not None and font.two_byte
        data = [x for x in items if isinstance(x, bytes)]
        data = [x[: len(x) // 2 * 2] for x in data] if wide else data
        shifts = [0.0]
        where = []  # codes before each shift
        count = 0
        strings = iter(data)
        for x in items:
            if isinstance(x, bytes):
                count += len(next(strings)) // (2 if wide else 1)
            else:
                where.append(count)
                shifts.append(-float(x) / 1000.0 * s.size * s.stretch)
        raw = b"".join(data)
        codes = np.frombuffer(raw, ">u2" if wide else np.uint8).astype(np.int64)
        width = font.widths(codes) if font is not None else np.full(len(codes), UNKNOWN_WIDTH)
        step = (width * s.size + s.spacing + (0.0 if wide else np.where(codes == 32, s.words, 0.0))) * s.stretch
        pen = np.zeros(len(codes) + 1)
        np.cumsum(step, out=pen[1:])
        moved = np.zeros(len(codes) + 1)
        if where:
            np.add.at(moved, where, shifts[1:])
            pen += np.cumsum(moved)
        tm, ctm = self.tm, s.ctm
        self.tm = times((1.0, 0.0, 0.0, 1.0, float(pen[-1]), 0.0), tm)
        if not len(codes):
            return
        to_device = times(tm, ctm)
        shape = times((s.size * s.stretch, 0.0, 0.0, s.size, 0.0, s.rise), to_device)
        style = Style(s.stroke if s.mode in (1, 5) else s.fill, s.font, math.hypot(shape[2], shape[3]), s.mode)
        index = self.styles.setdefault(style, len(self.styles))
        at = pen[:-1]
        ink = np.abs(np.maximum(width, 0.0) * s.size * s.stretch) * math.hypot(to_device[0], to_device[1])
        self.chunks.append(
            (
                codes,
                shape[4] + at * to_device[0],
                shape[5] + at * to_device[1],
                ink,
                np.full(len(codes), quarter_turns(shape[0], shape[1])),
                np.full(len(codes), index),
            )
        )
        self.n += len(codes)

    # paths
    def _segment(self, rect: bool, a: tuple[float, float], b: tuple[float, float]) -> None:
        if len(self.path) < self.params.path_segments:
            self.path.append((rect, *a, *b))

    def line_path(self, op, _, n) -> None:
        ctm = self.state.ctm
        if op == "h":
            if self.cursor and self.start:
                self._segment(False, self.cursor, self.start)
            self.cursor = self.start
        elif op == "re" and len(n) == 4:
            self.start = self.cursor = apply(ctm, n[0], n[1])
            self._segment(True, self.start, apply(ctm, n[0] + n[2], n[1] + n[3]))
        elif op in "ml" and len(n) == 2:
            to = apply(ctm, *n)
            if op == "m":
                self.start = to
            elif self.cursor:
                self._segment(False, self.cursor, to)
            self.cursor = to
        elif op in "cvy" and len(n) >= 2:
            self.cursor = apply(ctm, *n[-2:])

    def paint(self, *_) -> None:
        self.rules += [r for s in self.path if (r := rule_of(*s, self.params))]
        self.path = []

    def drop_path(self, *_) -> None:
        self.path, self.cursor, self.start = [], None, None

    # marked content and external objects
    def mark(self, op, operands, _) -> None:
        properties = operands[1] if len(operands) > 1 and isinstance(operands[1], dict) else {}
        mcid, text = properties.get("MCID"), properties.get("ActualText")
        if len(self.marked) < NESTING:
            self.marked.append((self.n, text_string(text) if op == "BDC" and isinstance(text, bytes) else None, mcid if isinstance(mcid, int) and mcid >= 0 else None))

    def unmark(self, *_) -> None:
        if self.marked:
            start, text, mcid = self.marked.pop()
            if self.n > start and (text is not None or mcid is not None):
                self.spans.append(Span(start, self.n, text, mcid))

    def draw(self, _, operands, __) -> None:
        if not operands or not isinstance(operands[0], Name):
            return
        name = self.qualified(operands[0])
        self.uses.append((name, self.state.ctm, self.n))
        form = self.forms.get(name)
        if form is None or len(self.inside) >= FORMS:
            return
        outer = self.state.ctm
        self.save()
        self.state.ctm = times(form.matrix, outer)
        text = self.tm, self.line
        self.tm = self.line = IDENTITY
        self.inside.append(name.rsplit("/", 1)[-1])
        self.run(form.content)
        self.inside.pop()
        self.tm, self.line = text
        self.restore()


def rule_of(rect: bool, x0: float, y0: float, x1: float, y1: float, p: Params = PARAMS) -> tuple[float, float, float, float] | None:
    """The rule that a painted segment or thin rectangle is, else None."""
    w, h = abs(x1 - x0), abs(y1 - y0)
    if not rect:
        if min(w, h) > p.axis_tolerance or math.hypot(w, h) < p.rule_length:
            return None
        return x0, y0, x1, y1
    left, right, bottom, top = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    if h <= p.rule_thickness and w > h and w >= p.rule_length:
        middle = (bottom + top) / 2
        return left, middle, right, middle
    if w <= p.rule_thickness and h > w and h >= p.rule_length:
        middle = (left + right) / 2
        return middle, bottom, middle, top
    return None


_I = Interpreter
_ACTIONS = {
    "q": _I.save, "Q": _I.restore, "cm": _I.concat, "cs": _I.space, "CS": _I.space, "BT": _I.begin, "Tf": _I.font,
    "Td": _I.move, "TD": _I.move, "Tm": _I.text_matrix, "T*": _I.next_line, "TJ": _I.show_many, "n": _I.drop_path,
    "BDC": _I.mark, "BMC": _I.mark, "EMC": _I.unmark, "Do": _I.draw,
    **dict.fromkeys(("g", "G", "rg", "RG", "k", "K"), _I.device_color),
    **dict.fromkeys(("sc", "scn", "SC", "SCN"), _I.color),
    **dict.fromkeys(("Tc", "Tw", "Tz", "TL", "Ts", "Tr"), _I.number),
    **dict.fromkeys(("Tj", "'", '"'), _I.show),
    **dict.fromkeys(("m", "l", "re", "h", "c", "v", "y"), _I.line_path),
    **dict.fromkeys(("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"), _I.paint),
}

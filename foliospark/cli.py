"""python -m foliospark.cli inspect|raw|glyphs|text|extract|blocks|html|images FILE [PAGE|OUT]"""

from __future__ import annotations

import argparse
import os
import sys

from foliospark.api import Document
from foliospark.functions.font_text import font_map
from foliospark.functions.interpreter import Interpreter, PageGlyphs
from foliospark.functions.page import PageInput, page_inputs
from foliospark.sources.pdf_syntax import PdfError

_HINTS = {
    "to_unicode": "ToUnicode present — recoverable",
    "encoding": "no ToUnicode, /Encoding only — uncertain",
    "none": "no ToUnicode, no /Encoding — likely needs OCR",
}
COMMANDS = ("inspect", "raw", "glyphs", "text", "extract", "blocks", "html", "images")


def _inputs(path: str, page: int | None = None) -> list[PageInput]:
    with open(path, "rb") as f:
        found = list(page_inputs(f.read(), {page} if page else None))
    if page and not found:
        raise IndexError(f"no page {page} in {path}")
    return found


def inspect(path: str) -> None:
    pages = _inputs(path)
    print(f"{path}: {len(pages)} page(s)")
    for p in pages:
        x0, y0, x1, y1 = p.info.box
        print(f"\npage {p.info.number} — {x1 - x0:.1f} x {y1 - y0:.1f} pt, rotate {p.info.rotation}°")
        own = [f for f in p.fonts if "/" not in f.name]
        if not own:
            print("  (no font resources — likely a scanned page)")
        for f in own:
            print(f"  /{f.name:<8} {f.subtype:<10} {f.base_font or '(no /BaseFont)':<28} codes={'2' if f.two_byte else '1'}-byte — {_HINTS[f.route]}")
            if f.encoding_name:
                print(f"               /Encoding {f.encoding_name}")


def raw(path: str, page: int) -> None:
    print(_inputs(path, page)[0].content.decode("utf-8", "replace"))


def _painted(path: str, page: int) -> tuple[dict, PageGlyphs]:
    p = _inputs(path, page)[0]
    fonts = font_map(p.fonts)
    return fonts, Interpreter(fonts, p.forms).page(p.content)


def glyph_runs(g: PageGlyphs) -> list[tuple[int, int]]:
    """Neighbours in paint order whose style and baseline go with those of the run's first."""
    out: list[tuple[int, int]] = []
    for i in range(len(g)):
        if out:
            first = out[-1][0]
            if g.styles[g.style[i]].merges(g.styles[g.style[first]]) and abs(g.y[i] - g.y[first]) < 0.5:
                out[-1] = (first, i + 1)
                continue
        out.append((i, i + 1))
    return out


def _hex(color: tuple) -> str:
    levels = [max(0.0, min(1.0, p)) for p in color[1:]]
    if color[0] == "cmyk":
        levels = [(1 - p) * (1 - levels[3]) for p in levels[:3]]
    levels = levels * 3 if color[0] == "gray" else levels or [0.0] * 3
    return "#" + "".join(f"{int(p * 255 + 0.5):02x}" for p in levels)


def glyphs(path: str, page: int) -> None:
    _, g = _painted(path, page)
    print(f"page {page}: {len(g)} glyph(s)")
    if g.uses:
        print(f"  note: {len(g.uses)} XObject(s) drawn")
    for a, b in glyph_runs(g):
        s = g.styles[g.style[a]]
        css = _hex(s.color)
        hidden = f" [mode {s.mode} — INVISIBLE]" if s.mode in (3, 7) else ""
        print(f"\n  /{s.font} {s.size:.2f}pt {css} {'(black)' if css == '#000000' else ''}{hidden}")
        print(f"    at ({g.x[a]:.1f}, {g.y[a]:.1f}), {b - a} glyph(s)")
        print("    " + " ".join(f"{c:04X}" for c in g.code[a:b].tolist()))


def text(path: str, page: int) -> None:
    """Codes resolved in paint order, a line for each change of baseline."""
    fonts, g = _painted(path, page)
    for f in fonts.values():
        print(f"font /{f.name}: {len(f.cmap)} code(s) mappable, {2 if f.two_byte else 1}-byte codes")
    lost, line, base = 0, [], None
    for code, style, y in [*zip(g.code.tolist(), g.style.tolist(), g.y.tolist(), strict=True), (None, None, float("inf"))]:
        if base is None or abs(y - base) > 0.5:
            if line:
                print(f"[y={base:7.1f}] {''.join(line)}")
            line, base = [], y
        if code is not None:
            font = fonts.get(g.styles[style].font)
            t = font.decode(code) if font else None
            lost += t is None
            line.append("�" if t is None else t)
    print(f"\n{lost} of {len(g)} glyph(s) unresolved")


def _pages(doc: Document, page: int | None):
    return [doc.page(page)] if page else doc.pages


def _summary(doc: Document) -> None:
    n = lambda v: sum(p.verdict == v for p in doc.pages)
    print(f"{len(doc)} page(s): {n('ok')} ok, {n('degraded')} degraded, {n('needs_ocr')} need OCR — mean confidence {doc.confidence:.2f}")
    if doc.pages_needing_ocr:
        print("pages needing OCR: " + ", ".join(map(str, doc.pages_needing_ocr)))


def extract(path: str, page: int | None, blocks: bool = False) -> None:
    doc = Document(path)
    for p in _pages(doc, page):
        print(f"── page {p.number} [{p.verdict}]──")
        for r in p.reasons:
            print(f"   ! {r}")
        if blocks:
            _print_blocks(p)
        else:
            print("   (no trustworthy text — this page needs OCR)" if p.needs_ocr else p.text)
        print()
    if page is None and len(doc) > 1:
        _summary(doc)


def _print_blocks(page) -> None:
    if not page.blocks:
        print("   (no blocks)")
    for b in page.blocks:
        at = "        position unknown"
        if b.bbox:
            x0, y0, x1, y1 = b.bbox
            at = f"({x0:>5.0f},{y0:>5.0f}) {x1 - x0:>4.0f}x{y1 - y0:<4.0f}"
        head = f"[{b.reading_index:>2}]"
        if b.kind == "text":
            print(f"{head} text  {at}  confidence {b.confidence:.2f}  {len(b.lines)} line(s)", *(f"       {x.text}" for x in b.lines), sep="\n")
        elif b.kind == "table":
            print(f"{head} table {at}  confidence {b.confidence:.2f}  {b.row_count} x {b.column_count}", *(f"       | {' | '.join(r)} |" for r in b.to_rows()), sep="\n")
        else:
            kind = "image (background)" if b.is_background else "image"
            print(f"{head} {kind}  {at}  " + (f"{b.file_name}  {b.width}x{b.height}px" if b.data is not None else f"not decoded: {b.unsupported_reason}"))


def html(path: str, out: str | None) -> None:
    doc = Document(path)
    told = doc.to_html()
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(told)
    else:
        print(told)
    for size, level in doc.heading_sizes():
        print(f"{size:.1f} pt → h{level}", file=sys.stderr)


def images(path: str, folder: str | None) -> None:
    written = skipped = 0
    for number, b in Document(path).images:
        at = f"at ({b.bbox[0]:.0f}, {b.bbox[1]:.0f}) {b.bbox[2] - b.bbox[0]:.0f}x{b.bbox[3] - b.bbox[1]:.0f}pt" if b.bbox else "position unknown (drawn inside a form?)"
        if b.data is None:
            skipped += 1
            print(f"p{number:03}-{b.name:<14} not extracted: {b.unsupported_reason}")
            continue
        name = f"p{number:03}-{b.file_name}"
        print(f"{name:<20} {b.width}x{b.height}px {at}" + ("  [has a mask that is not composited — may look blank]" if b.dropped_transparency else ""))
        if folder:
            os.makedirs(folder, exist_ok=True)
            b.save(os.path.join(folder, name))
            written += 1
    if folder:
        print(f"\nwrote {written} image(s) to {folder}/")
    if skipped:
        print(f"{skipped} image(s) could not be decoded")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliospark", description="Text, tables and verdicts of a PDF file.")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("file")
    parser.add_argument("extra", nargs="?", help="a page number (or all), an HTML file, or a folder for images")
    args = parser.parse_args(argv)
    page = None
    if args.command in ("raw", "glyphs", "text", "extract", "blocks") and args.extra not in (None, "all"):
        if not args.extra.isdigit():
            print(f"error: `{args.extra}` is not a page number", file=sys.stderr)
            return 1
        page = int(args.extra)
    try:
        if args.command == "inspect":
            inspect(args.file)
        elif args.command in ("raw", "glyphs", "text"):
            {"raw": raw, "glyphs": glyphs, "text": text}[args.command](args.file, page or 1)
        elif args.command in ("extract", "blocks"):
            extract(args.file, page, args.command == "blocks")
        else:
            {"html": html, "images": images}[args.command](args.file, args.extra)
    except (OSError, PdfError, IndexError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

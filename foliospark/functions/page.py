"""One page, start to end: bytes in, a plain record out."""

from __future__ import annotations

from dataclasses import dataclass

from foliospark.functions.blocks import Block, assemble, place_pictures
from foliospark.functions.font_text import font_map
from foliospark.functions.interpreter import Interpreter, PageGlyphs
from foliospark.functions.lines import Line, PlacedGlyphs
from foliospark.functions.pictures import Picture, picture
from foliospark.functions.structure import stated_order
from foliospark.params import PARAMS, Params
from foliospark.sources.pdf_pages import Element, PageInfo, PdfPages, RawFont, RawForm, RawImage


@dataclass
class PageInput:
    """What the file gives for a page; enough to work on it anywhere."""

    info: PageInfo
    content: bytes
    fonts: list[RawFont]
    forms: list[RawForm]
    images: list[RawImage]
    elements: list[Element]


@dataclass
class PageResult:
    info: PageInfo
    tagged: bool
    glyphs: PageGlyphs
    placed: PlacedGlyphs
    fonts: list
    lines: list[Line]
    blocks: list[Block]
    images: list


def page_inputs(data: bytes, numbers: set[int] | None = None):
    """Inputs of all pages, or of those numbered; others are not read."""
    pdf = PdfPages(data)
    _, elements = pdf.structure()
    elements = elements if any(e.mcids for e in elements) else []
    for i, info in enumerate(pdf.pages):
        if numbers is None or info.number in numbers:
            own = [e for e in elements if e.page in (None, info.number)]
            yield PageInput(info, pdf.content(i), pdf.fonts(i), pdf.forms(i), pdf.images(i), own)


def process(page: PageInput, p: Params = PARAMS) -> PageResult:
    fonts = font_map(page.fonts)
    glyphs = Interpreter(fonts, page.forms, p).page(page.content)
    stated = stated_order(page.elements, page.info.number, glyphs.spans, len(glyphs), p) if page.elements else None
    pictures: list[Picture] = [picture(r) for r in page.images]
    images = place_pictures(pictures, glyphs.uses)
    placed = PlacedGlyphs(glyphs, fonts, p)
    blocks, lines = assemble(glyphs, placed, images, page.info.box, [r[2] for r in stated] if stated else None, p)
    return PageResult(page.info, stated is not None, glyphs, placed, list(fonts.values()), lines, blocks, images)

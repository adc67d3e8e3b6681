"""Reading order that a tagged file states."""

from __future__ import annotations

from collections import defaultdict

from foliospark.functions.interpreter import Span
from foliospark.params import PARAMS, Params
from foliospark.sources.pdf_pages import Element

# Tags whose content belongs to the block around it.
INLINE = frozenset("Span Quote Note Reference BibEntry Code Link Annot Ruby RB RT RP Warichu WT WP".split())


def stated_order(elements: list[Element], page: int, spans: list[Span], glyphs: int, p: Params = PARAMS) -> list[tuple[str, int, list[tuple[int, int]]]] | None:
    """(tag, depth, glyph ranges) of each run, or None where the tags cover too little of the page.
    Elements that name no page count for every page."""
    by_id: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for s in spans:
        if s.mcid is not None:
            by_id[s.mcid].append((s.start, s.end))
    if not by_id or not glyphs:
        return None
    runs: list[tuple[str, int, list[tuple[int, int]]]] = []
    for e in elements:
        if e.page not in (None, page):
            continue
        ranges = [r for m in e.mcids for r in by_id.get(m, ())]
        if e.tag not in INLINE or (ranges and not runs):
            runs.append((e.tag, e.depth, []))
        if ranges:
            runs[-1][2].extend(ranges)
    runs = [r for r in runs if r[2]]
    covered = sum(b - a for r in runs for a, b in r[2])
    return runs if runs and covered / glyphs >= p.structure_coverage else None

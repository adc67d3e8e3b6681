"""Text direction, and the Unicode bidirectional algorithm (UAX #9) over one line."""

from __future__ import annotations

import re
from unicodedata import bidirectional

RTL_RANGES = "\u0590-\u05ff\u0600-\u07bf\u0860-\u08ff\ufb50-\ufdff\ufe70-\ufeff"
_RTL = re.compile(f"[{RTL_RANGES}]")
#: Anything that can move: right-to-left classes, Arabic numbers and explicit controls.
_MOVES = re.compile("[\u0590-\u08ff\u200e\u200f\u202a-\u202e\u2066-\u2069\ufb1d-\ufdff\ufe70-\ufeff\U00010800-\U00010fff\U0001e800-\U0001efff]")


def is_rtl(text: str) -> bool:
    return _RTL.search(text) is not None


_PARAGRAPH = re.compile("[^\n\r\x1c-\x1e\x85\u2029]*[\n\r\x1c-\x1e\x85\u2029]|[^\n\r\x1c-\x1e\x85\u2029]+")
#: A paragraph of right-to-left letters and spaces: at level 1 every rule leaves all of it at level 1.
_ONE_LEVEL = re.compile(f"[ {''.join(c for c in map(chr, (*range(0x0590, 0x0900), *range(0xFB1D, 0xFF00))) if bidirectional(c) in ('R', 'AL'))}]+")
_STRONG = {"L", "R", "AL"}
_EMBED = {"LRE": (0, None), "RLE": (1, None), "LRO": (0, "L"), "RLO": (1, "R")}
_ISOLATE = {"LRI", "RLI", "FSI"}
_NEUTRAL = {"B", "S", "WS", "ON", "LRI", "RLI", "FSI", "PDI"}
_REMOVED = {"LRE", "RLE", "LRO", "RLO", "PDF", "BN"}
# Paired brackets, open to close.
_BRACKETS = dict(zip("([{༺༼᚛⁅⁽₍⌈⌊〈❨❪❬❮❰❲❴⟅⟦⟨⟪⟬⟮⦃⦅⦇⦉⦋⦍⦏⦑⦓⦕⦗⧘⧚⧼⸢⸤⸦⸨〈《「『【〔〖〘〚﹙﹛﹝（［｛｟｢", ")]}༻༽᚜⁆⁾₎⌉⌋〉❩❫❭❯❱❳❵⟆⟧⟩⟫⟭⟯⦄⦆⦈⦊⦌⦎⦐⦒⦔⦖⦘⧙⧛⧽⸣⸥⸧⸩〉》」』】〕〗〙〛﹚﹜﹞）］｝｠｣", strict=True))
_CLOSERS = {c: o for o, c in _BRACKETS.items()}


def _explicit(types: list[str], base: int) -> list[int]:
    """Rules X1 to X8: levels; ``types`` gets overrides, and BN for what X9 removes."""
    stack = [(base, None, False)]
    levels, overflow_isolates, overflow_embeddings, isolates = [], 0, 0, 0
    match = _isolate_ends(types)
    for i, t in enumerate(list(types)):
        level, override, _ = stack[-1]
        if t in _EMBED or t in _ISOLATE:
            levels.append(level)
            if t in _EMBED:
                odd, forced = _EMBED[t]
            else:
                if override:
                    types[i] = override
                odd = 1 if t == "RLI" or (t == "FSI" and _first_strong(types, i + 1, match.get(i, len(types))) == 1) else 0
                forced = None
            new = level + 1 + ((level + 1) % 2 != odd)
            if new <= 125 and not overflow_isolates and not overflow_embeddings:
                isolates += t in _ISOLATE
                stack.append((new, forced, t in _ISOLATE))
            elif t in _ISOLATE:
                overflow_isolates += 1
            elif not overflow_isolates:
                overflow_embeddings += 1
        elif t == "PDI":
            if overflow_isolates:
                overflow_isolates -= 1
            elif isolates:
                overflow_embeddings = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                isolates -= 1
            levels.append(stack[-1][0])
            if stack[-1][1]:
                types[i] = stack[-1][1]
        elif t == "PDF":
            levels.append(level)
            if overflow_isolates:
                pass
            elif overflow_embeddings:
                overflow_embeddings -= 1
            elif not stack[-1][2] and len(stack) > 1:
                stack.pop()
        elif t == "B":
            levels.append(base)
        else:
            levels.append(level)
            if override and t != "BN":
                types[i] = override
    return levels


def _isolate_ends(types: list[str]) -> dict[int, int]:
    out, open_ = {}, []
    for i, t in enumerate(types):
        if t in _ISOLATE:
            open_.append(i)
        elif t == "PDI" and open_:
            out[open_.pop()] = i
    return out


def _first_strong(types: list[str], begin: int, end: int) -> int | None:
    depth = 0
    for t in types[begin:end]:
        if t in _ISOLATE:
            depth += 1
        elif t == "PDI":
            depth = max(0, depth - 1)
        elif not depth and t in _STRONG:
            return 0 if t == "L" else 1
    return None


def _sequences(types: list[str], levels: list[int], original: list[str]) -> list[list[int]]:
    """Isolating run sequences, as indexes of what X9 keeps."""
    kept = [i for i, t in enumerate(original) if t not in _REMOVED]
    runs: list[list[int]] = []
    for i in kept:
        if runs and levels[runs[-1][-1]] == levels[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    ends = _isolate_ends(original)
    by_start = {r[0]: r for r in runs}
    targets = set(ends.values())
    out = []
    for r in runs:
        if original[r[0]] == "PDI" and r[0] in targets:
            continue
        sequence = list(r)
        while original[sequence[-1]] in _ISOLATE and (end := ends.get(sequence[-1])) in by_start:
            sequence += by_start[end]
        out.append(sequence)
    return out


def _weak(t: list[str], sos: str) -> None:
    before, strong = sos, sos
    for i, x in enumerate(t):
        if x == "NSM":
            t[i] = "ON" if before in _ISOLATE or before == "PDI" else before
        elif x in _STRONG:
            strong = x
        elif x == "EN" and strong == "AL":
            t[i] = "AN"
        if x == "NSM" and t[i] == "EN" and strong == "AL":
            t[i] = "AN"
        before = t[i]
    t[:] = ["R" if x == "AL" else x for x in t]
    for i in range(1, len(t) - 1):
        if t[i] in ("ES", "CS") and t[i - 1] == t[i + 1] == "EN":
            t[i] = "EN"
        elif t[i] == "CS" and t[i - 1] == t[i + 1] == "AN":
            t[i] = "AN"
    i = 0
    while i < len(t):
        if t[i] == "ET":
            end = i
            while end < len(t) and t[end] == "ET":
                end += 1
            number = (i and t[i - 1] == "EN") or (end < len(t) and t[end] == "EN")
            t[i:end] = ["EN" if number else "ON"] * (end - i)
            i = end
        else:
            i += 1
    strong = sos
    for i, x in enumerate(t):
        if x in ("ES", "CS"):
            t[i] = "ON"
        elif x in ("L", "R"):
            strong = x
        elif x == "EN" and strong == "L":
            t[i] = "L"


def _brackets(chars: list[str], t: list[str], was: list[str], sos: str, inner: str) -> None:
    strong = lambda x: "R" if x in ("R", "EN", "AN") else x if x == "L" else None
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    fold = {"\u2329": "\u3008", "\u232a": "\u3009"}
    for i, c in enumerate(chars):
        c = fold.get(c, c)
        if t[i] != "ON":
            continue
        if c in _BRACKETS:
            if len(stack) == 63:
                return
            stack.append((c, i))
        elif c in _CLOSERS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == fold.get(_CLOSERS[c], _CLOSERS[c]):
                    pairs.append((stack[k][1], i))
                    del stack[k:]
                    break
    outer = "L" if inner == "R" else "R"
    for a, b in sorted(pairs):
        within = {strong(x) for x in t[a + 1 : b]}
        if inner in within:
            kind = inner
        elif outer in within:
            before = next((s for x in reversed(t[:a]) if (s := strong(x))), sos)
            kind = outer if before == outer else inner
        else:
            continue
        t[a] = t[b] = kind
        for k in (a, b):
            j = k + 1
            while j < len(t) and was[j] == "NSM":
                t[j] = kind
                j += 1


def _neutral(t: list[str], sos: str, eos: str, inner: str) -> None:
    side = lambda x: "R" if x in ("R", "EN", "AN") else "L"
    i = 0
    while i < len(t):
        if t[i] not in _NEUTRAL:
            i += 1
            continue
        end = i
        while end < len(t) and t[end] in _NEUTRAL:
            end += 1
        before = side(t[i - 1]) if i else sos
        after = side(t[end]) if end < len(t) else eos
        t[i:end] = [before if before == after else inner] * (end - i)
        i = end


def levels_of(text: str, base: int) -> list[int]:
    """Resolved levels (rules X to L1) of one paragraph at the base level."""
    original = [bidirectional(c) or "L" for c in text]
    types = list(original)
    levels = _explicit(types, base)
    for seq in _sequences(types, levels, original):
        level = levels[seq[0]]
        first, last = seq[0], seq[-1]
        before = next((levels[i] for i in range(first - 1, -1, -1) if original[i] not in _REMOVED), base)
        after = base if original[last] in _ISOLATE else next((levels[i] for i in range(last + 1, len(text)) if original[i] not in _REMOVED), base)
        sos, eos = ("R" if max(level, x) % 2 else "L" for x in (before, after))
        inner = "R" if level % 2 else "L"
        t = [types[i] for i in seq]
        was = list(t)
        _weak(t, sos)
        _brackets([text[i] for i in seq], t, was, sos, inner)
        _neutral(t, sos, eos, inner)
        for i, x in zip(seq, t, strict=True):
            if level % 2 == 0:
                levels[i] += {"R": 1, "AN": 2, "EN": 2}.get(x, 0)
            else:
                levels[i] += x in ("L", "EN", "AN")
    for i, t in enumerate(original):  # what X9 removes takes the level of what stands before it
        if t in _REMOVED:
            levels[i] = levels[i - 1] if i else base
    trailing = True
    for i in range(len(text) - 1, -1, -1):
        t = original[i]
        if t in ("B", "S"):
            levels[i], trailing = base, True
        elif t == "WS" or t in _ISOLATE or t == "PDI" or t in _REMOVED:
            if trailing:
                levels[i] = base
        else:
            trailing = False
    return levels


def reorder(text: str, rtl: bool) -> str:
    """The text in the order of rule L2, each paragraph at the direction's level."""
    if not text or (not rtl and not _MOVES.search(text)):
        return text
    out = []
    for paragraph in _PARAGRAPH.findall(text):
        if rtl and _ONE_LEVEL.fullmatch(paragraph):
            out.append(paragraph[::-1])
            continue
        levels, chars = levels_of(paragraph, int(rtl)), list(paragraph)
        order = list(range(len(chars)))
        odd = [x for x in levels if x % 2]
        for level in range(max(levels), min(odd) - 1 if odd else max(levels), -1):
            i = 0
            while i < len(order):
                if levels[order[i]] < level:
                    i += 1
                    continue
                end = i
                while end < len(order) and levels[order[end]] >= level:
                    end += 1
                order[i:end] = order[i:end][::-1]
                i = end
        out.append("".join(chars[i] for i in order))
    return "".join(out)

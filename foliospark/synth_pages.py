"""Files with the page features that plain documents lack: right-to-left lines in composite fonts with
marks, ligatures and stretched joins, columns, tags, forms, ruled tables, embedded font programs, packed
and locked objects."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from unicodedata import decomposition

from foliospark.sources import pdf_crypt
from foliospark.synth import LEADING, LINES_PER_PAGE, SIZE, TOP, PdfWriter, literal

SIMPLE_FONT = "<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding/FirstChar 0/Widths[" + "500 " * 256 + "]>>"

# How Latin text is told in Arabic letters. A vowel behind a consonant is a mark on it.
CONSONANTS, CONSONANT_LETTERS = "bcdfghjklmnpqrstvwyz", "بتدفغهجكلمنثقرسطظويز"
VOWELS, VOWEL_MARKS, VOWEL_LETTERS = "aeiou", "َُِّْ", "اعحخص"
LIGATURE, LIGATURE_TEXT = "x", "لا"
DIGITS = "٠١٢٣٤٥٦٧٨٩"
JOIN = "ـ"

_LETTER = dict(zip(CONSONANTS + VOWELS, CONSONANT_LETTERS + VOWEL_LETTERS, strict=True))
_MARK = dict(zip(VOWELS, VOWEL_MARKS, strict=True))
_INITIAL = {chr(int(d.split()[1], 16)): chr(c) for c in range(0xFE70, 0xFF00) if (d := decomposition(chr(c))).startswith("<initial>") and len(d.split()) == 2}
#: What each code of the composite font means; a letter's initial form is a code of its own.
GLYPHS = [*CONSONANT_LETTERS, *VOWEL_LETTERS, LIGATURE_TEXT, *DIGITS, JOIN, *"abcdefghijklmnopqrstuvwxyz()", *VOWEL_MARKS, *_INITIAL.values()]
_CODE = {text: code for code, text in enumerate(GLYPHS, 1)}
_FIRST_MARK = _CODE[VOWEL_MARKS[0]]
GLYPH, GAP = 6, 5  # points: the width of every glyph but marks, and of the unpainted space between words


def plain_words(line: str) -> list[str]:
    """Words of a-z and numbers, A-Z lower-cased; all else parts them."""
    return re.findall("[a-z]+|[0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))


def _units(word: str) -> list[tuple[str, str | None]]:
    """(glyph, mark) of each letter of a word, in logical order; a run of digits is one unit."""
    out = []
    for m in re.finditer(f"([{CONSONANTS}])([{VOWELS}])?|[0-9]+|.", word):
        if m[1]:
            out.append((_LETTER[m[1]], _MARK.get(m[2])))
        elif m[0].isdigit():
            out.append((m[0].translate(str.maketrans("0123456789", DIGITS)), None))
        else:
            out.append((LIGATURE_TEXT if m[0] == LIGATURE else _LETTER[m[0]], None))
    if out[0][0] in _INITIAL:
        out[0] = (_INITIAL[out[0][0]], out[0][1])
    if len(out) > 4 and out[0][1] is None and not {out[0][0][0], out[1][0][0]} & set(DIGITS):
        out.insert(1, (JOIN, None))
    return out


def is_latin(word: str) -> bool:
    """Words of two letters stay as they are."""
    return re.fullmatch("[a-z]{2}", word) is not None


def _shown(word: str, bracketed: bool) -> tuple[bytes, int]:
    """The operand of TJ that paints a word from left to right, and its width."""
    if is_latin(word):
        return b"[<%s>]" % b"".join(b"%04X" % _CODE[c] for c in word), GLYPH * len(word)
    units = _units(word)
    if bracketed:
        units = [("(", None), *units, (")", None)]
    out, width = [], 0
    for glyph, mark in units[::-1]:
        codes = [glyph] if glyph in _CODE else list(glyph)
        out.append(b"<%s>" % b"".join(b"%04X" % _CODE[c] for c in codes))
        width += GLYPH * len(codes)
        if mark:  # back into the letter, paint, and forth again
            out.append(b"250 <%04X> -250" % _CODE[mark])
    return b"[%s]" % b"".join(out), width


def _placed(words: list[str], bracketed: bool) -> tuple[list[tuple[int, bytes]], int]:
    """(distance of the left edge from the line's right edge, operand) of each word, and the line's width.
    Words go from the right; neighbouring Latin words go together, from the left."""
    rtl = not all(map(is_latin, words))
    shown = [_shown(w, bracketed and i == 0) for i, w in enumerate(words)]
    runs: list[list[int]] = []
    for i, w in enumerate(words):
        if runs and is_latin(w) and is_latin(words[i - 1]):
            runs[-1].append(i)
        else:
            runs.append([i])
    out, at = [], 0
    for run in runs if rtl else [list(range(len(words)))]:
        width = sum(shown[i][1] for i in run) + GAP * (len(run) - 1)
        left = at + width
        for i in run:
            out.append((left, shown[i][0]))
            left -= shown[i][1] + GAP
        at += width + GAP
    return out, at - GAP


def _composite_font(w: PdfWriter) -> int:
    pairs = b"".join(b"<%04X><%s>\n" % (c, t.encode("utf-16-be").hex().encode()) for t, c in _CODE.items())
    told = w.stream(b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000><FFFF> endcodespacerange\n%d beginbfchar\n%sendbfchar endcmap" % (len(_CODE), pairs))
    widths = f"[1 {_FIRST_MARK - 1} 500 {_FIRST_MARK}[{'0 ' * len(VOWEL_MARKS)}] {_FIRST_MARK + len(VOWEL_MARKS)} {len(GLYPHS)} 500]"
    child = w.add(f"<</Type/Font/Subtype/CIDFontType2/BaseFont/Synth/CIDSystemInfo<</Registry(Adobe)/Ordering(Identity)/Supplement 0>>/DW 1000/W{widths}>>")
    return w.add(f"<</Type/Font/Subtype/Type0/BaseFont/Synth/Encoding/Identity-H/DescendantFonts[{child} 0 R]/ToUnicode {told} 0 R>>")


def _file(w: PdfWriter, pages: list[tuple[bytes, str, int]], catalog_extra: str = "") -> bytes:
    """Pages of (content, resources, width); their attributes but the width are inherited."""
    tree = w.reserve()
    kids = [w.add(f"<</Type/Page/Parent {tree} 0 R/MediaBox[0 0 {width} 842]/Contents {w.stream(content)} 0 R/Resources<<{resources}>>>>") for content, resources, width in pages]
    w.set(tree, f"<</Type/Pages/Count {len(kids)}/Rotate 0/Kids[{' '.join(f'{k} 0 R' for k in kids)}]>>")
    return w.file(w.add(f"<</Type/Catalog/Pages {tree} 0 R{catalog_extra}>>"))


def _chunks(lines: list, size: int = LINES_PER_PAGE) -> list[list]:
    return [lines[i : i + size] for i in range(0, len(lines), size)]


def arabic_pdf(doc_id: int, text: str) -> bytes:
    """The text's words in Arabic letters, right-aligned; of every third document the first word of
    each line stands in brackets, if it isn't Latin."""
    w = PdfWriter()
    font = _composite_font(w)
    pages = []
    for part in _chunks([x for line in text.split("\n") if (x := plain_words(line))]):
        placed = [_placed(words, doc_id % 3 == 0 and not is_latin(words[0])) for words in part]
        right = 40 + max(width for _, width in placed)
        body = [b"BT /F1 %d Tf" % SIZE]
        for i, (shown, _) in enumerate(placed):
            body += [b"1 0 0 1 %d %d Tm %s TJ" % (right - left, TOP - LEADING * i, operand) for left, operand in shown]
        pages.append((b"\n".join([*body, b"ET"]), f"/Font<</F1 {font} 0 R>>", right + 40))
    return _file(w, pages)


def painted_lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(" ")]


def _tj(x: int, y: int, line: str) -> bytes:
    return b"1 0 0 1 %d %d Tm %s Tj" % (x, y, literal(line.encode("cp1252", "replace")))


def columns_pdf(doc_id: int, text: str) -> bytes:
    """Lines in two columns, painted row by row, where both have a line of ten characters or more; else in one."""
    w = PdfWriter()
    font = w.add(SIMPLE_FONT)
    pages = []
    for part in _chunks(painted_lines(text), 2 * LINES_PER_PAGE):
        half = -(-len(part) // 2)
        left, right = part[:half], part[half:]
        if len(part) < 4 or max(map(len, left)) < 10 or max(map(len, right)) < 10:
            left, right = part, []
        second = 60 + 6 * max(map(len, left))
        body = [b"BT /F1 %d Tf" % SIZE]
        for i, line in enumerate(left):
            body.append(_tj(0, TOP - 6 * i, line) if not right and len(left) > LINES_PER_PAGE else _tj(0, TOP - LEADING * i, line))
            if i < len(right):
                body.append(_tj(second, TOP - LEADING * i, right[i]))
        pages.append((b"\n".join([*body, b"ET"]), f"/Font<</F1 {font} 0 R>>", 612))
    return _file(w, pages)


def tagged_pdf(doc_id: int, text: str) -> bytes:
    """Lines painted from the bottom up, and tags that state their order, but for every fifth document."""
    w = PdfWriter()
    font = w.add(SIMPLE_FONT)
    catalog, tree, root, section = (w.reserve() for _ in range(4))
    kids, elements = [], []
    for part in _chunks(painted_lines(text)):
        page = w.reserve()
        body = [b"BT /F1 %d Tf" % SIZE]
        body += [b"/P <</MCID %d>> BDC %s EMC" % (i, _tj(0, TOP - LEADING * (len(part) - 1 - i), line)) for i, line in enumerate(part)]
        content = w.stream(b"\n".join([*body, b"ET"]))
        w.set(page, f"<</Type/Page/Parent {tree} 0 R/MediaBox[0 0 612 842]/Contents {content} 0 R/Resources<</Font<</F1 {font} 0 R>>>>>>")
        kids.append(page)
        elements += [w.add(f"<</S/Body/P {section} 0 R/Pg {page} 0 R/K " + (f"{i}>>" if i % 2 else f"<</Type/MCR/Pg {page} 0 R/MCID {i}>>>>")) for i in range(len(part))]
    w.set(tree, f"<</Type/Pages/Count {len(kids)}/Kids[{' '.join(f'{k} 0 R' for k in kids)}]>>")
    w.set(section, f"<</S/Sect/P {root} 0 R/K[{' '.join(f'{e} 0 R' for e in elements)}]>>")
    w.set(root, f"<</Type/StructTreeRoot/K[{section} 0 R]/RoleMap<</Body/P>>>>")
    tags = "" if doc_id % 5 == 0 else f"/StructTreeRoot {root} 0 R/MarkInfo<</Marked true>>"
    w.set(catalog, f"<</Type/Catalog/Pages {tree} 0 R{tags}>>")
    return w.file(catalog)


def forms_pdf(doc_id: int, text: str) -> bytes:
    """Of three lines the page paints one, a form the next, a form in that form the third; both
    forms are moved, scaled and have a font of their own."""
    w = PdfWriter()
    font = w.add(SIMPLE_FONT)
    pages = []
    for part in _chunks(painted_lines(text)):
        bodies: list[list[bytes]] = [[b"BT /F1 %d Tf" % SIZE], [b"BT /G1 %d Tf" % (SIZE // 2)], [b"BT /G1 %d Tf" % SIZE]]
        for i, line in enumerate(part):
            y = TOP - LEADING * i
            # The outer form doubles and lowers by 100; the inner one halves and lifts by 50 in it.
            bodies[i % 3].append(_tj(0, y, line) if i % 3 != 1 else b"1 0 0 1 0 %g Tm %s Tj" % ((y + 100) / 2, literal(line.encode("cp1252", "replace"))))
        page, outer, inner = (b"\n".join([*b, b"ET"]) for b in bodies)
        own = f"/Font<</G1 {font} 0 R>>"
        lowest = w.stream(inner, f"/Type/XObject/Subtype/Form/BBox[0 0 9999 9999]/Matrix[0.5 0 0 0.5 0 50]/Resources<<{own}>>")
        form = w.stream(b"q /In0 Do Q " + outer, f"/Type/XObject/Subtype/Form/BBox[0 0 9999 9999]/Matrix[2 0 0 2 0 -100]/Resources<<{own}/XObject<</In0 {lowest} 0 R>>>>")
        pages.append((b"q /Fm0 Do Q " + page, f"/Font<</F1 {font} 0 R>>/XObject<</Fm0 {form} 0 R>>", 612))
    return _file(w, pages)


def truetype(characters: list[str]) -> bytes:
    """A program of which glyph k + 1 draws the k-th character, by a character map of format 4."""
    segments = [(ord(c), ord(c), (g - ord(c)) & 0xFFFF) for g, c in sorted(enumerate(characters, 1), key=lambda x: x[1])] + [(0xFFFF, 0xFFFF, 1)]
    n = len(segments)
    column = lambda k: b"".join(struct.pack(">H", s[k]) for s in segments)
    body = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + column(1) + b"\0\0" + column(0) + column(2) + bytes(2 * n)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + body
    return struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + struct.pack(">4sIII", b"cmap", 0, 28, len(cmap)) + cmap


def drawn_pdf(doc_id: int, text: str) -> bytes:
    """Two-byte codes that only the embedded program explains; of every other document through a table of glyphs by code."""
    lines = [line.encode("cp1252", "replace").decode("cp1252") for line in painted_lines(text)]
    characters = sorted(set("".join(lines)))
    glyph = {c: g for g, c in enumerate(characters, 1)}
    swapped = doc_id % 2 == 1
    code = {c: len(characters) + 1 - g if swapped else g for c, g in glyph.items()}
    w = PdfWriter()
    program = w.stream(truetype(characters))
    extra = ""
    if swapped:
        extra = f"/CIDToGIDMap {w.stream(bytes(2) + b''.join(struct.pack('>H', len(characters) + 1 - k) for k in range(1, len(characters) + 1)))} 0 R"
    child = w.add(f"<</Type/Font/Subtype/CIDFontType2/BaseFont/Drawn/DW 500{extra}/FontDescriptor<</Type/FontDescriptor/FontFile2 {program} 0 R>>>>")
    font = w.add(f"<</Type/Font/Subtype/Type0/BaseFont/Drawn/Encoding/Identity-H/DescendantFonts[{child} 0 R]>>")
    pages = []
    for part in _chunks(lines):
        body = [b"BT /F1 %d Tf" % SIZE]
        body += [b"1 0 0 1 0 %d Tm <%s> Tj" % (TOP - LEADING * i, b"".join(b"%04X" % code[c] for c in line)) for i, line in enumerate(part)]
        pages.append((b"\n".join([*body, b"ET"]), f"/Font<</F1 {font} 0 R>>", 612))
    return _file(w, pages)


PITCH, ROW = 150, 20  # points: columns and rows of a ruled table


def table_pdf(title: str, header: str, rows: list[list[str]], short_rule: bool) -> bytes:
    """A title, and below it a ruled table whose first row is one cell: its inner rules begin under it.
    ``short_rule``: a rule of two fifths of the width in the second row, which divides nothing."""
    w = PdfWriter()
    font = w.add(SIMPLE_FONT)
    columns, n = len(rows[0]), len(rows) + 1
    top, left = 650, 50
    rule = lambda x0, y0, x1, y1: b"%d %d m %d %d l S" % (x0, y0, x1, y1)
    right, bottom = left + PITCH * columns, top - ROW * n
    body = [b"1 w", *(rule(left, top - ROW * k, right, top - ROW * k) for k in range(n + 1)), rule(left, top, left, bottom), rule(right, top, right, bottom)]
    body += [rule(left + PITCH * k, top - ROW, left + PITCH * k, bottom) for k in range(1, columns)]
    if short_rule:
        body.append(rule(left, top - ROW - ROW // 2, left + PITCH * columns * 2 // 5, top - ROW - ROW // 2))
    body.append(b"BT /F1 %d Tf" % SIZE)
    body += [_tj(left, top + 100, title), _tj(left + 4, top - ROW + 5, header)]
    body += [_tj(left + 4 + PITCH * c, top - ROW * (r + 2) + 5, cell) for r, row in enumerate(rows) for c, cell in enumerate(row)]
    return _file(w, [(b"\n".join([*body, b"ET"]), f"/Font<</F1 {font} 0 R>>", 800)])


class _Lock:
    """What the standard handler of revision 3 (RC4) or 4 (AES) does with streams, for an empty password."""

    def __init__(self, file_id: bytes, method: str) -> None:
        self.method, self.file_id = method, file_id
        key = hashlib.md5(pdf_crypt.PADDING + bytes(32) + b"\xfc\xff\xff\xff" + file_id).digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        self.key = key

    def dictionary(self) -> bytes:
        user = hashlib.md5(pdf_crypt.PADDING + self.file_id).digest()
        for i in range(20):
            user = pdf_crypt.rc4(bytes(b ^ i for b in self.key), user)
        filters = "" if self.method == "V2" else "/CF<</StdCF<</CFM/AESV2/Length 16>>>>/StmF/StdCF/StrF/StdCF"
        version, revision = (2, 3) if self.method == "V2" else (4, 4)
        return f"<</Filter/Standard/V {version}/R {revision}/Length 128/P -4/O<{'00' * 32}>/U<{user.hex()}{'00' * 16}>{filters}>>".encode()

    def shut(self, data: bytes, number: int) -> bytes:
        aes = self.method == "AESV2"
        key = hashlib.md5(self.key + number.to_bytes(3, "little") + bytes(2) + (b"sAlT" if aes else b"")).digest()
        if not aes:
            return pdf_crypt.rc4(key, data)
        pad = 16 - len(data) % 16
        return self.file_id + pdf_crypt.aes_encrypt(key, data + bytes([pad]) * pad, self.file_id)


def packed_pdf(doc_id: int, text: str) -> bytes:
    """Objects in an object stream, places in a cross-reference stream with a predictor; of three documents
    one is plain, one locked by RC4, one by AES, both without a password."""
    parts = _chunks(painted_lines(text))
    file_id = hashlib.md5(str(doc_id).encode()).digest()
    lock = _Lock(file_id, ("V2", "AESV2")[doc_id % 3 - 1]) if doc_id % 3 else None
    n = len(parts)
    objects = {1: "<</Type/Catalog/Pages 2 0 R>>", 2: f"<</Type/Pages/Count {n}/MediaBox[0 0 612 842]/Kids[{' '.join(f'{4 + i} 0 R' for i in range(n))}]/Resources<</Font<</F1 3 0 R>>>>>>", 3: SIMPLE_FONT}
    objects |= {4 + i: f"<</Type/Page/Parent 2 0 R/Contents {4 + n + i} 0 R>>" for i in range(n)}
    out, places = bytearray(b"%PDF-1.7\n"), {}

    def put(number: int, info: str, data: bytes, shut: bool = True) -> None:
        places[number] = len(out)
        data = zlib.compress(data)
        data = lock.shut(data, number) if lock and shut else data
        out.extend(b"%d 0 obj\n<<%s/Filter/FlateDecode/Length %d>>stream\n%s\nendstream\nendobj\n" % (number, info.encode(), len(data), data))

    for i, part in enumerate(parts):
        body = [b"BT /F1 %d Tf" % SIZE, *(_tj(0, TOP - LEADING * k, line) for k, line in enumerate(part)), b"ET"]
        put(4 + n + i, "", b"\n".join(body))
    holder, told, table = 4 + 2 * n, 5 + 2 * n, 6 + 2 * n
    head, body = "", ""
    for number, o in objects.items():
        head += f"{number} {len(body)} "
        body += o + " "
    put(holder, f"/Type/ObjStm/N {len(objects)}/First {len(head)}", (head + body).encode("latin-1"))
    if lock:
        places[told] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (told, lock.dictionary())
    at = places[table] = len(out)
    packed = {number: k for k, number in enumerate(objects)}
    rows = [struct.pack(">BIH", *((2, holder, packed[k]) if k in packed else (1, places[k], 0) if k in places else (0, 0, 0))) for k in range(table + 1)]
    up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, q, strict=True)) for r, q in zip(rows, [bytes(7), *rows[:-1]], strict=True))
    locked = f"/Encrypt {told} 0 R/ID[<{file_id.hex()}><{file_id.hex()}>]" if lock else ""
    put(table, f"/Type/XRef/Size {table + 1}/W[1 4 2]/Root 1 0 R{locked}/DecodeParms<</Predictor 12/Columns 7>>", up, shut=False)
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % at

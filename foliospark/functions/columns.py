"""Native column expressions: everything of text, color and geometry that needs no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.params import PARAMS, Params

RTL = r"[\x{0590}-\x{07BF}\x{0860}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
MARKS = r"\x{0300}-\x{036F}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{08D3}-\x{08FF}\x{FE70}-\x{FE7F}"
FORMS = r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LETTER = r"[\p{IsAlphabetic}&&[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FEFF}]&&[^\x{0640}]]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(text), F.lit(pattern)).cast("long")


def is_rtl(text: Column | str) -> Column:
    return col(text).rlike(RTL)


def presentation_forms(text: Column | str) -> Column:
    return count_matches(text, FORMS)


def replacement_characters(text: Column | str) -> Column:
    return count_matches(text, r"\x{FFFD}")


def stranded_marks(text: Column | str) -> Column:
    """Nonspacing marks that stand behind a space."""
    return count_matches(text, r" (?=\p{Mn})")


def visible_length(text: Column | str) -> Column:
    return F.length(F.regexp_replace(col(text), WHITE + "+", "")).cast("long")


def tidy_whitespace(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), WHITE + "+", " "))


def drop_mark_bases(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f" (?=[{MARKS}])", "")


def drop_joins(text: Column | str) -> Column:
    """Without the bars between two Arabic letters."""
    return F.regexp_replace(col(text), f"(?<={_LETTER})\\x{{0640}}+(?={_LETTER})", "")


def mixed_separators(text: Column | str) -> Column:
    """Whether digits are grouped in threes by more than one separator."""
    found = F.regexp_extract_all(col(text), F.lit(r"(?<=[0-9])([.,\x{060C}\x{066B}\x{066C}])(?=[0-9]{3}(?![0-9]))"), F.lit(1))
    return F.size(F.array_distinct(found)) > 1


def escape_html(text: Column | str) -> Column:
    out = col(text)
    for c, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(c), F.lit(to))
    return out


def quarter_turns(a: Column | str, b: Column | str) -> Column:
    """0 to 3: the quarter turn nearest to the direction (a, b)."""
    return F.pmod(F.round(F.degrees(F.atan2(col(b), col(a))) / 90).cast("int"), F.lit(4))


def page_rotation(degrees: Column | str) -> Column:
    turn = F.pmod(col(degrees), F.lit(360))
    return F.when(turn % 90 == 0, turn).otherwise(0).cast("int")


def rect(x0, y0, x1, y1) -> Column:
    """A box with its corners in order."""
    a, b, c, d = map(col, (x0, y0, x1, y1))
    return F.struct(F.least(a, c).alias("x0"), F.least(b, d).alias("y0"), F.greatest(a, c).alias("x1"), F.greatest(b, d).alias("y1"))


def placement(ctm: Column) -> Column:
    """The bounds of the unit square under an affine matrix of fields a to f."""
    a, b, c, d, e, f = (ctm[k] for k in "abcdef")
    xs, ys = [e, e + a, e + c, e + a + c], [f, f + b, f + d, f + b + d]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def visible_area(box: Column, page: Column) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(F.least(box["x1"], page["x1"]) - F.greatest(box["x0"], page["x0"]), zero)
    h = F.greatest(F.least(box["y1"], page["y1"]) - F.greatest(box["y0"], page["y0"]), zero)
    return F.when(box.isNotNull(), w * h)  # least and greatest pass over nulls


def area(box: Column) -> Column:
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def is_background(box: Column, page: Column, p: Params = PARAMS) -> Column:
    return F.coalesce((area(page) > 0) & (visible_area(box, page) / area(page) >= p.background_share), F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def rgb8(space: Column | str, parts: Column | str) -> Column:
    """Red, green and blue, 0 to 255, of a color (space, array of parts from 0 to 1)."""
    s, p = col(space), col(parts)
    k = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(p, F.lit(i)).cast("double")))
    byte = lambda x: F.round(x * 255).cast("int")
    ink = lambda i: byte((1 - k(i)) * (1 - k(3)))
    return (
        F.when(s == "gray", F.array(byte(k(0)), byte(k(0)), byte(k(0))))
        .when(s == "rgb", F.array(byte(k(0)), byte(k(1)), byte(k(2))))
        .when(s == "cmyk", F.array(ink(0), ink(1), ink(2)))
        .otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))
    )


def css_hex(rgb: Column | str) -> Column:
    c = col(rgb)
    return F.format_string("#%02x%02x%02x", c[0], c[1], c[2])


def worth_showing(rgb: Column | str, p: Params = PARAMS) -> Column:
    """Whether a color is neither black nor too pale to read."""
    c = col(rgb)
    light = (0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2]) / 255
    return (c[0] + c[1] + c[2] > 0) & (light <= p.pale)


def visible_color(mode: Column | str, fill: Column | str, stroke: Column | str) -> Column:
    return F.when(col(mode).isin(1, 5), col(stroke)).otherwise(col(fill))


def render_mode(n: Column | str) -> Column:
    return F.when(col(n).between(0, 7), col(n)).otherwise(0).cast("int")


def is_visible_mode(mode: Column | str) -> Column:
    """Neither invisible nor a clip without paint."""
    return ~col(mode).isin(3, 7)


def two_digits(x: Column | str) -> Column:
    """Fixed-point with two digits, for values below a thousand."""
    return F.format_number(col(x), 2)


def rule_of(rect_: Column | str, x0, y0, x1, y1, p: Params = PARAMS) -> Column:
    """The rule that a painted segment, or a thin rectangle, is: a struct, else null."""
    a, b, c, d = map(col, (x0, y0, x1, y1))
    w, h = F.abs(c - a), F.abs(d - b)
    line = (F.least(w, h) <= p.axis_tolerance) & (F.hypot(w, h) >= p.rule_length)
    make = lambda *v: F.struct(*(x.cast("double").alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)))
    flat = (h <= p.rule_thickness) & (w > h) & (w >= p.rule_length)
    upright = (w <= p.rule_thickness) & (h > w) & (h >= p.rule_length)
    return (
        F.when(~col(rect_) & line, make(a, b, c, d))
        .when(col(rect_) & flat, make(F.least(a, c), (b + d) / 2, F.greatest(a, c), (b + d) / 2))
        .when(col(rect_) & upright, make((a + c) / 2, F.least(b, d), (a + c) / 2, F.greatest(b, d)))
    )


def font_route(has_map: Column | str, has_encoding: Column | str) -> Column:
    return F.when(col(has_map), "to_unicode").when(col(has_encoding), "encoding").otherwise("none")


def image_space(name: Column | str, icc_parts: Column | str) -> Column:
    from foliospark.sources.pdf_pages import IMAGE_SPACES

    known = F.create_map(*(F.lit(x) for pair in IMAGE_SPACES.items() for x in pair))
    profile = F.when(col(icc_parts) == 1, "gray").when(col(icc_parts) == 3, "rgb").when(col(icc_parts) == 4, "cmyk").otherwise("other")
    return F.when(col(name) == "ICCBased", profile).otherwise(F.coalesce(known[col(name)], F.lit("other")))


def size_bucket(size: Column | str, p: Params = PARAMS) -> Column:
    return F.greatest(F.round(col(size) / p.size_bucket), F.lit(0)).cast("long")


def along(turn: Column | str, x: Column | str, y: Column | str) -> Column:
    """The coordinate in which text of this orientation advances."""
    return F.when(col(turn) == 0, col(x)).when(col(turn) == 1, col(y)).when(col(turn) == 2, -col(x)).otherwise(-col(y))


def across(turn: Column | str, x: Column | str, y: Column | str) -> Column:
    """The coordinate in which lines of this orientation follow each other."""
    return F.when(col(turn) == 0, col(y)).when(col(turn) == 1, -col(x)).when(col(turn) == 2, -col(y)).otherwise(col(x))


def text_string(data: Column | str) -> Column:
    """A PDF text string: UTF-16BE after its mark, else Latin-1."""
    marked = F.expr("x'FEFF'")
    return F.when(F.substring(col(data), 1, 2) == marked, F.decode(F.substring(col(data), 3, 1 << 30), "UTF-16BE")).otherwise(F.decode(col(data), "ISO-8859-1"))


def resolution_rate(unresolved: Column | str, glyphs: Column | str) -> Column:
    return F.when(col(glyphs) > 0, 1 - col(unresolved) / col(glyphs)).otherwise(1.0)


def flatten_differences(items: Column | str) -> Column:
    """(code, name) of an array of (code or null, name or null): a code sets the count, a name takes it;
    codes over 255 only count."""
    start = F.struct(F.lit(0).alias("code"), F.array().cast("array<struct<code:int,name:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = F.array(F.struct(acc["code"].alias("code"), x["name"].alias("name")))
        code = F.when(x["name"].isNull(), F.greatest(x["code"], F.lit(0))).otherwise(acc["code"] + 1)
        return F.struct(code.cast("int").alias("code"), F.when(x["name"].isNotNull() & (acc["code"] <= 255), F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(col(items), start, step)["out"]

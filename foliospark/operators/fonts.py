"""Code-to-text operators over tables of maps, encodings and glyph programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.font_text import MAX_DISAGREEMENT, MIN_CONFUSIONS, MIN_SAMPLE, SEPARATORS, VARIANTS
from foliospark.functions.truetype import MIRRORED, TATWEEL


def used_codes(glyphs: DataFrame) -> DataFrame:
    """The codes that each font paints; a map is looked up for these alone, never expanded."""
    return glyphs.select("font_key", "code").distinct()


def cmap_lookup(codes: DataFrame, single: DataFrame, ranges: DataFrame) -> DataFrame:
    """(font_key, code, mapped): single codes (code, text) win; then the first range (seq, lo, hi, dst or
    dst_list) that has an answer. A range's text moves on in its last character."""
    one = single.groupBy("font_key", "code").agg(F.first("text").alias("one"))
    step = F.col("code") - F.col("lo")
    point = F.ascii(F.substring("dst", -1, 1)) + step
    bumped = F.when(F.length("dst") == 0, F.col("dst")).when((point > 0x10FFFF) | point.between(0xD800, 0xDFFF), F.col("dst")).otherwise(F.concat(F.expr("left(dst, length(dst) - 1)"), code_point(point)))
    answer = F.when(F.col("dst_list").isNull(), bumped).otherwise(F.get("dst_list", step.cast("int")))
    hits = codes.join(ranges, "font_key").where(F.col("code").between(F.col("lo"), F.col("hi"))).withColumn("answer", answer).where("answer IS NOT NULL")
    many = hits.groupBy("font_key", "code").agg(F.min_by("answer", "seq").alias("many"))
    out = codes.join(one, ["font_key", "code"], "left").join(many, ["font_key", "code"], "left")
    return out.select("font_key", "code", F.coalesce("one", "many").alias("mapped"))


def code_point(n: Column) -> Column:
    """The character of a code point, beyond Latin-1 too."""
    high, low = F.floor((n - 0x10000) / 1024) + 0xD800, F.pmod(n - 0x10000, F.lit(1024)) + 0xDC00
    unit = lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")
    return F.decode(F.unhex(F.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))), "UTF-16BE")


def cmap_sizes(single: DataFrame, ranges: DataFrame) -> DataFrame:
    """(font_key, codes): how many codes a map has; a range that ends before it begins has one."""
    a = single.groupBy("font_key").agg(F.count_distinct("code").alias("n"))
    b = ranges.groupBy("font_key").agg(F.sum(F.greatest(F.col("hi") - F.col("lo"), F.lit(0)) + 1).alias("n"))
    return a.unionByName(b).groupBy("font_key").agg(F.sum("n").alias("codes"))


def encoding_lookup(codes: DataFrame, base: DataFrame, differences: DataFrame) -> DataFrame:
    """(font_key, code, encoded): a difference (name_text, null if unknown) wins even if unknown; codes
    over 255 have nothing. ``base``: font_key, code, text."""
    rows = codes.join(base.withColumnRenamed("text", "base_text"), ["font_key", "code"], "left")
    rows = rows.join(differences.withColumn("differs", F.lit(True)), ["font_key", "code"], "left")
    text = F.when(F.col("code") > 255, None).when(F.col("differs"), F.col("name_text")).otherwise(F.col("base_text"))
    return rows.select("font_key", "code", text.alias("encoded"))


def glyph_of(codes: DataFrame, cid_to_gid: DataFrame) -> DataFrame:
    """(font_key, code, gid): through a font's table; codes past it, and glyph 0, are none."""
    return codes.join(cid_to_gid, ["font_key", "code"], "left").select("font_key", "code", F.nullif("gid", F.lit(0)).alias("gid"))


def prefer_forms(pairs: DataFrame) -> DataFrame:
    """(font_key, gid, drawn): of a glyph's characters (point) a presentation form wins, then the lower."""
    form = F.col("point").between(0xFB50, 0xFDFF) | F.col("point").between(0xFE70, 0xFEFF)
    private = F.col("point").between(0xE000, 0xF8FF) | (F.col("point") >= 0xF0000)
    good = pairs.where((F.col("gid") != 0) & ~private)
    return good.groupBy("font_key", "gid").agg(code_point(F.min_by("point", F.struct(~form, "point"))).alias("drawn"))


def arbitrate_separators(rows: DataFrame) -> DataFrame:
    """(font_key, code, corrected): where map (mapped) and names (named) give different separators."""
    known = [F.lit(c) for c in sorted(SEPARATORS)]
    both = F.col("mapped").isin(*known) & F.col("named").isin(*known) & F.col("code").between(0, 255)
    return rows.where(both & (F.col("mapped") != F.col("named"))).select("font_key", "code", F.col("named").alias("corrected"))


def _variant(c: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in VARIANTS.items() for x in pair))[c]


def digit_value(c: Column) -> Column:
    n = F.ascii(c)
    return F.when(n.between(0x30, 0x39), n - 0x30).when(n.between(0x660, 0x669), n - 0x660).when(n.between(0x6F0, 0x6F9), n - 0x6F0)


def same_meaning(a: Column, b: Column, fold_a: Column, fold_b: Column) -> Column:
    """Whether two characters (and their NFKC folds) say the same."""
    pair = F.concat(F.least(a, b), F.greatest(a, b))
    tests = (fold_a == fold_b, _variant(fold_a) == _variant(fold_b), digit_value(a) == digit_value(b), pair.isin(",\u066c", ".\u066b"))
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _letter(fold: Column) -> Column:
    n = F.ascii(fold)
    return F.when((F.length(fold) == 1) & (n.between(0x621, 0x63A) | n.between(0x641, 0x64A)), fold)


def map_verdicts(rows: DataFrame) -> DataFrame:
    """(font_key, compared, disagreed, confused, wrong): whether a map contradicts what the font draws.

    ``rows``: font_key, code, mapped, drawn and their NFKC folds mapped_fold and drawn_fold."""
    good = rows.where((F.length("mapped") == 1) & F.col("drawn").isNotNull() & ~F.col("drawn").isin(*sorted(MIRRORED)))
    differ = ~same_meaning(F.col("mapped"), F.col("drawn"), F.col("mapped_fold"), F.col("drawn_fold"))
    drawn, named = _letter(F.col("drawn_fold")), _letter(F.col("mapped_fold"))
    mixed = differ & drawn.isNotNull() & (F.col("mapped").rlike(r"^\s$") | F.coalesce(named != drawn, F.lit(False)))
    out = good.groupBy("font_key").agg(F.count("*").alias("compared"), F.count_if(differ).alias("disagreed"), F.count_if(mixed).alias("confused"))
    wrong = (F.col("compared") >= MIN_SAMPLE) & ((F.col("disagreed") > F.col("compared") * MAX_DISAGREEMENT) | (F.col("confused") >= MIN_CONFUSIONS))
    return out.withColumn("wrong", wrong)


def decode_chain(rows: DataFrame) -> DataFrame:
    """Adds ``text``: correction, a drawn bar, the drawn character of a font whose map is wrong (unless
    the map says more: ``resolves``), then map, encoding, glyph name and drawn character."""
    c = F.col
    distrust = c("wrong") & c("drawn").isNotNull() & ~c("drawn").isin(*sorted(MIRRORED))
    by_program = F.when(distrust, F.when(c("resolves") & c("mapped").isNotNull(), c("mapped")).otherwise(c("drawn")))
    text = F.coalesce(c("corrected"), F.when(c("drawn") == TATWEEL, F.lit(TATWEEL)), by_program, c("mapped"), c("encoded"), c("named"), c("drawn"))
    return rows.withColumn("text", text)


def simple_widths(codes: DataFrame, fonts: DataFrame) -> DataFrame:
    """(font_key, code, width) in ems, of fonts (first_char, widths, missing_width)."""
    at = (F.col("code") - F.col("first_char")).cast("int")
    own = F.when(at >= 0, F.get("widths", at))
    return codes.join(fonts, "font_key").select("font_key", "code", (F.coalesce(own, "missing_width") / 1000).alias("width"))


def cid_widths(codes: DataFrame, ranges: DataFrame, defaults: DataFrame) -> DataFrame:
    """(font_key, code, width) in ems: the first range (seq, lo, hi, w) that has the code, else the default."""
    hits = codes.join(ranges, "font_key").where(F.col("code").between(F.col("lo"), F.col("hi"))).groupBy("font_key", "code").agg(F.min_by("w", "seq").alias("w"))
    return codes.join(defaults, "font_key").join(hits, ["font_key", "code"], "left").select("font_key", "code", (F.coalesce("w", "default_width") / 1000).alias("width"))


def resolvable(fonts: DataFrame) -> DataFrame:
    """Fonts (map_codes, base_encoding, n_differences) with a map or an encoding."""
    return fonts.withColumn("resolvable", (F.col("map_codes") > 0) | F.col("base_encoding").isin("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding", "PDFDocEncoding") | (F.col("n_differences") > 0))

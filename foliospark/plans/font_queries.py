"""Queries over code-to-text tables."""

from __future__ import annotations



import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import columns as C
from foliospark.functions import text_udfs as U
from foliospark.functions.glyph_names import BASE
from foliospark.operators import fonts as T
from foliospark.session import prepare, table

BRAND = "p_brand"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is a font, its parts' keys below 400 are its codes."""
    return table(spark, sf_dir, "part").select(F.col(BRAND).alias("font_key"), (F.col("p_partkey") % 400).cast("int").alias("code")).distinct()


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each font maps 100-149 upwards from A; a short list from 120 and a range from 100 overlap; 7 and
    120 are single codes."""
    fonts = _codes(spark, sf_dir).select("font_key").distinct()
    single = fonts.select("font_key", F.explode(F.array(F.struct(F.lit(7).alias("code"), F.lit("lam").alias("text")), F.struct(F.lit(120).alias("code"), F.lit("one").alias("text")))).alias("s")).select("font_key", "s.*")
    many = "array<string>"
    row = lambda seq, lo, hi, dst, dsts: F.struct(F.lit(seq).alias("seq"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(dst).cast("string").alias("dst"), (F.array(*map(F.lit, dsts)) if dsts else F.lit(None)).cast(many).alias("dst_list"))
    ranges = fonts.select("font_key", F.explode(F.array(row(0, 118, 125, None, ["p", "q", "r", "s"]), row(1, 100, 149, "A", None), row(2, 140, 399, "xا", None))).alias("r")).select("font_key", "r.*")
    return single, ranges


def cmap_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cmap_lookup(_codes(spark, sf_dir), *_ranges(spark, sf_dir))


def cmap_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cmap_sizes(*_ranges(spark, sf_dir))


def _base(spark: SparkSession, name: str = "WinAnsiEncoding") -> DataFrame:
    return spark.createDataFrame([(code, text) for code, text in BASE[name].items()], "code int, text string")


def base_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tables of the three base encodings."""
    out = None
    for name in BASE:
        rows = _base(spark, name).select(F.lit(name).alias("encoding"), "code", "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def encoding_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes through WinAnsi, with a known difference at multiples of 10 and an unknown one at those of 15."""
    codes = _codes(spark, sf_dir)
    plain = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(t).alias("text")) for c, t in BASE["WinAnsiEncoding"].items()))
    base = codes.select("font_key").distinct().select("font_key", F.explode(plain).alias("b")).select("font_key", "b.*")
    n = F.col("code")
    differences = codes.where((n % 10 == 0) | (n % 15 == 0)).select("font_key", "code", F.when(n % 15 == 0, F.lit(None).cast("string")).otherwise("diff").alias("name_text"))
    return T.encoding_lookup(codes, base, differences)


def glyph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uniXXXX names of code points, with suffixes and joined parts; every seventh has an unknown part."""
    prepare(spark)
    key = F.col("p_partkey")
    hex_ = lambda n: F.lpad(F.hex(n), 4, "0")
    name = F.concat(F.lit("uni"), hex_(key % 500 + 65), F.lit("_u"), hex_(key % 300 + 1000), F.when(key % 3 == 0, ".alt").otherwise(""), F.when(key % 7 == 0, "").otherwise(""))
    name = F.when(key % 7 == 0, F.concat(F.lit("uni"), hex_(key % 500 + 65), F.lit("_nosuchname"))).otherwise(name)
    return table(spark, sf_dir, "part").select("p_partkey", U.glyph_name_text(name).alias("text"))


#: Greek letters by their names in the glyph list, with their code points.
GREEK = dict(zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(), (*range(945, 956), *range(957, 962), *range(963, 970)), strict=True))


def script_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of Cyrillic, Hebrew, Arabic and Greek letters, and names that say nothing."""
    prepare(spark)
    k = F.floor(F.col("p_partkey") / 6)
    numbered = lambda first, n: F.concat(F.lit("afii"), (first + k % n).cast("string"))
    names = F.array(*map(F.lit, GREEK))
    kinds = (numbered(10017, 6), numbered(10072, 26), numbered(57664, 27), numbered(57409, 26), F.concat(F.get(names, (k % len(GREEK)).cast("int")), F.lit(".alt")), F.concat(F.lit("g"), k.cast("string")))
    name = F.get(F.array(*kinds), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", U.glyph_name_text(name).alias("text"))


def glyph_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for codes below 300, that gives every fifth code glyph 0."""
    codes = _codes(spark, sf_dir)
    gids = codes.where("code < 300").select("font_key", "code", F.when(F.col("code") % 5 == 0, 0).otherwise(F.col("code") + 3).cast("int").alias("gid"))
    return T.glyph_of(codes, gids)


def prefer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a glyph's characters a presentation form wins, else the lowest."""
    n = F.col("p_partkey")
    point = F.when(n % 2 == 0, F.lit(0x0620) + n % 31).when(n % 3 == 0, F.lit(0xFE80) + n % 50).otherwise(F.lit(0xE000) + n % 9)
    pairs = table(spark, sf_dir, "part").select(F.col(BRAND).alias("font_key"), (n % 50).cast("int").alias("gid"), point.cast("int").alias("point"))
    return T.prefer_forms(pairs).select("font_key", "gid", "drawn")


def separator_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*map(F.lit, (",", ".", "،", "٫", "٬", "a")))
    rows = _codes(spark, sf_dir).select("font_key", "code", F.get(marks, F.col("code") % 6).alias("mapped"), F.get(marks, F.floor(F.col("code") / 6).cast("int") % 6).alias("named"))
    return T.arbitrate_separators(rows)


def map_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of letters; in brands with an odd last digit every second code is shifted by one."""
    shift = F.when((F.substring("font_key", -1, 1).cast("int") % 2 == 1) & (F.col("code") % 2 == 0), 1).otherwise(0)
    letter = lambda k: T.code_point(F.lit(0x0628) + k % 7)
    rows = _codes(spark, sf_dir).select("font_key", "code", letter(F.col("code") + shift).alias("mapped"), letter(F.col("code")).alias("drawn"))
    return T.map_verdicts(rows.withColumns({"mapped_fold": F.col("mapped"), "drawn_fold": F.col("drawn")}))


def decode_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are there by the code's divisors, so that each step of the chain decides somewhere."""
    n = F.col("code")
    has = lambda k, text: F.when(n % k == 0, text)
    rows = _codes(spark, sf_dir).withColumns(
        {
            "corrected": has(31, "."),
            "drawn": F.when(n % 17 == 0, "ـ").when(n % 3 == 0, "ب").when(n % 19 == 0, "("),
            "wrong": F.substring("font_key", -1, 1).cast("int") % 2 == 1,
            "resolves": n % 4 == 0,
            "mapped": has(2, "m"),
            "encoded": has(5, "e"),
            "named": has(7, "n"),
        }
    )
    return T.decode_chain(rows).select("font_key", "code", "text")


def simple_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = _codes(spark, sf_dir).select("font_key").distinct().select("font_key", F.lit(32).alias("first_char"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: (k * 10).cast("double")).alias("widths"), F.lit(250.0).alias("missing_width"))
    return T.simple_widths(_codes(spark, sf_dir), fonts)


def cid_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = _codes(spark, sf_dir).select("font_key").distinct()
    row = lambda seq, lo, hi, w: F.struct(F.lit(seq).alias("seq"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(w).alias("w"))
    ranges = fonts.select("font_key", F.explode(F.array(row(0, 10, 20, 600.0), row(1, 15, 90, 400.0), row(2, 50, 50, 9.0))).alias("r")).select("font_key", "r.*")
    return T.cid_widths(_codes(spark, sf_dir), ranges, fonts.withColumn("default_width", F.lit(1000.0)))


def font_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    fonts = table(spark, sf_dir, "part").select("p_partkey", (n % 2 == 0).alias("map"), (n % 3 == 0).alias("enc"), (n % 2 * (n % 5)).alias("map_codes"), F.when(n % 3 == 0, "WinAnsiEncoding").when(n % 3 == 1, "Identity-H").alias("base_encoding"), F.lit(0).alias("n_differences"))
    return T.resolvable(fonts).select("p_partkey", C.font_route("map", "enc").alias("route"), F.coalesce("resolvable", F.lit(False)).alias("resolvable"))


def image_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("DeviceGray", "RGB", "CMYK", "I", "ICCBased", "Separation")))
    n = F.col("p_partkey").cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", C.image_space(F.get(names, n % 6), n % 5).alias("space"))


def used_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    glyphs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 9).alias("font_key"), (F.col("l_partkey") % 300).alias("code"))
    return T.used_codes(glyphs)


# What binary readers make of bytes that are built for each brand: rows only, the tests look inside.
def _by_bytes(spark: SparkSession, sf_dir: str, read, ddl: str) -> DataFrame:
    prepare(spark)
    fonts = _codes(spark, sf_dir).select("font_key").distinct()

    def told(batches):
        for b in batches:
            rows = [(k, *r) for k in b.column("font_key").to_pylist() for r in read(k)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in ddl.split(", ")])

    return fonts.mapInArrow(told, ddl)


def png_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(key: str):
        import numpy as np

        from foliospark.functions.pictures import cmyk_to_rgb, png

        ink = np.frombuffer((key * 16).encode()[:64], np.uint8).reshape(4, 4, 4)
        yield (png(cmyk_to_rgb(ink)),)

    return _by_bytes(spark, sf_dir, read, "font_key string, data binary")


def cmap_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A character map's text, parsed; its answers for the codes that it maps."""

    def read(key: str):
        from foliospark.functions.cmap import parse_cmap

        n = sum(key.encode()) % 20
        source = f"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <{n:04X}> <0627> endbfchar 1 beginbfrange <0100> <{0x100 + n:04X}> <0041> endbfrange"
        m = parse_cmap(source.encode())
        yield from ((c, m.get(c)) for c in (n, *range(0x100, 0x101 + n)))

    return _by_bytes(spark, sf_dir, read, "font_key string, code long, text string")


QUERIES = {
    f.__name__: f
    for f in (
        cmap_lookup, cmap_size, base_encodings, encoding_decode, glyph_names, script_names, glyph_of, prefer_forms, separator_arbitration, map_verdict, decode_chain, simple_widths, cid_widths,
        font_routes, image_spaces, used_codes, png_images, cmap_texts,
    )
}
_CODES = "WITH k AS (SELECT DISTINCT p_brand AS font_key, (p_partkey % 400)::INT AS code FROM part)"
#: Code and code point where the code page differs from Latin-1, by the published code pages.
_WINANSI_HIGH = """(128, 8364), (130, 8218), (131, 402), (132, 8222), (133, 8230), (134, 8224), (135, 8225), (136, 710), (137, 8240), (138, 352), (139, 8249), (140, 338), (142, 381), (145, 8216),
(146, 8217), (147, 8220), (148, 8221), (149, 8226), (150, 8211), (151, 8212), (152, 732), (153, 8482), (154, 353), (155, 8250), (156, 339), (158, 382), (159, 376)"""
_MACROMAN_HIGH = """(128, 196), (129, 197), (130, 199), (131, 201), (132, 209), (133, 214), (134, 220), (135, 225), (136, 224), (137, 226), (138, 228), (139, 227), (140, 229), (141, 231),
(142, 233), (143, 232), (144, 234), (145, 235), (146, 237), (147, 236), (148, 238), (149, 239), (150, 241), (151, 243), (152, 242), (153, 244), (154, 246), (155, 245),
(156, 250), (157, 249), (158, 251), (159, 252), (160, 8224), (161, 176), (162, 162), (163, 163), (164, 167), (165, 8226), (166, 182), (167, 223), (168, 174), (169, 169),
(170, 8482), (171, 180), (172, 168), (173, 8800), (174, 198), (175, 216), (176, 8734), (177, 177), (178, 8804), (179, 8805), (180, 165), (181, 181), (182, 8706), (183, 8721),
(184, 8719), (185, 960), (186, 8747), (187, 170), (188, 186), (189, 937), (190, 230), (191, 248), (192, 191), (193, 161), (194, 172), (195, 8730), (196, 402), (197, 8776),
(198, 8710), (199, 171), (200, 187), (201, 8230), (202, 160), (203, 192), (204, 195), (205, 213), (206, 338), (207, 339), (208, 8211), (209, 8212), (210, 8220), (211, 8221),
(212, 8216), (213, 8217), (214, 247), (215, 9674), (216, 255), (217, 376), (218, 8260), (219, 8364), (220, 8249), (221, 8250), (222, 64257), (223, 64258), (224, 8225), (225, 183),
(226, 8218), (227, 8222), (228, 8240), (229, 194), (230, 202), (231, 193), (232, 203), (233, 200), (234, 205), (235, 206), (236, 207), (237, 204), (238, 211), (239, 212),
(240, 63743), (241, 210), (242, 218), (243, 219), (244, 217), (245, 305), (246, 710), (247, 732), (248, 175), (249, 728), (250, 729), (251, 730), (252, 184), (253, 733),
(254, 731), (255, 711)"""
ORACLE_SQL = {
    "cmap_lookup": _CODES
    + """SELECT font_key, code, CASE WHEN code = 7 THEN 'lam' WHEN code = 120 THEN 'one' WHEN code BETWEEN 118 AND 121 THEN substr('pqrs', code - 117, 1) WHEN code BETWEEN 100 AND 149 THEN chr(65 + code - 100)
 WHEN code BETWEEN 140 AND 399 THEN 'x' || chr(1575 + code - 140) END AS mapped FROM k""",
    "cmap_size": "SELECT DISTINCT p_brand AS font_key, (2 + 8 + 50 + 260)::BIGINT AS codes FROM part",
    "base_encodings": f"""
SELECT e AS encoding, c::INT AS code, CASE WHEN e = 'StandardEncoding' AND c = 39 THEN chr(8217) WHEN e = 'StandardEncoding' AND c = 96 THEN chr(8216) ELSE chr(c::INT) END AS text
 FROM (VALUES ('WinAnsiEncoding'), ('MacRomanEncoding'), ('StandardEncoding')) v(e), range(32, 256) r(c) WHERE c <= 126 OR (c >= 160 AND e = 'WinAnsiEncoding')
UNION ALL SELECT 'WinAnsiEncoding', c, chr(p) FROM (VALUES {_WINANSI_HIGH}) w(c, p) UNION ALL SELECT 'MacRomanEncoding', c, chr(p) FROM (VALUES {_MACROMAN_HIGH}) m(c, p)""",
    "encoding_decode": _CODES
    + f"""SELECT font_key, code, CASE WHEN code > 255 OR code % 15 = 0 THEN NULL WHEN code % 10 = 0 THEN 'diff' WHEN code BETWEEN 32 AND 126 OR code BETWEEN 160 AND 255 THEN chr(code) ELSE chr(p) END AS encoded
 FROM k LEFT JOIN (VALUES {_WINANSI_HIGH}) w(c, p) ON c = code""",
    "glyph_names": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN chr((p_partkey % 500 + 65)::INT) || chr((p_partkey % 300 + 1000)::INT) END AS text FROM part",
    "script_names": f"""
WITH p AS (SELECT p_partkey, p_partkey % 6 AS kind, p_partkey // 6 AS k FROM part)
SELECT p_partkey, chr(CASE kind WHEN 0 THEN 1040 + k % 6 WHEN 1 THEN 1078 + k % 26 WHEN 2 THEN 1488 + k % 27 WHEN 3 THEN 1569 + k % 26 WHEN 4 THEN {list(GREEK.values())}[k % {len(GREEK)} + 1] END::INT) AS text FROM p""",
    "glyph_of": _CODES + "SELECT font_key, code, CASE WHEN code < 300 AND code % 5 <> 0 THEN code + 3 END::INT AS gid FROM k",
    "prefer_forms": """
WITH p AS (SELECT p_brand AS font_key, (p_partkey % 50)::INT AS gid, CASE WHEN p_partkey % 2 = 0 THEN 1568 + p_partkey % 31 WHEN p_partkey % 3 = 0 THEN 65152 + p_partkey % 50 ELSE 0 END::INT AS point FROM part)
SELECT font_key, gid, chr(arg_min(point, CASE WHEN point >= 65136 THEN 0 ELSE 100000 END + point)) AS drawn FROM p WHERE gid <> 0 AND point <> 0 GROUP BY font_key, gid""",
    "separator_arbitration": _CODES
    + """, m AS (SELECT font_key, code, [',', '.', chr(1548), chr(1643), chr(1644), 'a'] AS s FROM k), v AS (SELECT font_key, code, s[code % 6 + 1] AS a, s[code // 6 % 6 + 1] AS b FROM m)
SELECT font_key, code, b AS corrected FROM v WHERE code <= 255 AND a <> 'a' AND b <> 'a' AND a <> b""",
    "map_verdict": _CODES
    + """, v AS (SELECT font_key, count(*) AS n, count_if(right(font_key, 1)::INT % 2 = 1 AND code % 2 = 0) AS d FROM k GROUP BY font_key)
SELECT font_key, n AS compared, d::BIGINT AS disagreed, d::BIGINT AS confused, n >= 8 AND (3 * d > n OR d >= 3) AS wrong FROM v""",
    "decode_chain": _CODES
    + """SELECT font_key, code, CASE WHEN code % 31 = 0 THEN '.' WHEN code % 17 = 0 THEN chr(1600)
 WHEN right(font_key, 1)::INT % 2 = 1 AND code % 3 = 0 THEN CASE WHEN code % 4 = 0 THEN 'm' ELSE chr(1576) END
 WHEN code % 2 = 0 THEN 'm' WHEN code % 5 = 0 THEN 'e' WHEN code % 7 = 0 THEN 'n' WHEN code % 3 = 0 THEN chr(1576) WHEN code % 19 = 0 THEN '(' END AS text FROM k""",
    "simple_widths": _CODES + "SELECT font_key, code, CASE WHEN code BETWEEN 32 AND 131 THEN (code - 32) * 10 ELSE 250 END / 1000.0::DOUBLE AS width FROM k",
    "cid_widths": _CODES + "SELECT font_key, code, CASE WHEN code BETWEEN 10 AND 20 THEN 600 WHEN code BETWEEN 15 AND 90 THEN 400 ELSE 1000 END / 1000.0::DOUBLE AS width FROM k",
    "font_routes": """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'to_unicode' WHEN p_partkey % 3 = 0 THEN 'encoding' ELSE 'none' END AS route, p_partkey % 2 * (p_partkey % 5) > 0 OR p_partkey % 3 = 0 AS resolvable FROM part""",
    "image_spaces": """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'gray' WHEN 1 THEN 'rgb' WHEN 2 THEN 'cmyk' WHEN 3 THEN 'indexed' WHEN 4 THEN CASE p_partkey % 5 WHEN 1 THEN 'gray' WHEN 3 THEN 'rgb' WHEN 4 THEN 'cmyk' ELSE 'other' END ELSE 'other' END AS space FROM part""",
    "cmap_texts": """
WITH f AS (SELECT DISTINCT p_brand AS font_key FROM part), n AS (SELECT font_key, list_sum(list_transform(string_split(font_key, ''), lambda c: ord(c)))::BIGINT % 20 AS n FROM f)
SELECT font_key, n::BIGINT AS code, chr(1575) AS text FROM n UNION ALL SELECT font_key, (256 + unnest(range(n + 1)))::BIGINT AS code, chr((65 + unnest(range(n + 1)))::INT) AS text FROM n""",
    "used_codes": "SELECT DISTINCT l_suppkey % 9 AS font_key, l_partkey % 300 AS code FROM lineitem",
}

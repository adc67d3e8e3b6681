import pytest
from pyspark.sql import functions as F

from foliospark.functions import columns as C
from foliospark.functions import text_udfs as U
from foliospark.operators import detect, document, extract, render
from foliospark.synth import simple_pdf

FIELDS = ("glyph_count", "unresolved", "font_count", "unmappable_fonts", "invisible_glyphs", "residual_presentation_forms", "replacement_chars", "text_len", "visible_text_len", "mixed_digit_separators", "image_coverage")
HEALTHY = dict(zip(FIELDS, (500, 0, 3, 0, 0, 0, 0, 480, 400, False, 0.0), strict=True))
DDL = ", ".join(f"{f} {'boolean' if f == 'mixed_digit_separators' else 'double' if f == 'image_coverage' else 'long'}" for f in FIELDS)
CASES = [
    ({}, "ok", 1.0, 0),
    ({"glyph_count": 0, "text_len": 0, "visible_text_len": 0}, "needs_ocr", 0.0, 1),
    ({"glyph_count": 4, "text_len": 4, "visible_text_len": 3, "image_coverage": 0.84}, "needs_ocr", 0.0, 1),
    ({"glyph_count": 10, "text_len": 10, "visible_text_len": 10, "image_coverage": 1.0}, "degraded", 1.0, 1),
    ({"unresolved": 300}, "needs_ocr", 0.0, 1),
    ({"unresolved": 50, "replacement_chars": 50}, "degraded", 0.9 - 50 / 480, 1),
    ({"unmappable_fonts": 3}, "degraded", 0.8, 1),
    ({"residual_presentation_forms": 480}, "degraded", 0.5, 1),
    ({"invisible_glyphs": 460}, "degraded", 0.9, 1),
    ({"invisible_glyphs": 450}, "ok", 1.0, 0),
    ({"mixed_digit_separators": True}, "degraded", 1.0, 1),
    ({"text_len": 1, "visible_text_len": 1}, "needs_ocr", 0.0, 1),
    ({"unresolved": 50, "unmappable_fonts": 1, "mixed_digit_separators": True}, "degraded", 0.9 - 0.2 / 3, 3),
]


def test_verdicts(spark):
    rows = [tuple((HEALTHY | change).values()) for change, *_ in CASES]
    got = detect.verdicts(spark.createDataFrame(rows, DDL).coalesce(1)).collect()
    for r, (_, verdict, confidence, reasons) in zip(got, CASES, strict=True):
        assert (r["verdict"], len(r["reasons"])) == (verdict, reasons) and r["confidence"] == pytest.approx(confidence)
    assert got[2]["reasons"][0].startswith("images cover 84% of the page and it has almost no text (3 characters)")
    assert got[5]["reasons"] == ["50 of 500 glyph codes unresolved"]


@pytest.mark.parametrize(("text", "mixed"), [("3.709 and 3,900", True), ("1,234 and 5,678", False), ("3,709 and 0.5", False), ("3,709 and 0.12345", False), ("1٬234 1,234", True), ("", False), ("1,2345 1.234", False)])
def test_mixed_separators(spark, text, mixed):
    assert spark.createDataFrame([(text,)], "t string").select(C.mixed_separators("t")).first()[0] is mixed


def test_text_columns(spark):
    df = spark.createDataFrame([("a　\t b\n", "بـب ـ", "ب َ", "<a href='x'>&\"", "ﻻ ﻭ�")], "w string, b string, m string, h string, f string")
    r = df.select(C.tidy_whitespace("w"), C.drop_joins("b"), C.drop_mark_bases("m"), C.escape_html("h"), C.presentation_forms("f"), C.replacement_characters("f"), C.is_rtl("f"), C.visible_length("w")).first()
    assert tuple(r) == ("a b", "بب ـ", "بَ", "&lt;a href=&#39;x&#39;&gt;&amp;&quot;", 2, 1, True, 2)


def test_functions_for_sql(spark):
    U.register(spark)
    assert spark.sql("SELECT normalize_nfkc('ﻻ'), bidi_reorder('אב 1', true), unify_digits('20١7'), logical_text('ﻻﻭ'), glyph_name_text('uni0627'), normalize_nfkc(NULL)").first() == ("لا", "1 בא", "2017", "ولا", "ا", None)
    df = spark.createDataFrame([("لا", "إ"), ("اا", "إ"), ("x", "y")], "h string, o string")
    assert [r[0] for r in df.select(U.merge_overlay("h", "o")).collect()] == ["لإ", None, None]
    assert [r[0] for r in spark.createDataFrame([(" َ",), ("a",), (None,)], "t string").select(U.is_mark("t")).collect()] == [True, False, None]


def test_native_rules_agree_with_the_interpreter(spark):
    from foliospark.functions.interpreter import rule_of

    rows = [(k % 2 == 0, float(k % 5), float(k % 3), float(k % 5 + k % 7), float(k % 3 + k % 6)) for k in range(200)]
    df = spark.createDataFrame(rows, "r boolean, a double, b double, c double, d double").coalesce(1)
    got = [tuple(x[0]) if x[0] else None for x in df.select(C.rule_of("r", "a", "b", "c", "d")).collect()]
    assert got == [rule_of(*r) for r in rows]


def table_page(spark):
    grid = b" ".join(b"0 %d m 400 %d l S" % (y, y) for y in (0, 40, 80)) + b" " + b" ".join(b"%d 0 m %d 80 l S" % (x, x) for x in (0, 200, 400))
    cells = b" ".join(b"BT /F1 12 Tf %d %d Td (<cell>%d%dtext) Tj ET" % (200 * c + 20, 50 - 40 * r, r, c) for r in range(2) for c in range(2))
    head = b"BT /F1 24 Tf 1 0 0 rg 0 300 Td (Head & line) Tj ET 0 g BT /F1 12 Tf 0 200 Td (Body text that is longer than the heading is) Tj ET "
    files = [("f.pdf", bytearray(simple_pdf([{"content": head + grid + b" " + cells}, {"content": b""}]))), ("bad.pdf", bytearray(b"junk"))]
    return extract.extract(spark.createDataFrame(files, "doc_id string, content binary"))


def test_corpus_tables_and_renderings(spark):
    pages = table_page(spark).persist()
    judged = detect.judged(pages)
    assert [(r["doc_id"], r["error"]) for r in pages.where("error IS NOT NULL").collect()] == [("bad.pdf", "no PDF header")]
    cells = extract.cells_of(pages).orderBy("row", "column").collect()
    assert [c["text"] for c in cells] == ["<cell>00text", "<cell>01text", "<cell>10text", "<cell>11text"]
    text = document.document_text(judged).first()
    assert text["text"].startswith("Head & line\nBody text") and "<cell>00text\t<cell>01text" in text["text"]
    html = render.document_html(judged).first()["html"]
    assert '<h1 style="color:#ff0000" dir="ltr">Head &amp; line</h1>' in html and "<th>&lt;cell&gt;00text</th>" in html and '<p class="needs-ocr">' in html and html.count("<section") == 2
    assert html.count("<thead>") == html.count("</thead>") == 1 and html.count("<tbody>") == html.count("</tbody>") == 1
    import json

    told = json.loads(render.document_json(judged).first()["json"])
    kinds = [b["type"] for b in told["pages"][0]["blocks"]]
    assert told["page_count"] == 2 and kinds[-1] == "table" and told["pages"][0]["blocks"][-1]["rows"][0][0]["text"] == "<cell>00text" and "unsupported_reason" not in json.dumps(told)
    assert render.document_html(judged, "T & t", images=False, color=False).first()["html"].count("color:#ff0000") == 0
    assert {r["verdict"]: r["pages"] for r in document.verdict_tally(judged).collect()} == {"ok": 1, "needs_ocr": 1}
    assert extract.extract(spark.createDataFrame([], "doc_id string, content binary")).count() == 0
    assert extract.extract(spark.createDataFrame([(None, None)], "doc_id string, content binary")).first()["error"] == "no PDF header"
    assert detect.judged(extract.extract(spark.createDataFrame([("f", bytearray(simple_pdf([{"content": b""}] * 3)))], "doc_id string, content binary"), [2], spread=True)).select("page").collect() == [(2,)]

import pytest

from foliospark import cli
from foliospark.api import Document, DocumentError, extract_text, golden, save_document, write_corpus
from foliospark.operators.detect import judged
from foliospark.operators.extract import extract, read_pdfs
from foliospark.streaming.landing import landing_pages, verdict_counts
from foliospark.synth import simple_pdf
from tests.test_detect import table_page  # noqa: F401

IMAGE = ("/Type/XObject/Subtype/Image/Width 1/Height 1/BitsPerComponent 8/ColorSpace/DeviceGray", b"\x80")
BITS = ("/Type/XObject/Subtype/Image/Width 1/Height 1/BitsPerComponent 1/ColorSpace/DeviceGray", b"\x80")


@pytest.fixture
def pdf(tmp_path):
    content = b"q 20 0 0 20 300 300 cm /Im0 Do Q BT /F1 24 Tf 0 300 Td (Heading) Tj ET BT /F1 12 Tf 0 100 Td (Some body text that goes on for a while) Tj ET"
    path = tmp_path / "a.pdf"
    path.write_bytes(simple_pdf([{"content": content, "xobjects": {"Im0": IMAGE, "Im1": BITS}}, {"content": b""}, {"content": b"BT /F1 12 Tf 3 Tr (Hidden words) Tj ET"}]))
    return path


def test_document(spark, pdf, tmp_path):
    doc = Document(pdf, spark)
    assert len(doc) == doc.page_count == 3 and [p.verdict for p in doc] == ["ok", "needs_ocr", "degraded"]
    assert doc.text == "Heading\nSome body text that goes on for a while\n\nHidden words" == extract_text(pdf, spark)
    assert doc.pages_needing_ocr == [2] and doc.confidence == pytest.approx(1.9 / 3) and doc.tagged_pages == []
    page = doc.page(1)
    assert (page.width, page.height, page.rotation, page.tagged, page.needs_ocr) == (612, 842, 0, False, False)
    assert [b.kind for b in page.blocks] == ["text", "image", "text", "image"] or [b.kind for b in page.blocks].count("image") == 2
    assert page.lines[0].size == 24 and page.lines[0].color == "#000000" and page.lines[0].direction == "ltr" and repr(page.lines[0]) == "<Line 24.0pt 'Heading'>"
    ready, refused = (next(b for b in page.images if b.name == n) for n in ("Im0", "Im1"))
    ready.save(tmp_path / "x.png")
    assert (tmp_path / "x.png").read_bytes() == ready.data and ready.bbox == (300, 300, 320, 320)
    with pytest.raises(ValueError, match="1-bit"):
        refused.save(tmp_path / "y.png")
    with pytest.raises(IndexError):
        doc.page(4)
    assert doc.heading_sizes() == [(24.0, 1)] and "<h1" in doc.to_html() and "base64" not in doc.to_html(include_images=False) and '"page_count" : 3' in doc.to_json()
    assert golden(doc).splitlines()[0] == "# page 1 [ok] confidence=1.00"
    assert "pages needing OCR: 2" in save_document(doc, tmp_path / "out") and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.html", "a.json", "a.txt"]
    assert save_document(doc, tmp_path / "one.txt") and (tmp_path / "one.txt").read_text() == doc.text
    assert "3 page(s)" in repr(doc) and len(doc.text_blocks) == 3 and [n for n, _ in doc.images] == [1, 1]


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Document(tmp_path / "none.pdf", spark)
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    with pytest.raises(DocumentError):
        Document(tmp_path / "bad.pdf", spark)


def test_command_line(spark, pdf, tmp_path, capsys):
    run = lambda *a: (cli.main(list(map(str, a))), capsys.readouterr())
    code, out = run("inspect", pdf)
    assert code == 0 and "3 page(s)" in out.out and "no ToUnicode, /Encoding only" in out.out
    assert "(Heading) Tj" in run("raw", pdf)[1].out
    assert "/F1 24.00pt #000000 (black)" in run("glyphs", pdf, 1)[1].out and "INVISIBLE" in run("glyphs", pdf, 3)[1].out
    assert "[y=  300.0] Heading" in run("text", pdf)[1].out and "0 of" in run("text", pdf)[1].out
    out = run("extract", pdf, "all")[1].out
    assert "── page 2 [needs_ocr]──" in out and "1 ok, 1 degraded, 1 need OCR" in out
    out = run("blocks", pdf, 1)[1].out
    assert "Im0.png  1x1px" in out and "not decoded: 1-bit" in out and "(no blocks)" in run("blocks", pdf, 2)[1].out
    assert "wrote 1 image(s)" in run("images", pdf, tmp_path / "im")[1].out and (tmp_path / "im/p001-Im0.png").exists()
    assert run("html", pdf, tmp_path / "o.html")[1].err.startswith("24.0 pt → h1") and "<html" in run("html", pdf)[1].out
    assert run("extract", pdf, "x")[0] == 1 and run("extract", pdf, 9)[0] == 1 and run("inspect", tmp_path / "no.pdf")[0] == 1


def test_folders_and_streams(spark, pdf, tmp_path):
    pages = judged(extract(read_pdfs(spark, str(pdf.parent))))
    assert pages.count() == 3
    write_corpus(pages, str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus/text.parquet")).count() == 1
    q = verdict_counts(landing_pages(spark, str(pdf.parent))).writeStream.outputMode("complete").format("memory").queryName("landed").start()
    try:
        q.processAllAvailable()
        assert {r["verdict"]: r["pages"] for r in spark.table("landed").collect()} == {"ok": 1, "needs_ocr": 1, "degraded": 1}
    finally:
        q.stop()

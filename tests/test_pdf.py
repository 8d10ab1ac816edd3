import random
import zlib

import pytest

from millrace.plans.made_pdf import make_pdf, pages_of
from millrace.sources import office, pdf

TEXT = "A first line (with brackets) and a \\ in it\n\nécrit € 5\nlast line of the page"


def built(content, font=b"<< /Subtype /Type1 >>", head=b"", extra=b""):
    """A PDF without a table of objects, whose one page shows ``content``."""
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Kids [3 0 R] >> endobj\n3 0 obj << /Contents [4 0 R 4 0 R] /Resources 6 0 R >> endobj\n4 0 obj << /Length 9 0 R " + head + b" >> stream\r\n" + content + b"\nendstream endobj\n6 0 obj << /Font << /F 7 0 R >> >> endobj\n7 0 obj " + font + b" endobj\n" + extra


@pytest.mark.parametrize("text", [TEXT, "漢字 and \U0001f600 in a text that is long enough\nfor its page", "\n".join(f"line {k}" for k in range(130)), "x" * 200_000])
def test_made_pdfs(text):
    for packed in (False, True):
        assert pdf.extracted(make_pdf(text, packed)) == ("table", [p.strip("\n") for p in pages_of(text)], None)
        assert pdf.extracted(make_pdf(text, packed, damaged=True)) == ("scan", [p.strip("\n") for p in pages_of(text)], None)


def test_operators_fonts_and_filters():
    show = b"BT /F 12 Tf 1 0 0 1 10 700 Tm (Hel) Tj [(lo) -300 (wor\\154d) 20 (!)] TJ 0 -14 Td <48 49> Tj (next) ' 1 0 0 1 10 600 Tm (li\\\nne) Tj 5 0 Td ( on) Tj ET % note\n"
    want = "Hello world!\nHI\nnext\nline on"
    for content, head in ((show, b""), (zlib.compress(show), b"/Filter /FlateDecode"), (zlib.compress(show).hex().encode() + b">", b"/Filter [/AHx /Fl]")):
        way, pages, error = pdf.extracted(built(content, head=head))
        assert (way, error) == ("scan", None) and pages[0].startswith(want)
    map_ = b"8 0 obj << >> stream\n1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <00660069> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<0078> <D83DDE00>] endbfrange\nendstream endobj\n"
    way, pages, error = pdf.extracted(built(b"BT /F 1 Tf <0102030405067F> Tj (" + b"\x02" * 60 + b") Tj ET", font=b"<< /ToUnicode 8 0 R >>", extra=map_))
    assert pages[0].startswith("fiabcx\U0001f600�" + "a" * 60)


def test_files_without_text():
    assert pdf.extracted(b"") == (None, None, "no PDF") == pdf.extracted(b"hello" * 100)
    assert pdf.extracted(b"%PDF-1.4\nnothing")[2] == "ValueError: no catalog"
    assert pdf.extracted(built(b"BT (few) Tj ET"))[2] == "few characters" and pdf.extracted(built(b""))[2] == "no text"
    assert pdf.extracted(built(b"BT (" + b"\x01\x02" * 100 + b") Tj ET"))[2] == "not printable"
    assert "encrypted" in pdf.extracted(make_pdf(TEXT).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 3 0 R"))[2]
    assert "filter" in pdf.extracted(built(b"x", head=b"/Filter /JPXDecode"))[2]
    loop = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Kids [2 0 R 2 0 R] >> endobj\n3 0 obj 3 0 R endobj\n"
    assert pdf.extracted(loop)[0] is None


def test_damage_never_stops_a_run():
    rng = random.Random(1)
    for k in range(300):
        data = bytearray(make_pdf(TEXT, packed=k % 2 == 0))
        for _ in range(rng.randint(1, 40)):
            at = rng.randrange(len(data))
            if rng.random() < 0.3:
                del data[at : at + rng.randint(1, 30)]
            else:
                data[at] = rng.randrange(256)
        way, pages, error = pdf.extracted(bytes(data))
        assert (way is None) == (error is not None) and (pages is None or all(isinstance(p, str) for p in pages))


def test_rows_of_files(spark):
    rows = [("a.pdf", make_pdf(TEXT)), ("b.pdf", b"%PDF-1.4 broken"), ("c.pdf", None)]
    got = {r["path"]: (r["way"], r["pages"], r["error"]) for r in pdf.pdf_texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a.pdf": ("table", [TEXT], None), "b.pdf": (None, None, "ValueError: no catalog"), "c.pdf": (None, None, "no PDF")}


def test_a_document_as_one_text(spark):
    blocks = spark.createDataFrame([("a", 1, "heading", "Title", None), ("a", 3, "row", "1 | 2", None), ("a", 2, "text", " p ", None), ("a", 4, "text", "  ", None), ("b", 0, None, None, "broken")], "path string, pos int, kind string, text string, error string")
    assert [tuple(r) for r in office.document_text(blocks).collect()] == [("a", "Title\np\n1 | 2")]

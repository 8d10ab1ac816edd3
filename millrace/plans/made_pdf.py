"""PDFs made of texts, so that queries over tables have files to read."""

from __future__ import annotations

import zlib

LINES = 40


def pages_of(text: str) -> list[str]:
    lines = text.split("\n")
    return ["\n".join(lines[k : k + LINES]) for k in range(0, len(lines), LINES)]


def _shown(line: str, latin: bool) -> bytes:
    if not latin:
        return b"<" + line.encode("utf-16-be", "surrogatepass").hex().encode() + b"> Tj"
    raw = line.encode("cp1252")
    for c in (b"\\", b"(", b")"):
        raw = raw.replace(c, b"\\" + c)
    return b"(" + raw.replace(b"\r", b"\\r") + b") Tj"


def _latin(text: str) -> bool:
    try:
        return text.encode("cp1252").decode("cp1252") == text
    except UnicodeError:
        return False


def make_pdf(text: str, packed: bool = False, damaged: bool = False) -> bytes:
    """A PDF of the text, ``LINES`` lines a page: with a plain table of objects, or (``packed``) with objects and
    their table in streams; ``damaged``: the table is said to be where it isn't."""
    latin = _latin(text)
    pages = pages_of(text)
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>" if latin else b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /ToUnicode 4 0 R >>"
    to_unicode = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    kids = b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages)))
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), kids), 3: font}
    streams = {4: to_unicode}
    for k, page in enumerate(pages):
        plain[5 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (6 + 2 * k)
        streams[6 + 2 * k] = b"BT /F1 10 Tf 12 TL " + b" T* ".join(_shown(line, latin) for line in page.split("\n")) + b" ET"
    out, places = bytearray(b"%PDF-1.7\n"), {}

    def put(number: int, body: bytes) -> None:
        places[number] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    def stream(data: bytes, head: bytes = b"") -> bytes:
        data = zlib.compress(data)
        return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (len(data), head, data)

    for number, data in streams.items():
        put(number, stream(data))
    size = 7 + 2 * len(pages)
    if not packed:
        for number, body in plain.items():
            put(number, body)
        start = len(out)
        out.extend(b"xref\n0 %d\n" % (size - 2))
        out.extend(b"".join(b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n" for n in range(size - 2)))
        out.extend(b"trailer\n<< /Size %d /Root 1 0 R >>\n" % (size - 2))
    else:
        heads, bodies = [], b""
        for number, body in plain.items():
            heads.append(b"%d %d" % (number, len(bodies)))
            bodies += body + b" "
        head = b" ".join(heads) + b" "
        put(size - 2, stream(head + bodies, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(head))))
        start, order = len(out), list(plain)
        rows = b"".join(bytes([2]) + (size - 2).to_bytes(4) + order.index(n).to_bytes(2) if n in plain else bytes([1]) + places[n].to_bytes(4) + bytes(2) if n in places else bytes(7) for n in range(size - 1))
        # rows by the predictor that keeps each row's difference to the one above
        up = b"".join(b"\x02" + bytes((rows[7 * n + k] - (rows[7 * n - 7 + k] if n else 0)) & 255 for k in range(7)) for n in range(size - 1))
        put(size - 1, stream(up, b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>" % (size - 1)))
    out.extend(b"startxref\n%d\n%%%%EOF\n" % (start + (7 if damaged else 0)))
    return bytes(out)

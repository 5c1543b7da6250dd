"""Readers of MOBI and PDF files on files made here."""

import struct
import zlib

from quillstone.sources import ebooks as E


def mobi(html: bytes, compression=1, tables=()) -> bytes:
    records = [html[i : i + 4096] for i in range(0, len(html), 4096)]
    head = struct.pack(">HHLHHHH", compression, 0, len(html), len(records), 4096, 0, 0) + b"MOBI" + struct.pack(">LLL", 116, 2, 65001)
    head += bytes(112 - len(head)) + struct.pack(">LL", len(records) + 1, len(tables)) + bytes(12)
    parts = [head, *records, *tables]
    at = 78 + 8 * len(parts) + 2
    table = b""
    for p in parts:
        table += struct.pack(">LL", at, 0)
        at += len(p)
    return bytes(76) + struct.pack(">H", len(parts)) + table + b"\0\0" + b"".join(parts)


def pdf(pages: list[str], outline: list[tuple[int, str]], deflate: bool) -> bytes:
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 900 0 R >>"}
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"] >>"
    for i, text in enumerate(pages):
        data = b"BT /F1 12 Tf 10 10 Td (" + text.encode("cp1252") + b") Tj 0 -14 Td [(sec) -20 (ond) -300 <6c696e65>] TJ ET"
        body = zlib.compress(data) if deflate else data
        objects[10 + 2 * i] = b"<< /Type /Page /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d %s >>\nstream\n" % (len(body), b"/Filter /FlateDecode" if deflate else b"") + body + b"\nendstream"
    objects[900] = b"<< /First 901 0 R >>" if outline else b"<< >>"
    for n, (page, title) in enumerate(outline):
        following = b" /Next %d 0 R" % (902 + n) if n + 1 < len(outline) else b""
        objects[901 + n] = b"<< /Title (" + title.encode() + b") /Dest [%d 0 R /Fit]" % (10 + 2 * page) + following + b" >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % n + b + b"\nendobj\n" for n, b in objects.items())


def test_palm_compression():
    assert E.palm_decompress(b"abc" + bytes((0x80, 3 << 3)) + bytes((0xE1,))) == b"abcabc a"
    assert E.palm_decompress(bytes((2, 0xE4, 0xF6)) + b"x") == b"\xe4\xf6x"


def test_mobi():
    html = "<html><h1>One</h1><p>Größe a</p><mbp:pagebreak/><h2>Two</h2><p>b</p></html>".encode()
    assert [(n, t) for n, t, _ in E.mobi_chapters(mobi(html))] == [(0, "One"), (1, "Two")]
    assert "Größe a" in E.mobi_chapters(mobi(html))[0][2]
    assert E.mobi_chapters(mobi(html, compression=99)) == []


def phrase_book(phrases: list[tuple[bytes, bool]]) -> bytes:
    """A dictionary record of phrases and whether they are whole."""
    offsets, body = [], b""
    for text, whole in phrases:
        offsets.append(2 * len(phrases) + len(body))
        body += struct.pack(">H", len(text) | (0x8000 if whole else 0)) + text
    return b"CDIC" + struct.pack(">LLL", 16, len(phrases), 8) + struct.pack(f">{len(phrases)}H", *offsets) + body


def test_huffman():
    """Codes of eight bits, phrase 255 - code; phrase 1 is compressed itself.  Then codes of two lengths."""
    phrases = [(bytes((i,)), True) for i in range(256)]
    phrases[1] = (bytes(255 - b for b in b"<p>a"), False)
    table = b"HUFF" + struct.pack(">LLL", 24, 24, 24 + 1024) + bytes(8) + struct.pack(">256L", *[255 << 8 | 0x80 | 8] * 256) + bytes(256)
    html = b"<h1>One</h1>" + b"\1" + b" word</p>"
    packed = bytes(255 - b for b in html)
    assert E.mobi_html(mobi(packed, E.HUFFMAN, (table, phrase_book(phrases)))) == "<h1>One</h1><p>a word</p>"
    assert [(n, t) for n, t, _ in E.mobi_chapters(mobi(packed, E.HUFFMAN, (table, phrase_book(phrases))))] == [(0, "One")]
    # 1 is phrase 0; 01 phrase 1; 00 phrase 2.  Largest codes: one bit 1, two bits 01 with phrases counted on from 1.
    by_byte = [2 if b < 0x80 else 1 << 8 | 0x80 | 1 for b in range(256)]
    limits = [0] * 64
    limits[2:4] = [0, 2]  # of two bits: the smallest code 0, and the largest such that 01 is phrase 1
    table = b"HUFF" + struct.pack(">LLL", 24, 24, 24 + 1024) + bytes(8) + struct.pack(">256L", *by_byte) + struct.pack(">64L", *limits)
    reader = E.Huffman(table, [phrase_book([(b"a", True), (b"bc", True), (b"d", True)])])
    assert reader.decode(bytes([0b10100110])) == b"a" + b"bc" + b"d" + b"a" + b"a"  # the last bit fills the byte


def test_pdf():
    for deflate in (False, True):
        raw = pdf(["first \\0501\\051 caf\\351", "next", "last"], [(0, "A"), (2, "B")], deflate)
        found = E.pdf_chapters(raw)
        assert [t for _, t, _ in found] == ["A", "B"]
        assert found[0][2].startswith("first (1) café\nsecond line") and "next" in found[0][2] and found[1][2].startswith("last")
    assert [t for _, t, _ in E.pdf_chapters(pdf(["x"], [], True))] == ["full"]
    assert E._safe(E.pdf_chapters)(b"junk") == []


def test_read_books(spark, tmp_path):
    (tmp_path / "m.mobi").write_bytes(mobi(b"<h1>T</h1><p>text</p>"))
    (tmp_path / "p.pdf").write_bytes(pdf(["page"], [], True))
    (tmp_path / "bad.mobi").write_bytes(b"x")
    (tmp_path / "worse.epub").write_bytes(b"PK")
    rows = {(r.book, r.format, r.title) for r in E.read_books(spark, str(tmp_path)).collect()}
    assert rows == {("m", "mobi", "T"), ("p", "pdf", "full"), ("bad", "mobi", None), ("worse", "epub", None)}  # damaged files are rows of their own


def test_fonts_with_codes_of_their_own():
    """Two-byte codes by single characters, ranges and lists; one-byte codes of another font; a font without a map."""
    wide = b"begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0010> <00660069> endbfchar 2 beginbfrange <0024> <0026> <0041> <0030> <0031> [<00E9> <4E00>] endbfrange"
    narrow = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <01> <03> <0078> endbfrange"
    content = b"BT /F1 12 Tf <002400250026 0003 0030> Tj <00310010> Tj 0 -12 Td /F2 9 Tf (\\001\\002\\003) Tj 0 -12 Td /F3 9 Tf (plain) Tj ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Resources << /ProcSet [/PDF] /Font << /F1 5 0 R /F2 6 0 R /F3 9 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: b"<< >>\nstream\n" + content + b"\nendstream",
        5: b"<< /Type /Font /ToUnicode 7 0 R >>", 6: b"<< /Type /Font /ToUnicode 8 0 R >>", 9: b"<< /Type /Font >>",
        7: b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(wide) + b"\nendstream", 8: b"<< >>\nstream\n" + narrow + b"\nendstream",
    }
    raw = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % n + b + b"\nendobj\n" for n, b in objects.items())
    assert E.pdf_chapters(raw) == [(0, "full", "ABC \u00e9\u4e00fi\nxyz\nplain")]
    objects[3] = objects[3].replace(b"/Contents", b"/Resources 10 0 R /Contents")
    objects[10] = b"<< /Font 11 0 R >>"
    objects[11] = b"<< /F1 5 0 R >>"
    raw = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % n + b + b"\nendobj\n" for n, b in objects.items())
    assert E.pdf_chapters(raw)[0][2].startswith("ABC \u00e9\u4e00fi\n")

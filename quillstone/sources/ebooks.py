"""Books in MOBI, AZW3 and PDF files, as far as the standard library reads them.

MOBI and AZW3: uncompressed, PalmDOC-compressed and Huffman-compressed texts; not
encrypted ones.  PDF: text operators of plain and deflated streams in single-byte or
UTF-16 strings, codes that a font maps to Unicode, and outlines with direct
destinations; not encrypted files or fonts with codes of their own and no map.  What cannot be read gives no chapters.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.sources.files import epub_chapters_of, markdown

CHAPTERS = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))


def palm_decompress(raw: bytes) -> bytes:
    """PalmDOC: literals, a space before a character, and back references of up to 10 bytes."""
    out, i = bytearray(), 0
    while i < len(raw):
        c = raw[i]
        i += 1
        if c == 0 or 9 <= c <= 0x7F:
            out.append(c)
        elif c <= 8:
            out += raw[i : i + c]
            i += c
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(raw):
            pair = (c << 8 | raw[i]) & 0x3FFF
            i += 1
            distance, size = pair >> 3, (pair & 7) + 3
            for _ in range(size if 0 < distance <= len(out) else 0):
                out.append(out[-distance])
    return bytes(out)


#: Kinds of compression, and how deep phrases may lie in phrases.
PLAIN, PALM, HUFFMAN, MAX_NESTING = 1, 2, 17480, 32


class Huffman:
    """Decoder of Huffman-compressed records: codes stand for phrases, which may be compressed themselves."""

    def __init__(self, table: bytes, dictionaries: list[bytes]):
        by_byte, by_length = struct.unpack(">LL", table[8:16])
        self.by_byte = struct.unpack(">256L", table[by_byte : by_byte + 1024])
        limits = struct.unpack(">64L", table[by_length : by_length + 256])
        # Smallest and largest code of each length from 1, as the upper bits of 32.
        self.low = [0] + [limits[2 * i] << (31 - i) for i in range(32)]
        self.high = [0] + [((limits[2 * i + 1] + 1) << (31 - i)) - 1 for i in range(32)]
        self.phrases: list[tuple[bytes, bool]] = []
        for raw in dictionaries:
            total, bits = struct.unpack(">LL", raw[8:16])
            for at in struct.unpack(f">{(n := min(1 << bits, total - len(self.phrases)))}H", raw[16 : 16 + 2 * n]):
                size = struct.unpack(">H", raw[16 + at : 18 + at])[0]
                self.phrases.append((raw[18 + at : 18 + at + (size & 0x7FFF)], bool(size & 0x8000)))

    def decode(self, record: bytes, depth: int = 0) -> bytes:
        data, place, end, out = record + bytes(8), 0, 8 * len(record), []
        while place < end:
            code = int.from_bytes(data[place >> 3 : (place >> 3) + 5], "big") >> 8 - (place & 7) & 0xFFFFFFFF
            entry = self.by_byte[code >> 24]
            size = entry & 31
            if entry & 0x80:
                top = ((entry >> 8) + 1 << 32 - size) - 1 if size else 0
            else:
                while 0 < size <= 32 and code < self.low[size]:
                    size += 1
                top = self.high[size] if size <= 32 else 0
            place += size
            if not 0 < size <= 32 or place > end:
                break  # what is left are filling bits
            phrase, whole = self.phrases[top - code >> 32 - size]
            if not whole:
                if depth == MAX_NESTING:
                    raise ValueError("phrases lie too deep in phrases")
                phrase = self.decode(phrase, depth + 1)
                self.phrases[top - code >> 32 - size] = phrase, True
            out.append(phrase)
        return b"".join(out)


def _trailing(record: bytes, flags: int) -> int:
    """Bytes that follow the text of a record."""
    total = 0
    for bit in range(15, 0, -1):
        if flags >> bit & 1:
            size, shift = 0, 0
            for byte in reversed(record[max(0, len(record) - total - 4) : len(record) - total]):
                size |= (byte & 0x7F) << shift
                shift += 7
                if byte & 0x80:
                    break
            total += size
    if flags & 1 and total < len(record):
        total += (record[len(record) - total - 1] & 3) + 1
    return total


def mobi_html(raw: bytes) -> str | None:
    """The HTML of a MOBI file; None if its compression is not known here or it is encrypted."""
    count = struct.unpack(">H", raw[76:78])[0]
    starts = [struct.unpack(">L", raw[78 + 8 * i : 82 + 8 * i])[0] for i in range(count)] + [len(raw)]
    head = raw[starts[0] : starts[1]]
    compression, records, encrypted = struct.unpack(">H", head[0:2])[0], struct.unpack(">H", head[8:10])[0], struct.unpack(">H", head[12:14])[0]
    if compression not in (PLAIN, PALM, HUFFMAN) or encrypted:
        return None
    mobi = head[16:20] == b"MOBI"
    encoding = "utf-8" if mobi and struct.unpack(">L", head[28:32])[0] == 65001 else "cp1252"
    flags = struct.unpack(">H", head[242:244])[0] if mobi and struct.unpack(">L", head[20:24])[0] >= 228 and len(head) >= 244 else 0
    decode = {PLAIN: bytes, PALM: palm_decompress}.get(compression)
    if decode is None:
        first, number = struct.unpack(">LL", head[112:120])
        tables = [raw[starts[i] : starts[i + 1]] for i in range(first, min(first + number, count))]
        decode = Huffman(tables[0], tables[1:]).decode
    parts = []
    for i in range(1, min(records, count - 1) + 1):
        record = raw[starts[i] : starts[i + 1]]
        record = record[: len(record) - _trailing(record, flags)]
        parts.append(decode(record))
    return b"".join(parts).decode(encoding, "replace")


def mobi_chapters(raw: bytes) -> list[tuple[int, str, str]]:
    """(position, title, Markdown): parts between page breaks, titled by their first heading."""
    source = mobi_html(raw)
    out = []
    for part in re.split(r"(?i)<mbp:pagebreak\s*/?>", source or ""):
        text = markdown(part)
        if text:
            title = re.search(r"(?is)<h[1-3][^>]*>(.*?)</h", part)
            out.append((len(out), re.sub(r"<[^>]*>", "", title[1]).strip() if title else text.split("\n")[0][:80], text))
    return out


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"/[^\s()<>\[\]{}/%]+|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[A-Za-z'\"*]+|[-+.\d]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes((int(m[1], 8) & 255,)) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r\n") else m[1]), token[1:-1], flags=re.S)


def _string(token: bytes) -> str:
    raw = _bytes(token)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


class FontCodes:
    """What a font's character map says that its codes stand for."""

    def __init__(self, cmap: bytes):
        space = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
        self.size, self.table = len(space[1]) // 2 if space else 1, {}
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            for code, target in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                self.table[int(code, 16)] = text(target)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for first, last, one, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
                codes = range(int(first, 16), min(int(last, 16), int(first, 16) + 0xFFFF) + 1)
                if one:  # the last character counts up
                    start = text(one)
                    self.table |= {c: start[:-1] + chr(ord(start[-1:] or "\0") + c - codes[0]) for c in codes}
                else:
                    self.table |= dict(zip(codes, map(text, re.findall(rb"<([0-9A-Fa-f]+)>", several))))

    def decode(self, raw: bytes) -> str:
        return "".join(self.table.get(int.from_bytes(raw[i : i + self.size], "big"), "") for i in range(0, len(raw), self.size))


def page_text(content: bytes, fonts: dict[bytes, FontCodes] | None = None) -> str:
    """The text that a page's content stream shows; moves to another line end lines.  `fonts` has the maps of those
    fonts (by their names in the page) that have one."""
    out, stack, inside, codes = [], [], False, None
    for token in _TOKEN.findall(content):
        if token == b"BT":
            inside = True
        elif token == b"ET":
            inside = False
            out.append("\n")
        elif inside and token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for part in stack:
                if part[:1] in (b"(", b"<"):
                    out.append(codes.decode(_bytes(part)) if codes else _string(part))
                elif token == b"TJ" and re.fullmatch(rb"-[\d.]+", part) and float(part) < -200:
                    out.append(" ")
            stack.clear()
        elif inside and token in (b"Td", b"TD", b"T*", b"Tm"):
            if token != b"Td" or not stack or stack[-1] != b"0":
                out.append("\n")
            stack.clear()
        elif re.fullmatch(rb"[A-Za-z*]+", token):
            if token == b"Tf" and len(stack) > 1:
                codes = (fonts or {}).get(stack[-2][1:])
            stack.clear()
        else:
            stack.append(token)
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip()


class _Pdf:
    def __init__(self, raw: bytes):
        self.objects = {int(n): body for n, body in _OBJECT.findall(raw)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                data, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
                numbers = list(map(int, data[:first].split()))
                for i in range(0, len(numbers) - 1, 2):
                    end = numbers[i + 3] if i + 3 < len(numbers) else len(data) - first
                    self.objects.setdefault(numbers[i], data[first + numbers[i + 1] : first + end])

    @staticmethod
    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        if b"/FlateDecode" not in body:
            return m[1]
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""

    def refs(self, body: bytes, name: bytes) -> list[int]:
        m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def part(self, body: bytes, name: bytes) -> bytes:
        """A dictionary in a dictionary, there or as an object of its own."""
        m = re.search(rb"/" + name + rb"\s*(?:(\d+)\s+\d+\s+R|<<)", body)
        if not m:
            return b""
        if m[1]:
            return self.objects.get(int(m[1]), b"")
        depth, at = 1, m.end()
        while depth and (mark := re.compile(rb"<<|>>").search(body, at)):
            depth, at = depth + (1 if mark[0] == b"<<" else -1), mark.end()
        return body[m.end() : at]

    def fonts(self, page: int) -> dict[bytes, FontCodes]:
        """The character maps of a page's fonts, by name; resources may stand in a page above."""
        body, found = self.objects.get(page, b""), {}
        for _ in range(16):
            if b"/Resources" in body or not (parents := self.refs(body, b"Parent")):
                break
            body = self.objects.get(parents[0], b"")
        for name, number in re.findall(rb"/([^\s()<>\[\]{}/%]+)\s+(\d+)\s+\d+\s+R", self.part(self.part(body, b"Resources"), b"Font")):
            for cmap in self.refs(self.objects.get(int(number), b""), b"ToUnicode"):
                found[name] = FontCodes(self.stream(self.objects.get(cmap, b"")))
        return found

    def pages(self) -> list[int]:
        """Page objects in reading order."""
        out, seen = [], set()

        def walk(number: int) -> None:
            body = self.objects.get(number, b"")
            if number in seen:
                return
            seen.add(number)
            kids = self.refs(body, b"Kids")
            if kids:
                for kid in kids:
                    walk(kid)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(number)

        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/Catalog\b", body):
                for root in self.refs(body, b"Pages"):
                    walk(root)
        return out

    def outline(self, pages: list[int]) -> list[tuple[int, int, str]]:
        """(page from 0, level, title), depth first."""
        out, seen = [], set()

        def walk(number: int, level: int) -> None:
            while number and number not in seen:
                seen.add(number)
                body = self.objects.get(number, b"")
                title = re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", body, re.S)
                target = self.refs(body, b"Dest") or self.refs(body, b"D")
                if title and target and target[0] in pages:
                    out.append((pages.index(target[0]), level, _string(title[1])))
                for kid in self.refs(body, b"First"):
                    walk(kid, level + 1)
                number = (self.refs(body, b"Next") or [0])[0]

        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/Catalog\b", body):
                for root in self.refs(body, b"Outlines"):
                    for first in self.refs(self.objects.get(root, b""), b"First"):
                        walk(first, 0)
        return out


def pdf_chapters(raw: bytes) -> list[tuple[int, str, str]]:
    """(position, title, text): the spans between outline entries above the second level, or one chapter, full."""
    pdf = _Pdf(raw)
    pages = pdf.pages()
    texts = [page_text(b"\n".join(pdf.stream(pdf.objects.get(c, b"")) for c in pdf.refs(pdf.objects[p], b"Contents")), pdf.fonts(p)) for p in pages]
    tops = [(page, title) for page, level, title in pdf.outline(pages) if level < 2]
    if not tops:
        tops = [(0, "full")]
    out = []
    for n, (page, title) in enumerate(tops):
        end = tops[n + 1][0] if n + 1 < len(tops) else len(texts)
        text = "\n\n".join(t for t in texts[page : max(end, page + 1)] if t)
        if text:
            out.append((len(out), title, text))
    return out


def _safe(read):
    def run(raw):
        try:
            return read(bytes(raw)) if raw else []
        except (struct.error, IndexError, KeyError, ValueError, AttributeError, StopIteration, SyntaxError, zipfile.BadZipFile):
            return None  # a damaged file must not end the job

    return run


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """book, format, position, level, title, text of the chapters of all book files below a folder; a file that
    cannot be read, or that has no chapter, is one row with nulls behind its format."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{epub,mobi,azw3,pdf}").load(path)
    kind, book = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)), F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    epub, mobi, pdf = (F.udf(_safe(read), CHAPTERS, useArrow=True) for read in (epub_chapters_of, mobi_chapters, pdf_chapters))
    # One format at a time, so that each reader only sees its own files.
    files = files.select(book.alias("book"), kind.alias("format"), "content")
    parts = [files.where(F.col("format").isin(*formats)).select("book", "format", F.explode_outer(read("content")).alias("c")) for formats, read in ((("epub",), epub), (("mobi", "azw3"), mobi), (("pdf",), pdf))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("book", "format", "c.position", F.when(F.col("c").isNotNull(), 0).alias("level"), "c.title", "c.text")

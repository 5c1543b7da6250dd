"""Text predicates, tokenizers and classifiers as column expressions.

Byte lengths follow UTF-8 (octet_length); case folding is ASCII only unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Strings that mark style sheets; one of the first kind or two of the second do.
CSS_MARKS = ("@media", "@font-face", ".calibre")
CSS_KEYWORDS = ("margin:", "padding:", "font-size:", "display:", "text-align:", "text-indent:", "line-height:", "color:", "background", "border", "position:", "width:", "height:")
#: Shortest paragraph in bytes, preview length, separators of query tokens.
MIN_PARAGRAPH, PREVIEW, QUERY_SEPARATORS = 50, 200, " _-.,;:!?()[]{}<>\"'\t\n"
#: Language by file extension.
LANGUAGE_BY_EXTENSION = {
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "py": "python",
    "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java",
}
#: Category of a symbol kind.
KIND_CATEGORY = {
    "function": "function", "method": "function", "class": "class", "struct": "struct", "union": "struct",
    "enum": "enum", "enumerator": "enum", "typedef": "typedef", "variable": "variable", "member": "variable",
    "field": "variable", "local": "variable", "parameter": "variable", "macro": "macro", "namespace": "namespace",
    "interface": "interface", "package": "namespace", "module": "namespace",
}
#: Path parts that mark test code, and file parts that an indexer skips.
NOISE_PATHS = ("/test", "torture", "kunit", "selftest", "/tools/testing", "mock", "fuzzer")
SKIPPED_FILES = (".d.ts", ".test.", ".spec.", "__tests__", "node_modules")
#: Six entities that plain text keeps decoded.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def has_prefix(text: Column, prefix: str) -> Column:
    """Whether the bytes of `text` begin with `prefix`."""
    return text.startswith(prefix)


def byte_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over UTF-8 bytes: every byte is read as one Latin-1 character."""
    as_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(as_bytes(a), as_bytes(b))


def fuzzy_score(a: Column, b: Column) -> Column:
    """1 - distance / longer length in bytes; two empty texts score 1."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - byte_levenshtein(a, b) / longer)


def matches_pattern(text: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """Unanchored regular expression, ignoring case unless told otherwise."""
    return text.rlike(pattern if case_sensitive else f"(?i){pattern}")


def contains_word(text: Column, tag: str) -> Column:
    """Whether `tag` occurs with no ASCII letter or digit next to it."""
    quoted = "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in tag)
    return text.rlike(f"(^|[^A-Za-z0-9]){quoted}([^A-Za-z0-9]|$)")


def tag_tokens(text: Column) -> Column:
    """Runs of ASCII word characters, or runs that begin with another character and take both; two bytes
    at least, duplicates kept."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^\x00-\x7F](?:[A-Za-z0-9_]|[^\x00-\x7F])*"), 0)
    return F.filter(runs, lambda w: F.octet_length(w) >= 2)


def word_tokens(text: Column) -> Column:
    """Lower-cased ASCII words of two characters at least, cut to 63."""
    words = F.split(ascii_lower(text), "[^a-z0-9_]+")
    return F.transform(F.filter(words, lambda w: F.length(w) >= 2), lambda w: F.substring(w, 1, 63))


def namespace_of(key: Column) -> Column:
    """The text before the last slash; empty without one."""
    return F.regexp_extract(key, r"(?s)^(.*)/[^/]*$", 1)


def name_of(key: Column) -> Column:
    """The text after the last slash."""
    return F.regexp_extract(key, r"([^/]*)$", 1)


def first_bytes(text: Column, size: int) -> Column:
    """The first `size` bytes, each read as one Latin-1 character."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), 1, size), "ISO-8859-1")


def keyword_matches(value: Column, query: str) -> Column:
    """How many of the query's words (between ASCII white space, two bytes at least, query cut to 255 bytes) are in
    the value's first 1023 bytes; ASCII case is ignored."""
    words = [w.decode("latin-1") for w in query.encode()[:255].lower().split() if len(w) >= 2]
    head = first_bytes(ascii_lower(value), 1023)
    return sum((F.contains(head, F.lit(w)).cast("int") for w in words), F.lit(0))


def paragraph_number(key: Column) -> Column:
    """The number after /content/p, or 999."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(key, r"/content/p([0-9]{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(999))


def is_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def query_type(query: Column, has_repo: bool) -> Column:
    """exact for /code/ keys, context for identifiers in a known repository, search for several words, else symbol."""
    return F.when(query.startswith("/code/"), "exact").when(is_identifier(query) & F.lit(has_repo), "context").when(F.contains(query, F.lit(" ")), "search").otherwise("symbol")


def _lookup(key: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(known, key), F.lit("unknown"))


def language_of(path: Column) -> Column:
    """Language by the file's extension."""
    return _lookup(F.regexp_extract(path, r"\.([^./]*)$", 1), LANGUAGE_BY_EXTENSION)


def kind_category(kind: Column) -> Column:
    return _lookup(ascii_lower(kind), KIND_CATEGORY)


def language_of_code(code: Column) -> Column:
    """Language guessed from content, in a fixed order of tests."""
    has = lambda s: F.contains(code, F.lit(s))
    c_like = has("#include") | (has("::") & has("{"))
    return (
        F.when(c_like & (has("#include <iostream>") | has("std::")), "cpp").when(c_like, "c").when(code.rlike(r"(?m)^(import|from)\s+"), "python")
        .when(has("package ") & has("func "), "go").when(has("use ") & has("::"), "rust")
        .when(has("import ") & (has("from ") | has("require(")), "javascript").otherwise("unknown")
    )


def is_css(text: Column) -> Column:
    count = sum((F.contains(text, F.lit(k)).cast("int") for k in CSS_KEYWORDS), F.lit(0))
    return _any(F.contains(text, F.lit(m)) for m in CSS_MARKS) | (count >= 2)


def is_markup(text: Column) -> Column:
    return text.startswith("<") & F.contains(text, F.lit(">"))


def is_noise(text: Column) -> Column:
    """Fewer than 50 bytes, or under 30 % letters, where every byte of a non-ASCII character is one."""
    letters = F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[A-Za-z]|[^\x00-\x7F]", ""))
    return (F.octet_length(text) < MIN_PARAGRAPH) | (letters < F.floor(F.octet_length(text) * 0.3))


def clean_text(text: Column) -> Column:
    """Valid UTF-8 without control characters other than tab and line ends."""
    return F.regexp_replace(F.make_valid_utf8(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def within_bytes(text: Column, size: int) -> Column:
    """The longest beginning of at most `size` bytes that ends with a character."""
    # A cut inside a character leaves an invalid tail, which reads as one replacement character.
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, size).cast("string")), "�+$", "")
    return F.when(F.octet_length(text) > size, cut).otherwise(text)


def preview(text: Column) -> Column:
    """The first 200 bytes without a broken character; page_rows escapes it as it writes JSON."""
    return within_bytes(text, PREVIEW)


def strip_html(html: Column) -> Column:
    """Plain text: scripts, styles, comments and tags go, six entities are decoded, white space is one space."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>", " ")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def safe_name(title: Column) -> Column:
    """A file name: curly quotes and dashes in ASCII, reserved characters and white space as underscores, none at the end."""
    plain = F.translate(title, "‘’“”–—", "''\"\"--")
    return F.regexp_replace(F.regexp_replace(plain, r'[/\\:*?"<>| \t\n\r]', "_"), r"_+$", "")


def chapter_name(index: Column, title: Column) -> Column:
    """Two digits of the 1-based index, a dash, and the safe name cut to 60 bytes on a character boundary."""
    name = safe_name(title)
    number = (index + 1).cast("string")
    return F.concat(F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number), F.lit("-"), within_bytes(name, 60))


def skipped_file(path: Column) -> Column:
    return _any(F.contains(path, F.lit(s)) for s in SKIPPED_FILES)


def is_noise_path(path: Column) -> Column:
    return _any(F.contains(path, F.lit(s)) for s in NOISE_PATHS)


def struct_field(expression: Column, variable: str) -> Column:
    """The field that var->f or var.f reads; empty without one."""
    return F.regexp_extract(expression, rf"(?:^|[^A-Za-z0-9_]){variable}(?:->|\.)([A-Za-z_][A-Za-z0-9_]*)", 1)


def embedding_text(name: Column, language: Column, signature: Column, docstring: Column, content: Column) -> Column:
    """name (language) signature docstring and the first ten non-empty lines, joined by spaces."""
    lines = F.slice(F.filter(F.transform(F.split(content, "\n"), lambda x: F.ltrim(x)), lambda x: x != ""), 1, 10)
    parts = F.array(name, F.concat(F.lit("("), language, F.lit(")")), signature, docstring)
    return F.array_join(F.concat(F.filter(parts, lambda x: x.isNotNull() & (x != "")), lines), " ")


def query_tokens(query: str, least: int = 3) -> list[str]:
    """The query's tokens between separators, of at least so many bytes."""
    for c in QUERY_SEPARATORS:
        query = query.replace(c, "\0")
    return [t for t in query.split("\0") if len(t.encode()) >= least]


def json_field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")


def url_decoded(text: Column) -> Column:
    return F.url_decode(text)


def json_escaped(text: Column) -> Column:
    """The text as a JSON string's inside."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("s"))), r'(?s)^\{"s":"(.*)"\}$', "$1")

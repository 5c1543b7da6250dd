"""Every registered query of the library against its SQL in DuckDB, on the tables of sf0.001."""

import math
import os

import duckdb
import pytest

from quillstone.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame, sql = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(frame.columns) == sorted(sql.columns)
    columns = sorted(frame.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    theirs = sorted(tuple(plain(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall())
    assert ours == theirs


def words(text):
    return "".join((text or "").split())


def test_pages_of_texts(spark, duck):
    """Every page is of a page's size, and the pages of a text of many paragraphs are the text without its short ones."""
    texts = {r[0]: r[1] for r in duck.sql("select doc_id, text from documents").fetchall()}
    pages = {}
    for r in sorted(QUERIES["paragraph_split"](spark, DATA).collect(), key=lambda r: (r.doc_id, r.page)):
        pages.setdefault(r.doc_id, []).append(r.text)
    assert len(pages) > 100
    for doc, own in pages.items():
        assert all(0 < len(p.encode()) <= 3001 for p in own)
        joined, whole = words("".join(own)), words(texts[doc])
        long = [words(p) for p in texts[doc].split("\n\n") if len(p.strip().encode()) >= 50]
        assert joined == whole or joined == "".join(long) or len(texts[doc].encode()) > 2000 and whole.startswith(joined)


def test_windows_of_texts(spark, duck):
    texts = {r[0]: r[1] for r in duck.sql("select doc_id, text from documents").fetchall()}
    rows = QUERIES["chunk_windows"](spark, DATA).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        if r.part == 1:
            assert r.content == texts[r.doc_id]
        else:
            head, _, body = r.content.partition("\n")
            assert head.endswith(f"// Part {r.part}") and body in texts[r.doc_id] and len(body.encode()) <= 1500 and r.part <= 5
    assert {r.doc_id for r in rows if r.part > 1} == {i for i, t in texts.items() if len(t.encode()) > 2000}


def test_markdown_of_pages(spark, duck):
    """Markdown keeps the visible words of a page in order and none of its scripts."""
    from html.parser import HTMLParser

    class Visible(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    pages = {r[0]: r[1] for r in duck.sql("select page_id, html from pages").fetchall()}
    letters = lambda t: [c for c in t if c.isalpha()]
    for r in QUERIES["html_markdown"](spark, DATA).collect():
        seen = Visible()
        seen.feed(pages[r.page_id])
        plain = __import__("re").sub(r"\]\([^)]*\)", "", r.markdown)
        for entity in ("&copy;", "&middot;"):
            plain = plain.replace(entity, "")
        assert letters(plain) == letters("".join(seen.out))

"""Books: paragraphs, pages, chapters, navigation.  Sequential splitting runs per text in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as X
from quillstone.operators.ranking import numbered
from quillstone.sources.staging import staged

#: Bytes of the shortest paragraph, of a sentence chunk, of a page; paragraphs below which
#: sentences decide, and from which text size; how far a cut moves back.
MIN_PARAGRAPH, SENTENCE_CHUNK, PAGE, FEW, FROM, BACKTRACK = 50, 8000, 3000, 5, 2000, 300
#: A sentence ends after . ! ? before white space or a quote, after a CJK mark, or at a blank line.
_BOUNDARY = re.compile(rb"[.!?](?=[ \n\r\"'])|\xe3\x80[\x82\x81]|\xef\xbc[\x81\x9f\x9b\x9a]|\n\n")


def sentence_ends(raw: bytes) -> list[int]:
    """Offsets behind all sentence boundaries."""
    return [m.end() for m in _BOUNDARY.finditer(raw)]


def best_cut(raw: bytes, start: int, target: int) -> int:
    """Where to cut a text from `start` at about `target` bytes: behind the last sentence boundary within
    reach, else behind white space, else at the target, never inside a character."""
    at = start + target
    if at >= len(raw):
        return len(raw)
    reach = max(start + 1, at - min(BACKTRACK, target // 3))
    ends = [m.end() for m in _BOUNDARY.finditer(raw, reach, min(len(raw), at + 4)) if m.start() <= at]
    if ends:
        return ends[-1]
    space = max(raw.rfind(b" ", reach, at + 1), raw.rfind(b"\n", reach, at + 1))
    if space >= 0:
        return space + 1
    while at > start + 1 and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


@F.pandas_udf(T.LongType())
def cut_at(text: pd.Series, target: pd.Series) -> pd.Series:
    """Where best_cut cuts each text from its beginning."""
    return pd.Series([best_cut((s or "").encode(), 0, int(t)) for s, t in zip(text, target, strict=True)])


def split_text(text: str) -> list[str]:
    """Pages of a text: paragraphs between blank lines, sentence chunks where paragraphs are few, long ones
    cut, and short neighbours merged up to a page."""
    raw = (text or "").encode()
    paragraphs = [p for p in (x.strip(b"\r\n \t") for x in re.split(rb"\n[ \t\r]*\n", raw)) if len(p) >= MIN_PARAGRAPH]
    if len(paragraphs) < FEW and len(raw) > FROM:
        paragraphs, start = [], 0
        for end in sentence_ends(raw):
            if end - start >= SENTENCE_CHUNK:
                paragraphs.append(raw[start:end])
                start = end
        if len(raw) - start >= MIN_PARAGRAPH:
            paragraphs.append(raw[start:])
    pieces = []
    for p in paragraphs:
        start = 0
        while start < len(p):
            cut = best_cut(p, start, PAGE) if len(p) - start > PAGE else len(p)
            pieces.append(p[start:cut])
            start = cut
    pages: list[bytes] = []
    for piece in pieces:
        if pages and len(pages[-1]) < PAGE and len(pages[-1]) + len(piece) + 1 <= PAGE:
            pages[-1] += b"\n" + piece
        else:
            pages.append(piece)
    return [p.decode(errors="ignore") for p in pages]


@F.pandas_udf(T.ArrayType(T.StringType()))
def pages_of(text: pd.Series) -> pd.Series:
    """The pages of each text."""
    return text.map(split_text, na_action=None)


def paged(chapters: DataFrame) -> DataFrame:
    """book, chapter, page (from 1), text, without style sheets, markup and noise, of chapters (book, chapter, text)."""
    rows = chapters.where(~X.is_css(F.col("text")) & ~X.is_markup(F.col("text"))).select("book", "chapter", F.posexplode(pages_of("text")).alias("_p", "text"))
    return rows.where(~X.is_noise(F.col("text"))).select("book", "chapter", (F.col("_p") + 1).alias("page"), "text")


def page_key(book: Column | str = "book", chapter: Column | str = "chapter", page: Column | str = "page") -> Column:
    return F.format_string("/books/%s/chapters/%s/page_%04d", book, chapter, page)


def page_rows(pages: DataFrame) -> DataFrame:
    """key, value rows of pages: {type, md_file, preview, content_len}."""
    key = page_key()
    value = F.to_json(F.struct(F.lit("page").alias("type"), F.concat(F.substring(key, 2, 4096), F.lit(".md")).alias("md_file"), X.preview(F.col("text")).alias("preview"), F.octet_length("text").alias("content_len")))
    return pages.select(key.alias("key"), value.alias("value"))


def chapter_numbers(chapters: DataFrame) -> DataFrame:
    """Chapters (book, position, level, title, text) to import, with dense numbers from 0 per book: no
    levels below the second, no part titles, no empty texts."""
    part = (F.col("level") == 0) & F.lower("title").startswith("part")
    kept = chapters.where((F.col("level") < 2) & ~part & (F.trim("text") != ""))
    return kept.withColumn("index", F.row_number().over(Window.partitionBy("book").orderBy("position")) - 1)


def chapter_spans(outline: DataFrame, page_counts: DataFrame) -> DataFrame:
    """book, title, first_page, end_page: an outline's (book, page, level, title) chapters above the second
    level reach to the next one; a book without any is one chapter, full."""
    tops = outline.where("level < 2")
    following = F.lead("page").over(Window.partitionBy("book").orderBy("page", "title"))
    spans = tops.withColumn("_next", following).join(page_counts, "book").select("book", "title", F.col("page").alias("first_page"), F.coalesce("_next", F.col("pages") + 1).alias("end_page"))
    whole = page_counts.join(tops, "book", "left_anti").select("book", F.lit("full").alias("title"), F.lit(1).alias("first_page"), (F.col("pages") + 1).alias("end_page"))
    return spans.unionByName(whole)


def assembled(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """book, title, pages: how many pages (book, page) each span holds; the join is by book, then by range."""
    inside = (F.col("page") >= F.col("first_page")) & (F.col("page") < F.col("end_page"))
    return pages.join(spans, "book").where(inside).groupBy("book", "title").agg(F.count("*").alias("pages"))


def flat_outline(nodes: DataFrame) -> DataFrame:
    """book, id, level, title, page of an outline tree (book, id, parent, title, page) of any depth: level by level,
    each a join of one level with its children, staged, until a level is empty."""
    level = nodes.where("parent is null").withColumn("level", F.lit(0))
    out = level
    for n in range(1, nodes.count() + 1):  # a tree has no more levels than nodes
        children = nodes.alias("c").join(level.select(F.col("book").alias("_b"), F.col("id").alias("_i")), (F.col("c.book") == F.col("_b")) & (F.col("c.parent") == F.col("_i")))
        level = staged(children.select("c.*").withColumn("level", F.lit(n)), "outline")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("parent")


def contents(pages: DataFrame) -> DataFrame:
    """book, chapter, pages: the table of contents."""
    return pages.groupBy("book", "chapter").agg(F.count("*").alias("pages"))


def neighbours(pages: DataFrame) -> DataFrame:
    """Pages (book, chapter, page) with the page before and after in reading order."""
    order = Window.partitionBy("book").orderBy("chapter", "page")
    return pages.withColumn("previous", F.lag("page").over(order)).withColumn("next", F.lead("page").over(order))


def without_vectors(keys: DataFrame, vectors: DataFrame, namespace: str) -> DataFrame:
    """Page keys of a namespace that have no vector yet."""
    pages = keys.where(F.col("key").startswith(namespace + "/") & F.contains("key", F.lit("/page_")))
    return pages.join(vectors.select("key"), "key", "left_anti")


def with_vectors(keys: DataFrame, vectors: DataFrame, namespace: str) -> DataFrame:
    """key, embedding of a namespace's pages that have a vector, for export."""
    pages = keys.where(F.col("key").startswith(namespace + "/") & F.contains("key", F.lit("/page_")) & ~F.contains("key", F.lit("/_meta")))
    return pages.select("key").join(vectors.select("key", "embedding"), "key")


def overview(pages: DataFrame) -> DataFrame:
    """book, chapters, pages, bytes."""
    return pages.groupBy("book").agg(F.count_distinct("chapter").alias("chapters"), F.count("*").alias("pages"), F.sum(F.octet_length("text")).alias("bytes"))


def embedding_batches(pages: DataFrame, size: int = 32) -> DataFrame:
    """Pages in batches of like length."""
    return numbered(pages.withColumn("_l", F.octet_length("text")), "_l", "book", "chapter", "page", name="_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_l", "_n")

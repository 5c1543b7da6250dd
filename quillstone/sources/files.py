"""Sources and sinks of files: JSON lines, source trees, tag records, vectors, Markdown pages, books, HTML."""

from __future__ import annotations

import html.parser
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as X
from quillstone.functions import vectors as V
from quillstone.operators.graph import MAX_SITES
from quillstone.operators.ranking import first_per

CHUNKS = "name string, file string, kind string, line_start long, line_end long, language string, signature string, content string, docstring string"
TAGS = "_type string, name string, path string, kind string, line long, pattern string, signature string, scope string"
#: Directories that a source walk leaves out.
NOISE_DIRECTORIES = (".git", "node_modules", "build", "dist", "target", "__pycache__", "vendor", "third_party", ".venv", "venv")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records of JSON lines, with an explicit schema."""
    return spark.read.schema(CHUNKS).json(path)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Tag records of JSON lines: only entries of type tag."""
    return spark.read.schema(TAGS).json(path).where(F.col("_type") == "tag").drop("_type").withColumn("category", X.kind_category(F.col("kind")))


def read_source_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, language, bytes, content of the source files below a folder; noise directories and other
    extensions are left out before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.lit(True)
    for name in (*NOISE_DIRECTORIES, *exclude):
        inside = inside & ~F.contains("path", F.lit(f"/{name}/"))
    kept = files.where(inside & ~X.skipped_file(F.col("path"))).withColumn("language", X.language_of(F.col("path"))).where("language <> 'unknown'")
    return kept.select("path", "language", F.col("length").alias("bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def json_rows(frame: DataFrame) -> DataFrame:
    """json: every row as a JSON object."""
    return frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(frame: DataFrame, path: str) -> None:
    json_rows(frame).withColumnRenamed("json", "value").write.mode("overwrite").text(path)


def write_vectors(frame: DataFrame, path: str, name: str = "name") -> None:
    """One Parquet table of names and vectors at length 1."""
    frame.select(name, V.normalised(F.col("embedding")).cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Markdown pages (book, chapter, page, text) as text files, a folder for each page."""
    pages.select("book", "chapter", "page", F.col("text").alias("value")).write.mode("overwrite").partitionBy("book", "chapter", "page").text(path)


class _Markdown(html.parser.HTMLParser):
    """Writes Markdown while it reads tags."""

    WRAP = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "tt": "`"}
    LINES = ("p", "div", "ul", "ol", "table", "tr", "li", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote")

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.text: list[str] = []  # between two tags; entities split it
        self.skip, self.pre, self.links = 0, 0, []

    def flush(self):
        data = "".join(self.text)
        self.text.clear()
        if not self.skip and (self.pre or data.strip()):
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))

    def handle_starttag(self, tag, attrs):
        self.flush()
        attrs = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n```\n")
        elif tag in self.WRAP and not self.pre:
            self.out.append(self.WRAP[tag])
        elif tag == "a":
            self.links.append(attrs.get("href") or "")
            self.out.append("[")
        elif tag in ("li", "dt"):
            self.out.append("\n- ")
        elif tag == "blockquote":
            self.out.append("\n> ")
        elif tag == "hr":
            self.out.append("\n---\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "img":
            self.out.append(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")

    def handle_endtag(self, tag):
        self.flush()
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n")
        elif tag in self.WRAP and not self.pre:
            self.out.append(self.WRAP[tag])
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in self.LINES:
            self.out.append("\n")

    def handle_data(self, data):
        self.text.append(data)

    def handle_entityref(self, name):
        self.text.append(dict(X.ENTITIES).get(f"&{name};", f"&{name};"))

    def handle_charref(self, name):
        try:
            self.text.append(chr(int(name[1:], 16) if name[:1] in "xX" else int(name)))
        except (ValueError, OverflowError):
            pass


def markdown(source: str | None) -> str:
    """Markdown of an HTML text; at most one blank line in a row."""
    reader = _Markdown()
    reader.feed(source or "")
    reader.close()
    reader.flush()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(reader.out))).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(source: pd.Series) -> pd.Series:
    return source.map(markdown, na_action=None)


def epub_chapters_of(raw: bytes) -> list[tuple[int, str, str]]:
    """(position, title, Markdown) of an EPUB's spine, from the standard library's readers."""
    import posixpath
    import xml.etree.ElementTree as ET

    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        container = ET.fromstring(book.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
        root, folder = ET.fromstring(book.read(package)), posixpath.dirname(package)
        items = {e.get("id"): e.get("href") for e in root.iter() if e.tag.endswith("}item")}
        out = []
        for n, ref in enumerate(e.get("idref") for e in root.iter() if e.tag.endswith("}itemref")):
            if ref in items:
                source = book.read(posixpath.normpath(posixpath.join(folder, items[ref]))).decode(errors="replace")
                title = re.search(r"(?is)<(?:title|h1|h2)[^>]*>(.*?)</", source)
                out.append((n, re.sub(r"<[^>]*>", "", title[1]).strip() if title else items[ref], markdown(source)))
        return out


@F.udf(returnType=T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])), useArrow=True)
def epub_chapters(raw):
    return epub_chapters_of(bytes(raw)) if raw else []


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """book, position, level, title, text of the chapters of EPUB files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    book = F.regexp_extract("path", r"([^/]+)\.epub$", 1)
    return files.select(book.alias("book"), F.explode(epub_chapters("content")).alias("c")).select("book", "c.position", F.lit(0).alias("level"), "c.title", "c.text")


def repository_rows(owner: str, name: str, files: DataFrame, tags: DataFrame) -> DataFrame:
    """key, value rows of an imported repository: sources, symbols (at most MAX_SITES places of a name) and metadata."""
    base = f"/github/{owner}/{name}"
    out = files.select(F.concat(F.lit(f"{base}/src/"), "path").alias("key"), F.col("content").alias("value"))
    symbols = first_per(tags, MAX_SITES, "name", "path", "line", "kind").groupBy("name").agg(F.to_json(F.array_sort(F.collect_list(F.struct("path", "line", "kind", "category")))).alias("value"))
    out = out.unionByName(symbols.select(F.concat(F.lit(f"{base}/symbols/"), "name").alias("key"), "value"))
    meta = files.groupBy(X.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files")))).alias("languages"))
    return out.unionByName(meta.select(F.lit(f"{base}/_meta").alias("key"), F.to_json("languages").alias("value")))


def indexed_by_plugin(files: DataFrame, plugins: list[tuple[int, tuple[str, ...], object]], schema: str) -> DataFrame:
    """Records of plugins (priority, extensions, generator of rows from (path, content)); of several for an
    extension the highest priority runs.  Batches go through mapInPandas."""
    chosen = {}
    for _, extensions, run in sorted(plugins, key=lambda p: p[0]):
        chosen.update(dict.fromkeys(extensions, run))

    def index(frames):
        for frame in frames:
            rows = [row for path, content in zip(frame["path"], frame["content"], strict=True) for row in chosen[path.rsplit(".", 1)[-1]](path, content)]
            yield pd.DataFrame(rows)

    return files.where(F.regexp_extract("path", r"\.([^./]*)$", 1).isin(*chosen)).select("path", "content").mapInPandas(index, schema)

"""Queries of the text functions."""

from pyspark.sql import functions as F

from quillstone.functions import hashes as H
from quillstone.functions import text as X
from quillstone.operators import aggregates as A
from quillstone.operators import books as B
from quillstone.operators import code as C
from quillstone.plans.registry import head_has, preview_of, query, rounded, table

_WORDS = "list_transform(list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+'), lambda w: length(w) >= 2), lambda w: left(w, 63))"
_LETTERS = r"(strlen(text) - strlen(regexp_replace(text, '[A-Za-z]|[^\x00-\x7F]', '', 'g')))"
_CSS = " + ".join(f"contains(html, '{k}')::int" for k in X.CSS_KEYWORDS)
_STRIP = r"regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>', ' ', 'g')"
for _e, _c in X.ENTITIES:
    _STRIP = f"replace({_STRIP}, '{_e}', " + ("chr(39))" if _c == "'" else f"'{_c}')")


@query("select word, count(*) as df, round(ln((select count(*) from documents) / (count(*) + 1)) + 1, 6) as idf from (select unnest(" + _WORDS + ") as word from documents) group by word having count(*) >= 3")
def word_freq_idf(spark, d):
    return A.word_frequencies(table(spark, d, "documents")).select("word", "df", rounded("idf").alias("idf"))


@query("select word, count(*) as df, round(ln((select count(*) from documents) / (count(*) + 1)) + 1, 6) as idf from (select unnest(list_distinct(" + _WORDS + ")) as word from documents) group by word having count(*) >= 3")
def word_freq_documents(spark, d):
    return A.word_frequencies(table(spark, d, "documents"), mode="document").select("word", "df", rounded("idf").alias("idf"))


@query("select doc_id, strlen(text) < 50 or " + _LETTERS + " < floor(strlen(text) * 0.3) as noise from documents")
def noise_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", X.is_noise(F.col("text")).alias("noise"))


@query(f"select page_id, contains(html, '@media') or contains(html, '@font-face') or contains(html, '.calibre') or ({_CSS}) >= 2 as css, starts_with(html, '<') and contains(html, '>') as markup from pages")
def css_filter(spark, d):
    return table(spark, d, "pages").select("page_id", X.is_css(F.col("html")).alias("css"), X.is_markup(F.col("html")).alias("markup"))


@query(f"select page_id, trim(regexp_replace({_STRIP}, '[ \\t\\r\\n]+', ' ', 'g')) as text from pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("select p_partkey, levenshtein(p_name, p_type) as distance, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) as score from part")
def edit_distance(spark, d):
    return table(spark, d, "part").select("p_partkey", X.byte_levenshtein(F.col("p_name"), F.col("p_type")).cast("long").alias("distance"), rounded(X.fuzzy_score(F.col("p_name"), F.col("p_type"))).alias("score"))


@query(f"select doc_id, {head_has('text', 'the')} + {head_has('text', 'token')} as hits from documents")
def keyword_matches(spark, d):
    return table(spark, d, "documents").select("doc_id", X.keyword_matches(F.col("text"), "The token").alias("hits"))


@query("select page_id, case when page_id % 2 = 0 then page_id else 999 end as paragraph from pages")
def paragraph_number(spark, d):
    key = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/books/b/content/p"), F.lpad(F.col("page_id").cast("string"), 6, "0"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", X.paragraph_number(key).cast("long").alias("paragraph"))


@query("select p_partkey, case when p_partkey % 4 = 0 then 'exact' when p_partkey % 4 = 1 then 'context' when p_partkey % 4 = 2 then 'search' else 'symbol' end as type from part")
def query_router(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("/code/a/"), k)).when(k % 4 == 1, F.concat(F.lit("name_"), k)).when(k % 4 == 2, F.concat(F.lit("find it "), k)).otherwise(F.concat(F.lit("a::b"), k))
    return table(spark, d, "part").select("p_partkey", X.query_type(text, True).alias("type"))


@query("select p_partkey, (['c', 'c', 'cpp', 'cpp', 'python', 'go', 'rust', 'java', 'javascript', 'typescript', 'unknown'])[p_partkey % 11 + 1] as language from part")
def language_by_extension(spark, d):
    names = F.array(*(F.lit(x) for x in ("c", "h", "cpp", "hpp", "py", "go", "rs", "java", "js", "ts", "txt")))
    return table(spark, d, "part").select("p_partkey", X.language_of(F.concat(F.lit("src/file."), F.element_at(names, (F.col("p_partkey") % 11 + 1).cast("int")))).alias("language"))


@query("select doc_id, regexp_extract(k, '^(.*)/[^/]*$', 1) as namespace, regexp_extract(k, '([^/]*)$', 1) as name from (select doc_id, '/' || lang || '/' || source || '/' || doc_id as k from documents)")
def namespace_split(spark, d):
    key = F.concat_ws("/", F.lit(""), "lang", "source", "doc_id")
    return table(spark, d, "documents").select("doc_id", X.namespace_of(key).alias("namespace"), X.name_of(key).alias("name"))


@query(f"select doc_id, {preview_of('text')} as preview from documents")
def previews(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("select page_id, regexp_replace(regexp_replace(url, '[/\\\\:*?\"<>| \\t\\n\\r]', '_', 'g'), '_+$', '') as name from pages")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@query("select page_id, case when page_id + 1 < 10 then '0' else '' end || (page_id + 1) || '-' || left(regexp_replace(regexp_replace(url, '[/\\\\:*?\"<>| \\t\\n\\r]', '_', 'g'), '_+$', ''), 60) as name from pages")
def chapter_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.chapter_name(F.col("page_id"), F.col("url")).alias("name"))


@query("select doc_id, regexp_matches(text, '(^|[^A-Za-z0-9])token([^A-Za-z0-9]|$)') as has_word from documents")
def bounded_word(spark, d):
    return table(spark, d, "documents").select("doc_id", X.contains_word(F.col("text"), "token").alias("has_word"))


@query("select event_id, case when event_id % 3 = 0 then 'field' || event_id else '' end as field from events")
def struct_field(spark, d):
    e = F.col("event_id")
    line = F.when(e % 3 == 0, F.concat(F.lit("x = ctx->field"), e, F.lit(";"))).otherwise(F.concat(F.lit("y = other.f"), e))
    return table(spark, d, "events").select("event_id", X.struct_field(line, "ctx").alias("field"))


@query("select event_id, 'a b&c' || event_id as decoded from events")
def url_decode(spark, d):
    return table(spark, d, "events").select("event_id", X.url_decoded(F.concat(F.lit("a+b%26c"), "event_id")).alias("decoded"))


@query("select p_partkey, p_name || ' (c) sig' || p_partkey || ' ' || p_type || ' line one line two' as text from part")
def embedding_text(spark, d):
    content = F.lit("\n  line one\n\n\tline two\n")
    return table(spark, d, "part").select("p_partkey", X.embedding_text(F.col("p_name"), F.lit("c"), F.concat(F.lit("sig"), "p_partkey"), F.col("p_type"), F.regexp_replace(content, "\t", " ")).alias("text"))


@query("select p_partkey, (['function', 'function', 'struct', 'variable', 'namespace', 'enum', 'unknown'])[p_partkey % 7 + 1] as category from part")
def kind_category(spark, d):
    kinds = F.array(*(F.lit(x) for x in ("function", "METHOD", "union", "member", "package", "enumerator", "label")))
    return table(spark, d, "part").select("p_partkey", X.kind_category(F.element_at(kinds, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("category"))


@query("select p_partkey, (['cpp', 'c', 'python', 'go', 'rust', 'javascript', 'unknown'])[p_partkey % 7 + 1] as language from part")
def language_of_code(spark, d):
    codes = F.array(*(F.lit(x) for x in ("#include <iostream>", "#include <a.h>", "import os", "package a\nfunc b()", "use a::b;", "x; import a from 'b'", "nothing")))
    return table(spark, d, "part").select("p_partkey", X.language_of_code(F.element_at(codes, (F.col("p_partkey") % 7 + 1).cast("int"))).alias("language"))


@query("select event_id, contains(p, '.test.') or contains(p, 'node_modules') as skipped, contains(p, '/test') as noise from (select event_id, case event_id % 3 when 0 then 'src/a' || event_id || '.test.ts' when 1 then 'x/node_modules/b.js' else 'lib/test/c.c' end as p from events)")
def path_filters(spark, d):
    e = F.col("event_id")
    path = F.when(e % 3 == 0, F.concat(F.lit("src/a"), e, F.lit(".test.ts"))).when(e % 3 == 1, F.lit("x/node_modules/b.js")).otherwise(F.lit("lib/test/c.c"))
    return table(spark, d, "events").select("event_id", X.skipped_file(path).alias("skipped"), X.is_noise_path(path).alias("noise"))


_BYTES = "list_transform(range(1, length(p_name) + 1), lambda i: unicode(substr(p_name, i::int, 1))::uhugeint)"
_2_64 = "18446744073709551616::uhugeint"


@query(f"""
select p_partkey, list_reduce(list_prepend(14695981039346656037::uhugeint, {_BYTES}), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % {_2_64})::decimal(20, 0) as fnv,
  list_reduce(list_prepend(5381::uhugeint, {_BYTES}), lambda h, b: (h * 33 + b) % {_2_64})::decimal(20, 0) as djb2 from part""")
def hash_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", H.fnv1a64("p_name").alias("fnv"), H.djb2("p_name").alias("djb2"))


@query("select p_partkey, 3632233996 as known, true as same from part")
def crc_32(spark, d):
    """CRC-32 of a text with a known sum, and of two spellings of a row's text."""
    part = table(spark, d, "part")
    return part.select("p_partkey", H.crc(F.when(F.col("p_partkey").isNotNull(), "test")).alias("known"), (H.crc(F.col("p_name")) == F.crc32(F.col("p_name").cast("binary"))).alias("same"))


@query("select p_partkey, case when p_size <= 30 then p_size + 91 else 120 end::bigint as cut from part")
def best_cuts(spark, d):
    text = F.concat(F.repeat(F.lit("x"), F.col("p_size") + 90), F.lit(". "), F.repeat(F.lit("y"), 300))
    return table(spark, d, "part").select("p_partkey", B.cut_at(text, F.lit(120)).alias("cut"))


_PARA = "(repeat('{0} word ', 120) || p_partkey)"


@query("select p_partkey, page, text from (" + " union all ".join(f"select p_partkey, {n} as page, " + " || chr(10) || ".join(_PARA.format(x) for x in names) + " as text from part" for n, names in enumerate((("p0", "q0", "p1"), ("q1", "p2", "q2")))) + ")")
def paragraph_pages(spark, d):
    """Six paragraphs of about 960 bytes: three make a page, as a fourth would not fit."""
    def one(letter, page):
        return F.concat(F.repeat(F.lit(f"{letter}{page} word "), 120), F.col("p_partkey"))

    text = F.concat_ws("\n \n", *(one(letter, page) for page in range(3) for letter in "pq"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(B.pages_of(text)).alias("page", "text"))


@query("""
with t as (select p_partkey, list_transform(range(60), lambda i: rpad('line ' || i || ' of ' || p_partkey, 49, 'x')) as lines from part),
c as (select p_partkey, array_to_string(lines, chr(10)) || chr(10) as content from t)
select p_partkey, part, case part when 1 then content when 2 then 'sig // Part 2' || chr(10) || substr(content, 1001, 1500) when 3 then 'sig // Part 3' || chr(10) || substr(content, 2001, 1000) else 'sig // Part 4' || chr(10) || substr(content, 2501, 500) end as content
from c, (values (1), (2), (3), (4)) p(part)""")
def code_windows(spark, d):
    lines = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.rpad(F.concat(F.lit("line "), i, F.lit(" of "), "p_partkey"), 49, "x"))
    content = F.concat(F.array_join(lines, "\n"), F.lit("\n"))
    return table(spark, d, "part").select("p_partkey", F.explode(C.body_windows(content, F.lit("sig"), F.col("p_name"))).alias("c")).select("p_partkey", "c.part", "c.content")


@query("""
select p_partkey, '# ' || p_name || chr(10) || 'size **' || p_size || '** of *' || p_type || '* & [brand](/b/' || p_partkey || ')' || chr(10) || chr(10) || '- one' || chr(10) || chr(10) || '- `two`' || chr(10) || chr(10) || '```' || chr(10) || 'a  b' || chr(10) || '```' as markdown from part""")
def markdown_of_html(spark, d):
    from quillstone.sources.files import html_to_markdown

    html = F.concat(F.lit("<h1>"), "p_name", F.lit("</h1><script>x()</script><p>size <b>"), "p_size", F.lit("</b> of <i>"), "p_type", F.lit("</i> &amp; <a href='/b/"), "p_partkey", F.lit("'>brand</a></p><ul><li>one</li><li><code>two</code></li></ul><pre>a  b</pre>"))
    return table(spark, d, "part").select("p_partkey", html_to_markdown(html).alias("markdown"))


@query()
def paragraph_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(B.pages_of("text")).alias("page", "text"))


@query()
def chunk_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(C.body_windows("text", F.lit(""), "source")).alias("c")).select("doc_id", "c.part", "c.content")


@query()
def html_markdown(spark, d):
    from quillstone.sources.files import html_to_markdown

    return table(spark, d, "pages").select("page_id", html_to_markdown("html").alias("markdown"))

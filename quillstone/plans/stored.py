"""Queries of sources, sinks, snapshots, logs, transactions and commands: each writes to the shared folder and reads back."""

import itertools
import uuid

from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.operators import code as C
from quillstone.operators import graph as G
from quillstone.operators import keyed as K
from quillstone.operators import table as T
from quillstone.operators.client import Cache
from quillstone.plans.analysis import _bodies
from quillstone.plans.registry import KV_DOCUMENTS, NOW, kv_documents, query, rounded, table
from quillstone.sources import files as S
from quillstone.sources import snapshots
from quillstone.sources.ebooks import read_books
from quillstone.sources.staging import shared_root


def _fresh(spark) -> str:
    return f"{shared_root(spark)}/query-{uuid.uuid4().hex}"


def _put(spark, path: str, data: bytes) -> None:
    """A small file through the file system of the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data), 0, len(data))
    out.close()


@query("select 'nation' as name, count(*) as rows from nation union all select 'region', count(*) from region")
def database_tables(spark, d):
    """Three tables registered by name, one dropped again."""
    base = T.Database(spark)
    for name, key in (("nation", "n_nationkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey")):
        base.register(f"registered_{name}", frame=table(spark, d, name), order=(key,))
    base.drop("registered_supplier")
    out = [base.table(f"registered_{n}").frame.agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in ("nation", "region") if base.table(f"registered_{n}")]
    assert base.table("registered_supplier") is None
    base.close()
    return out[0].unionByName(out[1])


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 1000 order by o_totalprice desc, o_orderkey limit 20 offset 5")
def streamed_select(spark, d):
    """A filtered, ordered and cut query, drawn row by row."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    cut = T.select(rows, T.where_clause(o_totalprice__gt=1000), "o_totalprice", False, 20, 5, ("o_orderkey",))
    return spark.createDataFrame(list(T.stream(cut)), cut.schema)


@query(f"select key from {KV_DOCUMENTS} where starts_with(key, '/e') order by key limit 100")
def streamed_scan(spark, d):
    """A filtered scan in key order, drawn row by row and left after a hundred: the rest stays where it is."""
    rows = kv_documents(spark, d).where(F.col("key").startswith("/e")).select("key").orderBy("key")
    return spark.createDataFrame(list(itertools.islice(T.stream(rows), 100)), rows.schema)


@query(f"select key, value from {KV_DOCUMENTS}")
def kv_reopened(spark, d):
    """A keyed table written as a snapshot and opened again."""
    root = _fresh(spark)
    snapshots.write_snapshot(spark, root, {"entries": kv_documents(spark, d).limit(0)})
    snapshots.write_snapshot(spark, root, {"entries": kv_documents(spark, d)})
    return K.live(snapshots.read_snapshot(spark, root)["entries"], NOW).select("key", "value")


@query("select 'same' as export, true as verified union all select 'changed', false")
def snapshot_verify(spark, d):
    path, kv = _fresh(spark), kv_documents(spark, d).select("key", "value")
    snapshots.export(kv, path)
    rows = [("same", snapshots.verify(spark, path, kv, "key")), ("changed", snapshots.verify(spark, path, kv.withColumn("value", F.concat("value", F.lit(" "))), "key"))]
    return spark.createDataFrame(rows, "export string, verified boolean")


@query("select 'part_fn_' || p_partkey as name, 'function' as kind, p_partkey as line_start, 'src/' || (p_partkey % 10) || case when p_partkey % 10 = 0 then '.h' else '.c' end as file from part")
def json_chunks(spark, d):
    """Chunk records written as JSON lines and read with their schema."""
    path = _fresh(spark)
    S.write_json(_bodies(spark, d).drop("p_partkey", "p_size"), path)
    return S.read_chunks(spark, path).select("name", "kind", "line_start", "file")


@query("select 's_' || s_suppkey as name, s_name as path, case when s_suppkey % 2 = 0 then 'function' else 'variable' end as category from supplier where s_suppkey % 3 <> 0")
def tag_records(spark, d):
    """Tag records as JSON lines; other record types are left out."""
    path, k = _fresh(spark), F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(F.when(k % 3 == 0, "ptag").otherwise("tag").alias("_type"), F.concat(F.lit("s_"), k).alias("name"), F.col("s_name").alias("path"), F.when(k % 2 == 0, "method").otherwise("member").alias("kind"), k.alias("line"))
    S.write_json(rows, path)
    return S.read_tags(spark, path).select("name", "path", "category")


@query("select r_name || '.py' as name, 'python' as language, strlen(r_name) + 10 as bytes from region")
def source_tree(spark, d):
    """A source file for each region beside files that a walk leaves out."""
    root = _fresh(spark)
    for row in table(spark, d, "region").select("r_name").collect():  # a table of five rows
        _put(spark, f"{root}/src/{row.r_name}.py", f"region = {row.r_name}\n".encode())
        _put(spark, f"{root}/node_modules/{row.r_name}.js", b"x")
        _put(spark, f"{root}/src/{row.r_name}.test.ts", b"x")
        _put(spark, f"{root}/src/{row.r_name}.txt", b"x")
    return S.read_source_tree(spark, root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "language", "bytes")


@query("select r_name as book, 0 as position, r_name as title, '# ' || r_name || chr(10) || 'Text ' || r_regionkey as text from region union all select 'broken', null, null, null")
def book_files(spark, d):
    """An EPUB for each region, and a damaged file, which is a row of its own."""
    import io
    import zipfile

    root = _fresh(spark)
    for row in table(spark, d, "region").collect():  # a table of five rows
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("META-INF/container.xml", '<c xmlns="x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
            z.writestr("o/p.opf", '<package xmlns="y"><manifest><item id="1" href="c.xhtml"/></manifest><spine><itemref idref="1"/></spine></package>')
            z.writestr("o/c.xhtml", f"<html><body><h1>{row.r_name}</h1><p>Text {row.r_regionkey}</p></body></html>")
        _put(spark, f"{root}/{row.r_name}.epub", raw.getvalue())
    _put(spark, f"{root}/broken.mobi", b"not a book")
    return read_books(spark, root).select("book", "position", "title", "text")


@query("""
with p as (select 'src/' || (p_partkey % 10) || '_' || p_partkey || '.c' as file, p_partkey from part)
select '/github/acme/parts/src/' || file as key, null::varchar as path from p
union all select '/github/acme/parts/symbols/part_fn_' || p_partkey, 'src/' || (p_partkey % 10) || case when p_partkey % 10 = 0 then '.h' else '.c' end from part
union all select '/github/acme/parts/_meta', null""")
def repository_import(spark, d):
    bodies = _bodies(spark, d)
    files = bodies.select(F.concat(F.lit("src/"), F.col("p_partkey") % 10, F.lit("_"), "p_partkey", F.lit(".c")).alias("path"), "content")
    tags = bodies.select("name", F.col("file").alias("path"), F.col("line_start").alias("line"), "kind", F.lit("function").alias("category"))
    return S.repository_rows("acme", "parts", files, tags).select("key", F.when(F.contains("key", F.lit("/symbols/")), F.get_json_object("value", "$[0].path")).alias("path"))


@query("select 'v' || vec_id as name, 64::bigint as dim, case when list_sum(list_transform(embedding, lambda x: x * x)) > 0 then 1.0::double else 0.0::double end as length from embeddings where len(embedding) = 64")
def vector_file(spark, d):
    """Vectors written at length 1 and read again."""
    path = _fresh(spark)
    S.write_vectors(table(spark, d, "embeddings").where("size(embedding) = 64").select(F.concat(F.lit("v"), "vec_id").alias("name"), "embedding"), path)
    return S.read_vectors(spark, path).select("name", F.size("embedding").cast("long").alias("dim"), rounded(V.norm(F.col("embedding")), 4).alias("length"))


@query("select r_name as book, n_nationkey::int as page, '# ' || n_name || chr(10) || 'of ' || r_name as text from nation join region on n_regionkey = r_regionkey")
def page_files(spark, d):
    """A Markdown file for each nation, read back as whole texts."""
    path, region = _fresh(spark), table(spark, d, "region")
    rows = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("book"), F.lit("01").alias("chapter"), F.col("n_nationkey").alias("page"), F.concat(F.lit("# "), "n_name", F.lit("\nof "), "r_name").alias("text"))
    S.write_pages(rows, path)
    return spark.read.text(path, wholetext=True).select("book", F.col("page").cast("int").alias("page"), F.rtrim(F.regexp_replace("value", "\n$", "")).alias("text"))


@query("select 'COUNT' as command, ':' || count(*) as reply from region union all select 'GET /region/1', '$' || strlen(r_name) || chr(10) || r_name from region where r_regionkey = 1 union all select unnest(['PING', 'DEL /region/2', 'EXISTS /region/2', 'GET /region/2', 'SEARCH prefix /region/4', 'NO SUCH']), unnest(['+PONG', ':1', ':0', '$-1', '*1' || chr(10) || '/region/4' || chr(9) || '1.000000', '-ERR'])")
def text_commands(spark, d):
    """The text protocol's commands over a keyed table of the regions."""
    cache = Cache(spark)
    for row in table(spark, d, "region").collect():  # a table of five rows
        cache.execute(f"SET /region/{row.r_regionkey} {row.r_name}")
    lines = ["COUNT", "GET /region/1", "PING", "DEL /region/2", "EXISTS /region/2", "GET /region/2", "SEARCH prefix /region/4", "NO SUCH"]
    return spark.createDataFrame([(line, cache.execute(line)) for line in lines], "command string, reply string")


@query("select threshold, threshold > 0 and (select count(*) filter (o_orderkey % 3 = 0) / count(*) from orders) >= threshold as due from (values (0.3::double), (0.5), (0.0), (-1.0)) t(threshold)")
def auto_compact(spark, d):
    rows = T.delete(T.managed(table(spark, d, "orders").select("o_orderkey"), "o_orderkey"), F.col("o_orderkey") % 3 == 0)
    return spark.createDataFrame([(x, T.compact_due(rows, x)) for x in (0.3, 0.5, 0.0, -1.0)], "threshold double, due boolean")


@query("select n_nationkey, case when n_nationkey = 3 then 'renamed' else n_name end as n_name from nation where n_nationkey <> 5")
def transactions(spark, d):
    """An update and a delete committed, another delete rolled back."""
    base = T.Database(spark, auto_compact=0)
    nation = base.register("moving_nation", frame=table(spark, d, "nation").select("n_nationkey", "n_name"), order=("n_nationkey",))
    base.begin()
    nation.update(4, n_name="renamed")  # ids begin at 1
    nation.delete(6)
    base.commit()
    base.begin()
    nation.delete(1)
    base.rollback()
    out = nation.select().select("n_nationkey", "n_name")
    base.close()
    return out


@query("select o_orderkey, case when o_orderkey % 5 = 0 then o_totalprice * 2 else o_totalprice end as o_totalprice from orders where o_orderkey % 7 <> 0")
def change_log(spark, d):
    """Inserts, updates and deletes appended to a log, read back by its checksums and replayed."""
    orders, path = table(spark, d, "orders").select("o_orderkey", "o_totalprice"), _fresh(spark)
    n = orders.count()
    T.append_log(path, T.log_records(orders, T.INSERT, 1, "o_orderkey"))
    T.append_log(path, T.log_records(orders.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), T.UPDATE, n + 1, "o_orderkey"))
    T.append_log(path, T.log_records(orders.where("o_orderkey % 7 = 0"), T.DELETE, 2 * n + 1, "o_orderkey"))
    log = T.logged_rows(spark.read.parquet(path), "o_orderkey long, o_totalprice double")
    return T.replay(log, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("select r_regionkey, r_name from region")
def checkpoint_restored(spark, d):
    root = _fresh(spark)
    base = T.Database(spark, root)
    base.register("kept_region", frame=table(spark, d, "region"), order=("r_regionkey",))
    base.checkpoint()
    again = T.Database(spark, root)
    again.restore()
    out = T.scan(again.table("kept_region").frame).select("r_regionkey", "r_name")
    base.close()
    return out


@query(f"select key, value from {KV_DOCUMENTS} where starts_with(key, '/en/src1/') and key <> '/en/src1/1' union all select '/en/src1/new', 'value'")
def kv_namespace_keys(spark, d):
    """An entry set in a namespace, read, and another deleted there."""
    kv = K.remove_in(K.set_in(kv_documents(spark, d), "/en/src1/", "new", "value", NOW), "/en/src1", "1")
    rest = K.live(kv, NOW).where(K.in_namespace("/en/src1")).where("key <> '/en/src1/new'").select("key", "value")
    return rest.unionByName(K.get_in(kv, "/en/src1", "new", NOW))


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_nationkey < 5")
def indexed_lookup(spark, d):
    """A composite index changes how rows are stored, not what a filter finds."""
    base = T.Database(spark, max_rows=10_000_000)
    rows = base.register("indexed_customer", frame=table(spark, d, "customer"), order=("c_custkey",))
    rows.create_index("c_mktsegment", "c_nationkey")
    out = rows.where(c_mktsegment="BUILDING", c_nationkey__lt=5).select("c_custkey", "c_name")
    base.close()
    return out


_TERMS = "(select 'lib' || lower(n_name) || '-x' as term from nation where n_nationkey % 5 = 0)"
_REPOS = "(select '/code/acme/' || lower(n_name) as repo, lower(n_name) as name from nation)"


def _terms_and_repos(spark, d):
    nation = table(spark, d, "nation")
    terms = nation.where("n_nationkey % 5 = 0").select(F.concat(F.lit("lib"), F.lower("n_name"), F.lit("-x")).alias("term"))
    return terms, nation.select(F.concat(F.lit("/code/acme/"), F.lower("n_name")).alias("repo"))


@query(f"select distinct repo from {_REPOS} r, {_TERMS} t where contains(term, name) or contains(name, term) or contains(term, 'acme') or contains(regexp_replace(term, '[-_.]', '', 'g'), regexp_replace(name, '[-_.]', '', 'g'))")
def import_repositories(spark, d):
    terms, repos = _terms_and_repos(spark, d)
    return C.repositories_for(terms, repos)


@query(f"with m as (select distinct repo from {_REPOS} r, {_TERMS} t where contains(term, name) or contains(regexp_replace(term, '[-_.]', '', 'g'), regexp_replace(name, '[-_.]', '', 'g')) order by repo limit 3) select repo || '/symbols/' || s.symbol as key, 'at ' || repo as value from m, (values ('open'), ('close')) s(symbol) where s.symbol = 'open'")
def import_context(spark, d):
    """Records of imported symbols in the first three repositories that match; only open has records."""
    terms, repos = _terms_and_repos(spark, d)
    kv = repos.select(F.concat("repo", F.lit("/symbols/open")).alias("key"), F.concat(F.lit("at "), "repo").alias("value"))
    symbols = spark.createDataFrame([("open",), ("close",)], "symbol string")
    return C.imported_symbols(terms, symbols, repos.unionByName(spark.createDataFrame([("/code/acme/own",)], "repo string")), kv, "/code/acme/own")


@query("select 'part_fn_' || p_partkey as name, 'S' || p_partkey as symbols, 'C' || p_size as callers, null::varchar as callees, 'V' as variables from part where p_partkey = 7")
def symbol_context(spark, d):
    part, name = table(spark, d, "part"), F.concat(F.lit("part_fn_"), "p_partkey")
    rows = [(("symbols/"), F.concat(F.lit("S"), "p_partkey")), (("callers/"), F.concat(F.lit("C"), "p_size")), (("dataflow/vars/"), F.lit("V"))]
    kv = None
    for label, value in rows:
        own = part.select(F.concat(F.lit(f"/ns/{label}"), name).alias("key"), value.alias("value"))
        kv = own if kv is None else kv.unionByName(own)
    return C.context(kv, "/ns", "part_fn_7")


_WORDS = "(['int', 'char', 'uint8_t', 'return', 'typedef', 'total'])[p_partkey % 6 + 1]"


@query(f"select p_partkey, case when {_WORDS} in ('int', 'char', 'uint8_t') then 'type' when {_WORDS} in ('return', 'typedef') then 'keyword' else 'name' end as kind from part")
def c_words(spark, d):
    words = F.array(*(F.lit(x) for x in ("int", "char", "uint8_t", "return", "typedef", "total")))
    return table(spark, d, "part").select("p_partkey", C.c_word(F.element_at(words, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("kind"))


@query("select 'part_fn_' || p_partkey as src, 'helper_' || (p_size % 5) as dst, 'count|f(1, 2)' as args from part")
def call_arguments(spark, d):
    """The built graph with the arguments of each call."""
    bodies = _bodies(spark, d)
    known = bodies.select("name").union(spark.range(5).select(F.concat(F.lit("helper_"), "id")))
    return C.call_sites(bodies, known, arguments=True).select("src", "dst", F.array_join("args", "|").alias("args"))


@query("select 'helper_' || (p_size % 5) as name, 1 as depth from part where p_partkey = 7 union all select 'part_fn_7', 0")
def argument_flow(spark, d):
    """Where the variable count of one function goes, along the arguments of the built graph."""
    bodies = _bodies(spark, d)
    known = bodies.select("name").union(spark.range(5).select(F.concat(F.lit("helper_"), "id")))
    start = spark.createDataFrame([("part_fn_7",)], "name string")
    flow = G.flow(C.call_sites(bodies, known, arguments=True), "count", start, C.dataflow(bodies))
    return flow.select("name", F.col("depth").cast("int").alias("depth"))


@query("select p_partkey, 'int part_fn_' || p_partkey || '(int count) {' || chr(10) || '  int total = 0;' || chr(10) || '  total = helper_' || (p_size % 5) || '(count, f(1, 2));' || chr(10) || '  return total;' || chr(10) || '}' as body, 4 as block_end, 0 as declaration_end from part")
def definitions(spark, d):
    """The whole definition that begins at a line, where its block ends, and that a declaration has no block."""
    content = F.concat("content", F.lit("int later(void);\n"))
    return _bodies(spark, d).select("p_partkey", C.full_definition(content, F.lit(0)).alias("body"), C.block_end(F.split(content, "\n"), F.lit(0)).alias("block_end"), C.block_end(F.split(content, "\n"), F.lit(5)).alias("declaration_end"))


_OCCURRENCES = "(select 'part_fn_' || p_partkey as function, p_partkey, variable, kind, line from part, (values ('count', 'definition', 0), ('total', 'definition', 1), ('total', 'assignment', 2), ('count', 'usage', 2), ('total', 'usage', 3)) o(variable, kind, line))"


@query(f"select function, variable, kind, p_partkey + line as line from {_OCCURRENCES}")
def dataflow(spark, d):
    return C.dataflow(_bodies(spark, d).select("name", "file", "line_start", "content")).select("function", "variable", "kind", "line")


@query(f"select function, variable, count(*) filter (kind = 'definition') as definitions, count(*) filter (kind = 'assignment') as assignments, count(*) filter (kind = 'usage') as usages from {_OCCURRENCES} group by 1, 2")
def function_index(spark, d):
    occurrences = C.dataflow(_bodies(spark, d).select("name", "file", "line_start", "content"))
    return C.function_index(occurrences).drop("file")


@query("""
with b as (select p_partkey, 'part_fn_' || p_partkey as name, 'src/' || (p_partkey % 10) || case when p_partkey % 10 = 0 then '.h' else '.c' end as file from part)
select '/code/demo/parts/chunks/' || file || '/' || name as key, name as inside from b
union all select '/code/demo/parts/symbols/' || name, file from b
union all select '/code/demo/parts/callees/' || name, 'helper_1' from b
union all select '/code/demo/parts/callers/helper_1', least(count(*), 1000)::varchar from b
union all select '/code/demo/parts/dataflow/vars/count', null union all select '/code/demo/parts/dataflow/vars/total', null
union all select '/code/demo/parts/dataflow/_func_index/' || name, '["count","total"]' from b
union all select '/code/demo/parts/_meta/info', count(*)::varchar from b""")
def key_rows(spark, d):
    """The keys of an analysed repository, with something of each value."""
    bodies = _bodies(spark, d).drop("p_partkey", "p_size")
    known = spark.createDataFrame([("helper_1",)], "name string")
    sites = G.resolve_callees(bodies.select(F.col("name").alias("src"), F.lit("helper_1").alias("token"), "file", F.col("line_start").alias("line")), known)
    rows = C.key_rows("/code/demo/parts", bodies, sites, C.dataflow(bodies))
    part, value = F.split_part("key", F.lit("/"), F.lit(5)), F.col("value")
    inside = F.when(part == "chunks", F.get_json_object(value, "$.name")).when(part == "symbols", F.get_json_object(value, "$[0].file")).when(part == "callees", F.get_json_object(value, "$.sites[0].function"))
    inside = inside.when(part == "callers", F.size(F.from_json(F.get_json_object(value, "$.sites"), "array<struct<line:long>>")).cast("string")).when(F.contains("key", F.lit("_func_index")), value).when(part == "_meta", F.get_json_object(value, "$.chunks"))
    return rows.select("key", inside.alias("inside"))


#: A source text of each language around a number N: a function, a type and an import.
_SOURCES = {
    "python": "import os.path_N\n\ndef fn_N(a):\n    return a\n\nclass T_N(Base):\n    pass\n",
    "javascript": "import x from 'lib_N';\n\nfunction fn_N(a) { return a; }\n\nclass T_N {\n}\n",
    "java": "import java.util.List_N;\n\npublic class T_N {\n    public static int fn_N(int a) {\n        return a;\n    }\n}\n",
    "go": "import \"fmt_N\"\n\ntype T_N struct {\n}\n\nfunc (t T_N) fn_N(a int) int {\n}\n",
    "rust": "use std::mem_N;\n\nstruct T_N {\n}\n\nfn fn_N(a: i32) -> i32 {\n}\n",
    "c": "#include \"lib_N.h\"\n\nstruct T_N {\n};\n\nint fn_N(int a) {\n}\n",
}
_IMPORTED = {"python": "os.path_", "javascript": "lib_", "java": "java.util.List_", "go": "fmt_", "rust": "std::mem_", "c": "lib_"}
_LANGUAGES = sorted(_SOURCES)


def _sources(spark, d):
    part, k = table(spark, d, "part"), F.col("p_partkey")
    language = F.element_at(F.array(*(F.lit(x) for x in _LANGUAGES)), (k % 6 + 1).cast("int"))
    text = F.element_at(F.create_map(*(F.lit(x) for pair in _SOURCES.items() for x in pair)), language)
    return part.select("p_partkey", F.concat(F.lit("f"), k).alias("file"), language.alias("language"), F.replace(text, F.lit("N"), k.cast("string")).alias("content"))


_L = f"({_LANGUAGES})[p_partkey % 6 + 1]"
_I = "case " + " ".join(f"when {_L} = '{x}' then '{p}'" for x, p in _IMPORTED.items()) + " end"


@query(f"""
select 'f' || p_partkey as file, {_L} as language, 'function' as kind, 'fn_' || p_partkey as name from part
union all select 'f' || p_partkey, {_L}, case when {_L} in ('c', 'go', 'rust') then 'struct' else 'class' end, 'T_' || p_partkey from part
union all select 'f' || p_partkey, {_L}, 'import', {_I} || p_partkey || case when {_L} = 'c' then '.h' else '' end from part""")
def syntax_languages(spark, d):
    """Functions, types and imports in six languages."""
    return C.syntax_records(_sources(spark, d).select("file", "language", "content"))


@query("""
select p_partkey, case p_partkey % 4 when 0 then 'os,a' when 2 then 'fmt_' || p_partkey when 3 then 'std' else '' end as modules,
  case p_partkey % 4 when 1 then 'lib_' || p_partkey || ',two' when 2 then 'fmt_' || p_partkey else '' end as libraries,
  case when p_partkey % 4 = 0 then 'c,d_' || p_partkey else '' end as symbols from part""")
def import_languages(spark, d):
    """Imports of Python, JavaScript, Go and Rust."""
    part, k = table(spark, d, "part").select("p_partkey"), F.col("p_partkey")
    texts = {"python": "import os.path\nfrom a.b import c, d_N\n", "javascript": "import x from 'lib_N';\nrequire('./own');\nrequire('two');\n", "go": "import \"fmt_N\"\n", "rust": "use std::mem_N;\n"}
    out = None
    for n, (language, text) in enumerate(texts.items()):
        found = C.imports(F.replace(F.lit(text), F.lit("N"), k.cast("string")), language)
        rows = part.where(k % 4 == n).select("p_partkey", *(F.array_join(found[c], ",").alias(c) for c in ("modules", "libraries", "symbols")))
        out = rows if out is None else out.unionByName(rows)
    return out

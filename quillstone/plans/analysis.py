"""Queries of graphs, code, books, probes and other counts."""

from pyspark.sql import functions as F

from quillstone.operators import aggregates as A
from quillstone.operators import books as B
from quillstone.operators import code as C
from quillstone.operators import graph as G
from quillstone.plans.registry import CALLS, calls, query, rounded, table

_EDGES = f"(select distinct src, dst from {CALLS})"


def _edges(spark, d):
    return calls(spark, d).select("src", "dst").distinct()


_SITES = "string_agg({f} || ':' || file || ':' || line, ' ' order by {f}, file, line)"


def _listed(frame):
    return frame.select("name", "count", F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["function"].cast("string"), s["file"], s["line"].cast("string"))), " ").alias("sites"))


@query(f"select dst as name, count(*) as count, {_SITES.format(f='src')} as sites from {CALLS} group by 1")
def callers_count(spark, d):
    """Every callee with all of its call sites, which are fewer than the limit of an array here."""
    return _listed(G.callers(calls(spark, d), 1_000_000))


@query(f"with r as (select *, row_number() over (partition by src order by dst, file, line) as n from {CALLS}) select src as name, max(n) as count, {_SITES.format(f='dst')} filter (n <= 20) as sites from r group by 1")
def callees_list(spark, d):
    """Every caller with its first twenty call sites."""
    return _listed(G.callees(calls(spark, d), 20))


@query(f"select name, count(*) as \"references\" from (select src as name from {CALLS} union all select dst from {CALLS}) group by 1 order by 2 desc, 1 limit 20")
def top_referenced(spark, d):
    return G.referenced(calls(spark, d))


@query(f"""
with recursive e as (select * from {_EDGES}),
w(path, node, looped, depth) as (
  select [3::bigint], 3::bigint, false, 0
  union all
  select list_append(path, e.src), e.src, list_contains(path, e.src), depth + 1 from w join e on e.dst = w.node where not looped and depth < 2)
select array_to_string(path, '>') as path from w where depth = 2 or looped or not exists (select 1 from e where e.dst = w.node)""")
def call_paths(spark, d):
    return G.paths_up(_edges(spark, d), 3, 2, 1_000_000).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""
with recursive e as (select distinct src, dst from {CALLS}),
w(name, depth) as (select 3::bigint, 0 union select e.dst, depth + 1 from w join e on e.src = w.name where depth < 3)
select name, min(depth) as depth from w group by 1""")
def flow_reach(spark, d):
    edges = calls(spark, d).select("src", "dst")
    start = spark.range(3, 4).select(F.col("id").alias("name"))
    return G.reach(edges, start, 3)


@query(f"""
with recursive e as (select distinct src, dst from {CALLS} where line % 2 = 0),
w(name, depth) as (select 3::bigint, 0 union select e.dst, depth + 1 from w join e on e.src = w.name where depth < 2)
select name, min(depth) as depth, name % 2 = 0 as uses from w group by 1""")
def flow_bfs(spark, d):
    sites = calls(spark, d)
    edges = sites.select("src", "dst", F.when(F.col("line") % 2 == 0, F.array(F.lit("buf + 1"))).otherwise(F.array(F.lit("buffer"))).alias("args"))
    start = spark.range(3, 4).select(F.col("id").alias("name"))
    uses = sites.where("dst % 2 = 0").select(F.lit("buf").alias("variable"), F.col("dst").alias("function")).unionByName(sites.where("src % 2 = 0").select(F.lit("buf").alias("variable"), F.col("src").alias("function")))
    return G.flow(edges, "buf", start, uses, 2)


@query("select distinct case l_partkey % 2 when 0 then 'A' else 'B' end || '::f' || l_suppkey as src, case when l_partkey % 6 < 2 then case l_partkey % 2 when 0 then 'A' else 'B' end || '::own' when l_partkey % 6 < 4 then 'N' || l_suppkey || '::only_' || l_suppkey else 'bare' end as dst from lineitem")
def callee_resolution(spark, d):
    """Callees of three kinds: of the caller's scope, of the only scope that has the name, and without one."""
    k, n = F.col("l_partkey"), F.col("l_suppkey")
    items = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    token = F.when(k % 6 < 2, F.lit("own")).when(k % 6 < 4, F.concat(F.lit("only_"), n)).otherwise("bare")
    rows = items.select(F.concat(F.when(k % 2 == 0, "A").otherwise("B"), F.lit("::f"), n).alias("src"), token.alias("token")).distinct()
    known = items.select(F.concat(F.lit("N"), n, F.lit("::only_"), n).alias("name")).distinct().union(spark.createDataFrame([("A::own",), ("B::own",), ("bare",)], "name string"))
    return G.resolve_callees(rows, known).select("src", "dst")


#: Code generated from part rows: a body that calls a helper by the part's size, and a declaration.
_HELPERS = "(select distinct p_size % 5 as h from part)"


def _bodies(spark, d):
    part = table(spark, d, "part")
    name = F.concat(F.lit("part_fn_"), F.col("p_partkey"))
    content = F.concat(F.lit("int "), name, F.lit("(int count) {\n  int total = 0;\n  total = helper_"), F.col("p_size") % 5, F.lit("(count, f(1, 2));\n  return total;\n}\n"))
    return part.select("p_partkey", "p_size", name.alias("name"), F.concat(F.lit("src/"), F.col("p_partkey") % 10, F.when(F.col("p_partkey") % 10 == 0, ".h").otherwise(".c")).alias("file"), F.col("p_partkey").alias("line_start"), F.lit("c").alias("language"), F.lit("function").alias("kind"), content.alias("content"))


@query("select 'part_fn_' || p_partkey as src, 'helper_' || (p_size % 5) as dst, p_partkey + 2 as line from part")
def call_graph(spark, d):
    bodies = _bodies(spark, d)
    known = bodies.select("name").union(spark.range(5).select(F.concat(F.lit("helper_"), "id")))
    return C.call_sites(bodies, known).select("src", "dst", "line")


@query("select 'src/' || (p_partkey % 10) || case when p_partkey % 10 = 0 then '.h' else '.c' end as file, 'function' as kind, 'part_fn_' || p_partkey as name from part")
def ast_extract(spark, d):
    return C.syntax_records(_bodies(spark, d).select("file", "language", "content")).select("file", "kind", "name")


@query("select 'part_fn_' || p_partkey as name, case when p_partkey % 10 = 0 then 'src/0.h' else 'src/' || (p_partkey % 10) || '.c' end as file, p_partkey as line from part")
def symbol_index(spark, d):
    first = F.element_at("symbols", 1)
    return C.symbol_index(_bodies(spark, d)).select("name", first["file"].alias("file"), first["line"].alias("line"))


@query("select p_partkey, 'a/x.h,b.h' as headers, 'a,b.h' as libraries, 'call_' || p_partkey || ',ns::make' as symbols from part")
def import_parse(spark, d):
    code = F.concat(F.lit('#include <a/x.h>\n#include "b.h"\nif (x) call_'), "p_partkey", F.lit("(1); ns::make{2};"))
    found = C.imports(code, "cpp")
    return table(spark, d, "part").select("p_partkey", *(F.array_join(found[k], ",").alias(k) for k in ("headers", "libraries", "symbols")))


@query("select p_partkey, p_size < 3 or p_partkey % 4 = 0 as noise from part")
def noise_symbols(spark, d):
    name = F.when(F.col("p_partkey") % 4 == 0, "JSON").when(F.col("p_size") < 3, "x(y)").otherwise(F.concat(F.lit("handler_"), "p_partkey"))
    return table(spark, d, "part").select("p_partkey", C.noise_symbol(name).alias("noise"))


def _pages(spark, d):
    return table(spark, d, "pages").select((F.col("page_id") % 7).alias("book"), (F.floor(F.col("page_id") / 7) + 1).cast("int").alias("page"), "html")


_PAGES = "(select page_id % 7 as book, cast(floor(page_id / 7) as int) + 1 as page from pages)"


@query(f"""
with o as (select book, page, 'c' || page as title from {_PAGES} where page % 9 = 1), n as (select book, count(*) as pages from {_PAGES} group by 1),
s as (select o.book, title, page as first_page, coalesce(lead(page) over (partition by o.book order by page, title), pages + 1) as end_page from o join n using (book))
select s.book, s.title, count(*) as pages from s join {_PAGES} p on p.book = s.book and p.page >= first_page and p.page < end_page group by 1, 2""")
def chapter_pages(spark, d):
    pages = _pages(spark, d).select("book", "page")
    outline = pages.where("page % 9 = 1").select("book", "page", F.lit(1).alias("level"), F.concat(F.lit("c"), "page").alias("title"))
    outline = outline.unionByName(pages.where("page % 5 = 0").select("book", "page", F.lit(2).alias("level"), F.lit("section").alias("title")))
    return B.assembled(pages, B.chapter_spans(outline, pages.groupBy("book").agg(F.count("*").alias("pages"))))


@query(f"select book, page, lag(page) over (partition by book order by page) as previous, lead(page) over (partition by book order by page) as next from {_PAGES}")
def page_neighbours(spark, d):
    return B.neighbours(_pages(spark, d).select("book", F.lit("01").alias("chapter"), "page")).select("book", "page", "previous", "next")


@query(f"select book, page % 3 as chapter, count(*) as pages from {_PAGES} group by 1, 2")
def table_of_contents(spark, d):
    return B.contents(_pages(spark, d).withColumn("chapter", F.col("page") % 3))


@query("select n_regionkey as book, n_nationkey as id, case when n_nationkey % 3 = 0 then 0 else 1 end as level from nation where n_nationkey % 3 = 0 or n_regionkey = (select p.n_regionkey from nation p where p.n_nationkey = nation.n_nationkey - nation.n_nationkey % 3)")
def outline_flatten(spark, d):
    nation = table(spark, d, "nation")
    k = F.col("n_nationkey")
    nodes = nation.select(F.col("n_regionkey").alias("book"), k.alias("id"), F.when(k % 3 != 0, k - k % 3).alias("parent"), F.col("n_name").alias("title"), k.alias("page"))
    return B.flat_outline(nodes).select("book", "id", "level")


@query("select '/v/' || vec_id as key from embeddings where vec_id % 3 = 0")
def pages_without_vectors(spark, d):
    vectors = table(spark, d, "embeddings")
    keys = vectors.select("vec_id", F.concat(F.lit("/books/a/page_"), "vec_id").alias("key"))
    return B.without_vectors(keys, keys.where("vec_id % 3 <> 0"), "/books").select(F.concat(F.lit("/v/"), "vec_id").alias("key"))


@query("select '/books/a/page_' || vec_id as key, len(embedding) as dim from embeddings where vec_id % 3 <> 0")
def pages_with_vectors(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("/books/a/page_"), "vec_id").alias("key"), "embedding")
    return B.with_vectors(vectors.select("key"), vectors.where("vec_id % 3 <> 0"), "/books").select("key", F.size("embedding").cast("long").alias("dim"))


@query("select n_nationkey as position, row_number() over (order by n_nationkey) - 1 as index from nation where n_nationkey % 3 < 2 and not (n_nationkey % 3 = 0 and n_nationkey % 2 = 0)")
def chapter_numbers(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.lit("b").alias("book"), k.alias("position"), (k % 3).alias("level"), F.when(k % 2 == 0, F.concat(F.lit("Part "), "n_name")).otherwise(F.col("n_name")).alias("title"), F.lit("text").alias("text"))
    return B.chapter_numbers(rows).select("position", F.col("index").cast("long").alias("index"))


@query("select event_type as target, count(*) as call_count, round(sum(value), 4) as total, round(avg(value), 6) as mean, max(value) as largest from events where value > 10 group by 1")
def probe_count_sum_max(spark, d):
    samples = table(spark, d, "events").withColumnRenamed("event_type", "target")
    out = A.run_probe(samples, "target * when value > 10 collect call_count: count, total: sum(value), mean: avg(value), largest: max(value)")
    return out.select("target", "call_count", rounded("total", 4).alias("total"), rounded("mean").alias("mean"), "largest")


@query("select event_type, cast(floor(log2(value)) as int) as bucket, count(*) as count from events where value > 0 group by 1, 2")
def probe_hist(spark, d):
    return A.histogram(table(spark, d, "events"), "event_type", "value")


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.9) as p90, quantile_disc(value, 0.99) as p99 from events group by 1")
def probe_percentile(spark, d):
    return A.percentiles(table(spark, d, "events"), "event_type", "value", exact=True)


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.9) as p90, quantile_disc(value, 0.99) as p99 from events group by 1")
def probe_percentile_approx(spark, d):
    return A.percentiles(table(spark, d, "events"), "event_type", "value")


@query("with c as (select event_type, user_id, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by event_type order by n desc, user_id) as k from c) select event_type, user_id, n from r where k <= 10")
def probe_callers(spark, d):
    return A.caller_map(table(spark, d, "events"), "event_type", "user_id").select("event_type", F.explode("callers").alias("user_id", "n"))


@query("select event_type as state, count(*) as samples, count(distinct user_id) as stacks from events group by 1")
def off_cpu(spark, d):
    return A.off_cpu(table(spark, d, "events").select(F.col("event_type").alias("state"), F.col("user_id").alias("stack")))


@query("select event_type as state, user_id as stack, count(*) as samples from events group by 1, 2")
def off_cpu_stacks(spark, d):
    return A.off_cpu_stacks(table(spark, d, "events").select(F.col("event_type").alias("state"), F.col("user_id").alias("stack")))


@query("with t as (select user_id, count(*) as samples from events group by 1 order by 2 desc, 1 limit 10) select user_id, samples, round(samples / max(samples) over (), 6) as share from t")
def hot_top10_share(spark, d):
    return A.hot_functions(table(spark, d, "events"), "user_id").withColumn("share", rounded("share"))


@query("select (['c', 'cpp', 'python'])[doc_id % 3 + 1] as language, count(*) as files, cast(sum(n_chars) as bigint) as bytes from documents group by 1")
def language_histogram(spark, d):
    ext = F.element_at(F.array(F.lit("c"), F.lit("hpp"), F.lit("py")), (F.col("doc_id") % 3 + 1).cast("int"))
    return A.languages(table(spark, d, "documents").select(F.concat(F.lit("/a/"), "doc_id", F.lit("."), ext).alias("path"), F.col("n_chars").alias("bytes")))


@query("select project, count(*) as hits from (select lang as project, doc_id as name, n_chars as score from documents order by score desc, project, name limit 50) group by 1")
def project_distribution(spark, d):
    return A.project_counts(table(spark, d, "documents").select(F.col("lang").alias("project"), F.col("doc_id").alias("name"), F.col("n_chars").alias("score")), 50)


@query("select event_type as name, 'user=' || (user_id % 10) as labels, round(sum(value), 4) as total, count(*) as samples from events group by 1, 2")
def metric_totals(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("name"), F.concat(F.lit("user="), F.col("user_id") % 10).alias("labels"), "value")
    return A.metrics(rows).withColumn("total", rounded("total", 4))


@query("select user_id as task_id, count(distinct event_type) as received, case when count(distinct event_type) >= 5 then 'ok' when min(event_id) + 100 < 5000 then 'partial' else 'pending' end as status from events group by 1")
def task_gather(spark, d):
    return A.gathered(table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("node"), F.col("event_id").alias("sent_at")), 5, 100, 5000)


@query("select variable, field, count(*) as occurrences from (select o_orderstatus as variable, o_orderpriority as field from orders where o_orderkey % 3 > 0) group by 1, 2")
def field_breakdown(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("variable"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("field"))
    return C.field_counts(rows)


@query("select '/ns/chunks/f' || n_nationkey || '/' || n_name as key, case when n_nationkey % 2 = 0 then 'chunk' else 'record' end as value from nation")
def symbol_chunk(spark, d):
    k, name = F.col("n_nationkey"), F.col("n_name")
    nation = table(spark, d, "nation")
    symbol = F.array_sort(F.collect_list(F.struct(name.alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("f"), k).alias("file"), k.cast("long").alias("line"))))
    kv = nation.agg(F.lit("/ns/symbols/all").alias("key"), F.to_json(symbol).alias("value"))
    kv = kv.unionByName(nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("/ns/chunks/f"), k, F.lit("/"), name).alias("key"), F.lit("chunk").alias("value")))
    return C.symbol_chunk(kv, "/ns", "all").select("key", F.when(F.col("value").startswith("{"), "record").otherwise(F.col("value")).alias("value"))


@query("select source_file, symbol from (select 'a' || n_nationkey as source_file, case when n_nationkey % 2 = 0 then '*' else unnest(['x', 'y']) end as symbol from nation) group by 1, 2")
def import_edges(spark, d):
    k = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.concat(F.lit("a"), k).alias("source_file"), F.lit("b").alias("target_file"), F.when(k % 2 == 0, "side_effect").otherwise("named").alias("kind"), F.lit("x, y").alias("symbols"))
    return C.import_edges(rows).select("source_file", "symbol")


@query("select event_id from events where event_id % 3 <> 2")
def chunk_selection(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.when(e % 3 == 0, "class").otherwise("arrow_function").alias("kind"), (e % 3 == 1).alias("assigned"), F.lit(False).alias("exported"))
    return C.chunk_records(rows).select("event_id")



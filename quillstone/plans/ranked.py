"""Queries of vector search and ranking."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.operators import code as C
from quillstone.operators import graph as G
from quillstone.operators import keyed, ranking
from quillstone.operators import vectors as R
from quillstone.plans.analysis import _bodies
from quillstone.plans.registry import calls, head_has, query, rounded, table
from quillstone.sources.staging import shared_root

#: A fixed query vector of the tables' 64 dimensions.
QUERY = [round(float(np.sin(i + 1)), 3) for i in range(64)]
_Q = "[" + ", ".join(f"{x}::double" for x in QUERY) + "]"
_COS = f"list_inner_product(e, {_Q}) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product({_Q}, {_Q})))"
_E = "(select vec_id, list_transform(embedding, lambda x: x::double) as e, label from embeddings where len(embedding) = 64)"
_SIM = f"(({_COS}) + 1) / 2"


def _vectors(spark, d):
    return table(spark, d, "embeddings")


@query(f"select vec_id, round({_SIM}, 6) as score from {_E} order by {_SIM} desc, vec_id limit 10")
def vec_topk_exact(spark, d):
    return R.exact_top_k(_vectors(spark, d), QUERY, 10, name="vec_id").select("vec_id", rounded("score").alias("score"))


@query(f"select vec_id, round({_SIM}, 6) as score from {_E} where {_SIM} >= 0.55 order by {_SIM} desc, vec_id limit 20")
def vec_min_score(spark, d):
    return R.exact_top_k(_vectors(spark, d), QUERY, 20, 0.55, "vec_id").select("vec_id", rounded("score").alias("score"))


@query(f"select vec_id, round(list_inner_product(e, {_Q}), 6) as score from {_E} order by list_inner_product(e, {_Q}) desc, vec_id limit 10")
def vec_dot_topk(spark, d):
    return R.dot_top_k(_vectors(spark, d), QUERY, 10, "vec_id").select("vec_id", rounded("score").alias("score"))


@query(f"with s as (select q.vec_id as query_id, v.vec_id, (list_inner_product(v.e, q.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(q.e, q.e))) + 1) / 2 as score from {_E} v, {_E} q where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select query_id, vec_id, round(score, 6) as score, rank::int as rank from r where rank <= 5")
def vec_batch_topk(spark, d):
    """Every row whose id is divisible by 100 as a query."""
    rows = _vectors(spark, d)
    return R.all_top_k(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).select("query_id", "vec_id", rounded("score").alias("score"), "rank")


@query("select true as reached, count(*) as queries from embeddings where vec_id % 100 = 0 and len(embedding) = 64")
def vec_index_recall(spark, d):
    """Recall of the stored codes against brute force over all queries: 0.9 or more, also where there is none."""
    rows, path = _vectors(spark, d), f"{shared_root(spark)}/codes-{uuid.uuid4().hex}"
    R.write_index(R.build_index(rows, 64, name="vec_id"), path, "vec_id")
    index = spark.read.parquet(f"{path}/codes").join(spark.read.parquet(f"{path}/vectors"), "vec_id")
    asked = rows.where("vec_id % 100 = 0 and size(embedding) = 64").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = R.all_top_k(rows.where("size(embedding) = 64"), asked, 10).select("query_id", "vec_id")
    found = R.indexed_all_top_k(index, asked, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    recall = exact.join(found, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return recall.agg(F.coalesce(F.avg("recall") >= 0.9, F.lit(True)).alias("reached"), F.count("*").alias("queries"))


@query(f"select vec_id, round({_SIM}, 6) as score from {_E} order by {_SIM} desc, vec_id limit 1")
def vec_index_topk(spark, d):
    """The best vector by the stored codes."""
    index = R.build_index(_vectors(spark, d), 64, name="vec_id")
    return R.indexed_top_k(index, index, QUERY, 1, over=400, name="vec_id").select("vec_id", rounded("score").alias("score"))


@query(f"select vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow((e[i] + case when vec_id % 2 = 0 then e[65 - i] else 0 end) / case when vec_id % 2 = 0 then 2 else 1 end, 2)))), 6) as pooled, case when list_sum(list_transform(e, lambda x: x * x)) > 0 then 1.0::double else 0.0::double end as length from {_E}")
def vec_pooling(spark, d):
    rows = _vectors(spark, d).where("size(embedding) = 64")
    mean = V.mean_pooled(F.array("embedding", F.reverse("embedding")), F.array(F.lit(1), F.when(F.col("vec_id") % 2 == 0, 1).otherwise(0)))
    return rows.select("vec_id", rounded(V.norm(mean)).alias("pooled"), rounded(V.norm(V.normalised(mean))).alias("length"))


@query(f"select vec_id, round(sqrt(list_inner_product(n, n)), 6) as length from (select vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as n from {_E})")
def vec_normalise(spark, d):
    return _vectors(spark, d).select("vec_id", rounded(V.norm(V.normalised(F.col("embedding")))).alias("length"))


_KEY = "case when vec_id % 5 = 0 then '/books/' || vec_id || '/title' when vec_id % 5 = 1 then '/books/_meta/' || vec_id else '/books/content/p' || (vec_id % 7) end"


@query(f"with s as (select {_KEY} as key, text, {_SIM} as score from {_E} join documents on vec_id = doc_id), h as (select key, score * case when vec5 = 0 then 1.5 when vec5 = 1 then 1.3 else 1.0 end * least(1.5, 1 + 0.1 * ({head_has('text', 'the')} + {head_has('text', 'and')})) * case when para < 3 then 1.1 else 1.0 end as score, id from (select s.*, case when key like '%/title' then 0 when contains(key, '/_meta/') then 1 else 2 end as vec5, coalesce(try_cast(nullif(regexp_extract(key, '/content/p([0-9]+)', 1), '') as int), 999) as para, key as id from s)) select key, round(score, 6) as score from h order by h.score desc, key limit 10")
def vec_hybrid(spark, d):
    v = F.col("vec_id")
    key = F.when(v % 5 == 0, F.concat(F.lit("/books/"), v, F.lit("/title"))).when(v % 5 == 1, F.concat(F.lit("/books/_meta/"), v)).otherwise(F.concat(F.lit("/books/content/p"), v % 7))
    rows = _vectors(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("value")), "vec_id").select(key.alias("key"), "value", "embedding")
    return R.hybrid_top_k(rows, QUERY, "the and", 10).select("key", rounded("score").alias("score"))


@query(f"""
with h as (select case when vec_id % 11 = 0 then '__anon' || vec_id else 'find_page_' || vec_id end as name, {_SIM} as score, vec_id from {_E}),
m as (select *, case when vec_id % 4 = 0 then 'src/test/a.c' else 'src/b.c' end as file, case when vec_id % 2 = 0 then 'function' else 'struct' end as kind, 'c' as language, vec_id % 9 as callers from h where not starts_with(name, '__anon')),
s as (select name, file, kind, language, least(1.0, least(1.0, tanh((score - 0.5) * 2 * 1.5) * 0.5 + 0.5 + least(0.3, 0.01 + 2.5 / 9.0 * 0.07 + 0.01 + 1.0 / 9.0 * 0.07)) + case when callers > 0 then least(0.1, ln(callers + 1.0) * 0.02) else 0 end) * case when contains(file, '/test') then 0.85 else 1.0 end as score from m)
select name, file, kind, language, round(score, 6) as score from s where lower(kind) = 'function'""")
def vec_engine_rescore(spark, d):
    v = F.col("vec_id")
    hits = _vectors(spark, d).select(F.when(v % 11 == 0, F.concat(F.lit("__anon"), v)).otherwise(F.concat(F.lit("find_page_"), v)).alias("name"), R.similarity(F.col("embedding"), QUERY).alias("score"), "vec_id")
    meta = hits.select("name", F.when(v % 4 == 0, "src/test/a.c").otherwise("src/b.c").alias("file"), F.when(v % 2 == 0, "function").otherwise("struct").alias("kind"), F.lit("c").alias("language"))
    idf = spark.createDataFrame([("find", 2.5)], "word string, idf double")
    callers = hits.select("name", (v % 9).alias("callers"))
    return R.engine_scores(hits.select("name", "score"), meta, "find page x", idf, callers, R.EngineOptions(kind="FUNCTION")).withColumn("score", rounded("score"))


@query("select vec_id, round(least(0.3, case when contains('name_' || vec_id, 'name') then 0.01 + 1 / 9.0 * 0.07 else 0 end + case when contains('name_' || vec_id, '12') and false then 0 else 0 end), 6) as boost from embeddings")
def keyword_boost(spark, d):
    names = _vectors(spark, d).select("vec_id", F.concat(F.lit("name_"), "vec_id").alias("name"))
    return R.keyword_boost(names, "NAME of 12").select("vec_id", rounded("keyword_boost").alias("boost"))


@query("select vec_id, round(case when vec_id % 40 > 0 then least(0.1, ln(vec_id % 40 + 1.0) * 0.02) else 0 end, 6) as boost from embeddings")
def caller_boost(spark, d):
    return _vectors(spark, d).select("vec_id", rounded(R.caller_boost(F.col("vec_id") % 40)).alias("boost"))


@query(f"with s as (select 'ns' || label as namespace, vec_id as name, {_SIM} as score from {_E}), r as (select *, row_number() over (partition by namespace order by score desc, name) as rank from s where namespace in ('ns0', 'ns1')) select namespace, name, round(score, 6) as score, rank::int as rank from r where rank <= 3")
def compare_namespaces(spark, d):
    hits = _vectors(spark, d).select(F.concat(F.lit("ns"), "label").alias("namespace"), F.col("vec_id").alias("name"), R.similarity(F.col("embedding"), QUERY).alias("score"))
    return R.compare(hits, ["ns0", "ns1"]).withColumn("score", rounded("score"))


@query(f"with s as (select 'ns' || label as source, vec_id, {_SIM} as score from {_E}), r as (select *, row_number() over (partition by source order by score desc, vec_id) as n from s where source in ('ns0', 'ns1')) select vec_id, source, round(score, 6) as score from r where n <= 6 order by r.score desc, source, vec_id limit 6")
def merged_topk(spark, d):
    hits = _vectors(spark, d).select("vec_id", "label", R.similarity(F.col("embedding"), QUERY).alias("score"))
    return ranking.merged_top({f"ns{i}": hits.where(F.col("label") == i).select("vec_id", "score") for i in (0, 1)}, 6, "vec_id").withColumn("score", rounded("score"))


@query("select project, name, max(score) as score from (select lang as project, source as name, n_chars as score from documents) group by 1, 2 order by score desc, project, name limit 10")
def cross_project_topk(spark, d):
    return ranking.cross_project(table(spark, d, "documents").select(F.col("lang").alias("project"), F.col("source").alias("name"), F.col("n_chars").alias("score")), 10)


@query(f"select vec_id, round({_SIM}, 6) as score, max({_SIM}) over () < 0.3 as low_confidence from {_E}")
def low_confidence(spark, d):
    hits = _vectors(spark, d).select("vec_id", R.similarity(F.col("embedding"), QUERY).alias("score"))
    return R.with_confidence(hits).withColumn("score", rounded("score"))


@query("select vec_id, vec_id % 3 <> 2 as matches from embeddings")
def source_match(spark, d):
    v = F.col("vec_id")
    source = F.when(v % 3 == 0, F.lit("/code/local/app")).when(v % 3 == 1, F.lit("/code/app/vectors")).otherwise(F.lit("/books/x"))
    return _vectors(spark, d).select("vec_id", R.source_matches(source, "/code/app").alias("matches"))


@query("select doc_id, cast(floor((row_number() over (order by strlen(text), doc_id) - 1) / 64) as bigint) as batch from documents")
def length_batches(spark, d):
    return ranking.length_batches(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id", 64).select("doc_id", "batch")


@query("select name, count(distinct src) as fan_in from (select l_partkey as name, l_suppkey as src from lineitem) group by 1 order by fan_in desc, name limit 20")
def fan_in(spark, d):
    return G.top_fan_in(calls(spark, d))


@query("select name, count(distinct dst) as fan_out from (select l_suppkey as name, l_partkey as dst from lineitem) group by 1 order by fan_out desc, name limit 20")
def fan_out(spark, d):
    return G.top_fan_out(calls(spark, d))


@query("select key, dim from (select '/v/' || vec_id as key, len(embedding) as dim from embeddings where vec_id % 2 = 0)")
def vector_entries(spark, d):
    vectors = _vectors(spark, d).select(F.concat(F.lit("/v/"), "vec_id").alias("key"), "embedding", "vec_id")
    kv = keyed.entries(vectors.where("vec_id % 2 = 0"), F.col("key"), F.lit("text"), F.col("vec_id"))
    return R.vector_entries(kv, vectors).select("key", F.col("dim").cast("long").alias("dim"))


_ENGINE = "least(1.0, tanh((score - 0.5) * 2 * 1.5) * 0.5 + 0.5 + least(0.3, 0.01 + 1 / 9.0 * 0.07))"
_SCORED = f"(select vec_id, label, 'find_page_' || (vec_id % 50) as name, case when vec_id % 4 = 0 then 'src/test/a.c' else 'src/b.c' end as file, {_SIM} as score from {_E})"


@query(f"""
with h as (select *, row_number() over (partition by label order by score desc, name) as n from {_SCORED} where label in (0, 1)),
s as (select 'p' || label as project, name, {_ENGINE} * case when contains(file, '/test') then 0.85 else 1.0 end as score from h where n <= 40),
b as (select project, name, max(score) as score from s group by 1, 2)
select project, name, round(score, 6) as score from b order by b.score desc, project, name limit 10""")
def cross_project_engine(spark, d):
    """The engine's scores over two projects, merged; a name's hits each have their own file."""
    v = F.col("vec_id")
    rows = _vectors(spark, d).where("size(embedding) = 64").select("label", F.concat(F.lit("find_page_"), v % 50).alias("name"), F.when(v % 4 == 0, "src/test/a.c").otherwise("src/b.c").alias("file"), R.similarity(F.col("embedding"), QUERY).alias("score"))
    sources = {}
    for label in (0, 1):
        own = rows.where(F.col("label") == label)
        sources[f"p{label}"] = own.select("name", "score", "file")
    out = R.cross_engine({p: (h, None) for p, h in sources.items()}, "find", 10)
    return out.withColumn("score", rounded("score"))


@query("""
with h as (select 'part_fn_' || p_partkey as name, p_size / 100.0::double as score, 'helper_' || (p_size % 5) as helper from part),
e as (select name, round(least(1.0, tanh((score - 0.5) * 2 * 1.5) * 0.5 + 0.5 + least(0.3, 0.01 + 1 / 9.0 * 0.07)), 6) as score, helper from h),
b as (select * from e order by score desc, name limit 5),
f as (select * from b order by score desc, name limit 1)
select 'hit' as part, name, 0 as depth, score from b union all select 'callees', helper, 1, null from f""")
def explore(spark, d):
    """The five best hits of a search, and what the first of them calls and is called by within two calls."""
    bodies = _bodies(spark, d)
    hits = bodies.select("name", (F.col("p_size") / 100.0).alias("score"))
    meta = bodies.select("name", F.lit("src/b.c").alias("file"), "kind", "language")
    known = bodies.select("name").union(spark.range(5).select(F.concat(F.lit("helper_"), "id")))
    return R.explore(hits, meta, C.call_sites(bodies, known), "part").withColumn("score", rounded("score"))


@query("""
with j as (select '/vec/chunks/' || doc_id as key, 'f' || doc_id || ' (' || lang || ') ' || source || ' ' || array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: ltrim(x, ' ')), lambda x: x <> '')[1:10], ' ') as text from documents where doc_id % 2 = 0 and doc_id % 10 <> 4)
select key, text, cast(floor((row_number() over (order by strlen(text), key) - 1) / 32) as bigint) as batch from j""")
def vector_job(spark, d):
    """What is embedded of the chunks of a repository: whole chunks as JSON values, one in ten in a test path."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    file = F.when(k % 10 == 4, "src/test/a.c").otherwise("src/b.c")
    value = F.to_json(F.struct(F.concat(F.lit("f"), k).alias("name"), file.alias("file"), F.col("lang").alias("language"), F.col("source").alias("signature"), F.lit("").alias("docstring"), F.col("text").alias("content")))
    kv = keyed.entries(docs, F.concat(F.when(k % 2 == 0, "/vec/chunks/").otherwise("/other/"), k), value, k)
    return R.vector_job(kv, "/vec", 0).select("key", "text", "batch")


@query("select '/vec/chunks/' || doc_id as key, 64::bigint as dim, true as same from documents")
def text_embeddings(spark, d):
    """The stand-in model over whole texts in batches: one vector a text, the same at every run."""
    job = table(spark, d, "documents").select(F.concat(F.lit("/vec/chunks/"), "doc_id").alias("key"), F.lit("n").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    one, two = R.embedded(job), R.embedded(job.repartition(3, "key")).withColumnRenamed("embedding", "again")
    return one.join(two, "key").select("key", F.size("embedding").cast("long").alias("dim"), (F.col("embedding") == F.col("again")).alias("same"))


@query(f"""
with h as (select 'page_' || vec_id as name, {_SIM} as score, vec_id from {_E}),
m as (select *, case when vec_id % 3 = 0 then 'src/core/a.c' else 'lib/b.c' end as file, case when vec_id % 2 = 0 then 'c' else 'go' end as language from h)
select name, file, language, round(tanh((score - 0.5) * 2 * 1.5) * 0.5 + 0.5, 6) as score from m where language = 'c' and contains(file, 'core')""")
def vec_engine_facets(spark, d):
    """Filters by language and file; of two records of a name the one further down counts."""
    v = F.col("vec_id")
    hits = _vectors(spark, d).where("size(embedding) = 64").select(F.concat(F.lit("page_"), v).alias("name"), R.similarity(F.col("embedding"), QUERY).alias("score"), "vec_id")
    meta = hits.select("name", F.when(v % 3 == 0, "src/core/a.c").otherwise("lib/b.c").alias("file"), F.lit("function").alias("kind"), F.when(v % 2 == 0, "C").otherwise("go").alias("language"), F.lit(20).alias("line_no"))
    meta = meta.unionByName(hits.select("name", F.lit("old.c").alias("file"), F.lit("function").alias("kind"), F.lit("c").alias("language"), F.lit(10).alias("line_no")))
    out = R.engine_scores(hits.select("name", "score"), meta, "", options=R.EngineOptions(language="c", file="core"))
    return out.select("name", "file", F.lower("language").alias("language"), rounded("score").alias("score"))

"""Further queries: streams, syntax records, books, exploration, cleaning."""

import uuid

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import aggregates as A
from quillstone.operators import books as B
from quillstone.operators import code as C
from quillstone.operators import keyed, ranking
from quillstone.plans.analysis import _bodies
from quillstone.plans.registry import NOW, preview_of, query, rounded, table
from quillstone.sources.staging import shared_root
from quillstone.streaming import streams


@query("select date_trunc('hour', ts) as start, event_type, count(*) as calls, round(sum(value), 4) as total, max(value) as largest from events group by 1, 2")
def stream_windows(spark, d):
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.run_to_end(streams.windowed(events), f"{shared_root(spark)}/stream-{uuid.uuid4().hex}")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "calls", rounded("total", 4).alias("total"), "largest")


@query("select 'src/' || (p_partkey % 10) || case when p_partkey % 10 = 0 then '.h' else '.c' end as file, string_agg('func:part_fn_' || p_partkey, ' ' order by 'func:part_fn_' || p_partkey) as tags from part group by 1")
def syntax_tags(spark, d):
    return C.syntax_tags(C.syntax_records(_bodies(spark, d).select("file", "language", "content")))


@query("select 'src/' || (p_partkey % 10) || case when p_partkey % 10 = 0 then '.h' else '.c' end as file, count(*) as nodes from part group by 1")
def syntax_json(spark, d):
    records = C.syntax_json(C.syntax_records(_bodies(spark, d).select("file", "language", "content")))
    return records.select("file", F.size(F.from_json(F.get_json_object("ast", "$.nodes"), "array<struct<type:string,name:string>>")).cast("long").alias("nodes"))


@query("select 'fn' || event_id as src, 'helper' || (event_id % 4) as dst from events where event_id % 3 <> 0 and event_id % 4 < 3")
def plugin_edges(spark, d):
    e = F.col("event_id")
    records = table(spark, d, "events").select(F.concat(F.lit("fn"), e).alias("caller"), F.when(e % 3 == 0, "map").otherwise(F.concat(F.lit("helper"), e % 4)).alias("callee"))
    known = spark.createDataFrame([("helper0",), ("helper1",), ("helper2",), ("map",)], "name string")
    return C.accepted_edges(records, known).select("src", "dst")


@query("select lang as book, count(distinct source) as chapters, count(*) as pages, cast(sum(strlen(text)) as bigint) as bytes from documents group by 1")
def book_overview(spark, d):
    return B.overview(table(spark, d, "documents").select(F.col("lang").alias("book"), F.col("source").alias("chapter"), F.col("doc_id").alias("page"), "text"))


@query("select '/books/' || lang || '/chapters/' || source || '/page_' || lpad(doc_id::varchar, greatest(4, length(doc_id::varchar))::int, '0') as key, strlen(text) as content_len, " + preview_of("text") + " as preview from documents")
def page_records(spark, d):
    pages = table(spark, d, "documents").select(F.col("lang").alias("book"), F.col("source").alias("chapter"), F.col("doc_id").alias("page"), "text")
    rows = B.page_rows(pages)
    return rows.select("key", F.get_json_object("value", "$.content_len").cast("long").alias("content_len"), F.get_json_object("value", "$.preview").alias("preview"))


@query("select event_type || case when user_id % 2 = 0 then '{even=1}' else '' end || ' ' || count(*) as line from events group by event_type, user_id % 2")
def metrics_text(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("name"), F.when(F.col("user_id") % 2 == 0, "even=1").otherwise("").alias("labels"), F.lit(1).alias("value"))
    return A.metrics_text(A.metrics(rows))


@query("select doc_id, regexp_replace(text || chr(1) || chr(127), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') as text from documents")
def clean_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.concat("text", F.lit("\x01\x7f"))).alias("text"))


@query("select event_id, replace(props, '\"', '\\\"') || '\\n' as escaped from events")
def json_escape(spark, d):
    return table(spark, d, "events").select("event_id", X.json_escaped(F.concat("props", F.lit("\n"))).alias("escaped"))


@query("select d.lang as namespace, d.doc_id as name, n_chars as score, row_number as rank from (select *, row_number() over (partition by lang order by n_chars desc, doc_id)::int as row_number from documents) d where row_number <= 3")
def top_per_namespace(spark, d):
    hits = table(spark, d, "documents").select(F.col("lang").alias("namespace"), F.col("doc_id").alias("name"), F.col("n_chars").alias("score"))
    return ranking.top_per(hits, 3, "namespace", "score", "name")


@query("select key, max(position) as position from (select '/' || lang || '/' || doc_id as key, doc_id as position from documents union all select '/' || lang || '/' || doc_id, doc_id + 1 from documents where doc_id % 2 = 0) group by 1")
def batch_set(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id")
    key = F.concat_ws("/", F.lit(""), "lang", "doc_id")
    old = keyed.entries(docs, key, F.col("doc_id").cast("string"), F.lit(0), version=F.col("doc_id"))
    new = keyed.entries(docs.where("doc_id % 2 = 0"), key, (F.col("doc_id") + 1).cast("string"), F.lit(1), version=F.col("doc_id") + 1)
    return keyed.live(keyed.upsert(old, new), NOW).select("key", F.col("value").cast("long").alias("position"))

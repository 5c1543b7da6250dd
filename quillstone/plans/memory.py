"""Queries of the keyed layer and its searches."""

import uuid

from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import keyed as K
from quillstone.operators import search as S
from quillstone.plans.registry import KV_DOCUMENTS, KV_EVENTS, NOW, kv_documents, kv_events, query, rounded, table
from quillstone.sources.staging import shared_root

_LIVE = f"not deleted and (expire_at = 0 or expire_at >= {NOW})"
_BYTES = "cast(ceil((strlen(key) + strlen(value) + 30) / 8.0) * 8 as bigint)"


@query("select key, value, version from (select '/' || event_type || '/' || user_id as key, props as value, event_id as version, row_number() over (partition by event_type, user_id order by event_id desc) as n from events) where n = 1")
def upsert_latest(spark, d):
    events = table(spark, d, "events")
    rows = K.entries(events, F.concat_ws("/", F.lit(""), "event_type", "user_id"), F.col("props"), F.col("event_id"))
    return K.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1")).select("key", "value", "version")


@query(f"select key, value from {KV_DOCUMENTS} where key = '/en/src1/1' or key = '/de/src1/1'")
def kv_get(spark, d):
    kv = kv_documents(spark, d)
    return K.get(kv, "/en/src1/1", NOW).union(K.get(kv, "/de/src1/1", NOW))


@query(f"select count(*) > 0 as found from {KV_DOCUMENTS} where key = '/en/src1/1'")
def kv_exists(spark, d):
    return K.exists(kv_documents(spark, d), "/en/src1/1", NOW)


@query(f"select key, 1.0::double as score from {KV_DOCUMENTS} where starts_with(key, '/en/src1')")
def kv_prefix(spark, d):
    return S.prefix(kv_documents(spark, d), "/en/src1", NOW, S.Options(0)).select("key", "score")


@query(f"select key, 1.0::double as score from {KV_DOCUMENTS} where key >= '/en/src1/' and key < '/en/src10' order by key limit 100")
def kv_range(spark, d):
    return S.between(kv_documents(spark, d), "/en/src1/", "/en/src10", NOW).select("key", "score")


@query(f"select key, 1.0::double as score from {KV_DOCUMENTS} where regexp_matches(key, '(?i)/EN/.*7$')")
def kv_regex(spark, d):
    return S.pattern(kv_documents(spark, d), "/EN/.*7$", NOW, S.Options(0)).select("key", "score")


@query("select key, round(1 - levenshtein(key, 'small ring#12') / greatest(length(key), 13), 6) as score from (select p_name || '#' || p_partkey as key from part) where 1 - levenshtein(key, 'small ring#12') / greatest(length(key), 13) > 0.5")
def kv_fuzzy(spark, d):
    part = table(spark, d, "part")
    kv = K.entries(part, F.concat("p_name", F.lit("#"), "p_partkey"), F.col("p_brand"), F.col("p_partkey"))
    return S.fuzzy(kv, "small ring#12", NOW, S.Options(0)).select("key", rounded("score").alias("score"))


@query(r"select key, 1.0::double as score from " + KV_DOCUMENTS + r" where list_contains(regexp_extract_all(value, '[A-Za-z0-9_]+|[^\x00-\x7F](?:[A-Za-z0-9_]|[^\x00-\x7F])*'), 'token')")
def kv_tag(spark, d):
    return S.tag(kv_documents(spark, d), "token", NOW, S.Options(0)).select("key", "score")


@query(f"select key, 1.0::double as score from {KV_DOCUMENTS} where regexp_matches(value, '(^|[^A-Za-z0-9])CC BY-NC([^A-Za-z0-9]|$)')")
def kv_tag_fallback(spark, d):
    return S.tag(kv_documents(spark, d), "CC BY-NC", NOW, S.Options(0)).select("key", "score")


@query("select '/ast/' || page_id as key, 1.0::double as score from pages where page_id % 3 = 0 and contains(url, 'en')")
def kv_structure(spark, d):
    pages = table(spark, d, "pages")
    record = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"type":"page","name":"'), "url", F.lit('"}'))).otherwise(F.col("url"))
    return S.structure(K.entries(pages, F.concat(F.lit("/ast/"), "page_id"), record, F.col("page_id")), "en", NOW, S.Options(0)).select("key", "score")


@query(f"select key from {KV_DOCUMENTS} where key = '/en/src1' or starts_with(key, '/en/src1/')")
def kv_ns_filter(spark, d):
    return S.prefix(kv_documents(spark, d), "/en", NOW, S.Options(0, namespace="/en/src1")).select("key")


@query(f"select key, row_number() over (order by key) as position from {KV_EVENTS} where {_LIVE}")
def kv_iter(spark, d):
    return K.compacted(kv_events(spark, d), NOW).select("key", "position")


@query(f"select key from {KV_EVENTS} where {_LIVE} and starts_with(key, '/events/click/')")
def kv_iter_namespace(spark, d):
    return K.iterate(kv_events(spark, d), NOW, "/events/click").select("key")


@query(f"select key, value from {KV_EVENTS} where {_LIVE}")
def ttl_live(spark, d):
    return K.live(kv_events(spark, d), NOW).select("key", "value")


@query(f"select key from {KV_EVENTS} where not (expire_at > 0 and expire_at < {NOW})")
def purge_expired(spark, d):
    return K.purge_expired(kv_events(spark, d), NOW).select("key")


@query(f"select case when deleted then 'deleted' when expire_at > 0 and expire_at < {NOW} then 'expired' else 'valid' end as status, count(*) as entries from {KV_EVENTS} group by 1")
def status_hist(spark, d):
    return K.status_counts(kv_events(spark, d), NOW)


@query(f"select cast(sum({_BYTES}) as bigint) as memory_used from {KV_DOCUMENTS}")
def memory_used(spark, d):
    return K.memory_used(kv_documents(spark, d))


@query(f"select count(*) as entries, cast(sum({_BYTES}) as bigint) as memory_used from {KV_EVENTS} where {_LIVE}")
def kv_stats(spark, d):
    return K.stats(kv_events(spark, d), NOW)


@query(f"with k as (select *, {_BYTES} as b from {KV_EVENTS}), f as (select coalesce(sum(b), 0) as fixed from k where permanent), r as (select key, sum(b) over (order by access_time desc, key rows unbounded preceding) as run from k where not permanent) select key from k where permanent union all select key from r, f where run + fixed <= 400000")
def lru_survivors(spark, d):
    return K.retained(kv_events(spark, d), 400_000).select("key")


@query(f"select regexp_extract(key, '^(.*)/[^/]*$', 1) as namespace, count(*) as entries from {KV_DOCUMENTS} group by 1")
def ns_tree_counts(spark, d):
    return K.namespace_counts(kv_documents(spark, d))


@query("select distinct event_type as namespace from events")
def ns_distinct(spark, d):
    events = table(spark, d, "events")
    return K.namespaces(K.entries(events, F.concat_ws(":", "event_type", "user_id", "event_id"), F.col("props"), F.col("event_id")))


@query("select count(*) as entries from events where event_type = 'click'")
def ns_members(spark, d):
    events = table(spark, d, "events")
    kv = K.entries(events, F.concat_ws(":", "event_type", "user_id", "event_id"), F.col("props"), F.col("event_id"))
    return kv.where(X.has_prefix(F.col("key"), "click:")).agg(F.count("*").alias("entries"))


@query(f"select key from {KV_DOCUMENTS} where not starts_with(key, '/en/src1/')")
def delete_namespace(spark, d):
    return K.delete_namespace(kv_documents(spark, d), "/en/src1").select("key")


@query(f"select key from {KV_EVENTS} where version % 4 <> 1")
def kv_delete(spark, d):
    kv = kv_events(spark, d)
    return K.remove(kv, kv.where("version % 4 = 1")).select("key")


@query(f"select key, case when key = '/events/click/1/1' then {NOW} else access_time end as access_time from {KV_EVENTS}")
def kv_touch(spark, d):
    return K.touch(kv_events(spark, d), "/events/click/1/1", NOW).select("key", "access_time")


@query(f"select key from {KV_EVENTS} where {_LIVE} and version <> 4004")
def kv_expire(spark, d):
    kv = kv_events(spark, d)
    key = kv.where("version = 4004").select("key").first()
    return K.live(K.expire(kv, key[0] if key else "", NOW), NOW).select("key")


@query(f"select key, 1.0::double as score from {KV_DOCUMENTS} where starts_with(key, '/fr/') order by key limit 100")
def serve_search(spark, d):
    return S.serve(kv_documents(spark, d), {"q": "/fr/", "max_results": "0"}, NOW).select("key", "score")


@query(r"select tag, count(*) as entries from (select distinct key, unnest(regexp_extract_all(value, '[A-Za-z0-9_]+|[^\x00-\x7F](?:[A-Za-z0-9_]|[^\x00-\x7F])*')) as tag from " + KV_DOCUMENTS + ") where strlen(tag) >= 2 group by 1")
def tag_index(spark, d):
    return S.tag_index(kv_documents(spark, d))


@query(r"select tag, key from (select distinct key, unnest(regexp_extract_all(value, '[A-Za-z0-9_]+|[^\x00-\x7F](?:[A-Za-z0-9_]|[^\x00-\x7F])*')) as tag from " + KV_DOCUMENTS + ") where strlen(tag) >= 2")
def tag_postings(spark, d):
    """The inverted index itself: the keys of every tag."""
    return S.tag_postings(kv_documents(spark, d))


@query(r"select key from " + KV_DOCUMENTS + r" where list_contains(regexp_extract_all(value, '[A-Za-z0-9_]+|[^\x00-\x7F](?:[A-Za-z0-9_]|[^\x00-\x7F])*'), 'token')")
def tag_lookup(spark, d):
    """One tag by the stored index."""
    kv, path = kv_documents(spark, d), f"{shared_root(spark)}/tags-{uuid.uuid4().hex}"
    S.write_tag_index(kv, path)
    return S.tagged(kv, spark.read.parquet(path), "token", NOW).select("key")


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", X.json_field(F.col("props"), "k").cast("int").alias("k"))

"""Queries of the table layer."""

from pyspark.sql import functions as F

from quillstone.operators import ranking
from quillstone.operators import table as T
from quillstone.plans.registry import query, rounded, table


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem where l_quantity > 45 order by l_extendedprice desc, l_orderkey, l_linenumber limit 10 offset 5")
def scan_filter_topn(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return T.select(rows, T.where_clause(l_quantity__gt=45), "l_extendedprice", False, 10, 5, ("l_orderkey", "l_linenumber"))


@query("select * from customer")
def full_scan(spark, d):
    return T.scan(T.managed(table(spark, d, "customer"), "c_custkey"))


@query("select count(*) as n from orders")
def row_count(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders where o_orderkey = 42")
def pk_lookup(spark, d):
    return table(spark, d, "orders").where(T.where_clause(o_orderkey=42)).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_totalprice < 200000 and o_orderstatus = 'F'")
def range_filter(spark, d):
    return table(spark, d, "orders").where(T.where_clause(o_totalprice__gt=100000, o_totalprice__lt=200000, o_orderstatus="F")).select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal < -500")
def negative_double_filter(spark, d):
    return table(spark, d, "customer").where(T.where_clause(c_acctbal__lt=-500.0)).select("c_custkey", "c_name", "c_acctbal")


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def string_eq(spark, d):
    return table(spark, d, "customer").where(T.where_list([{"field": "c_mktsegment", "value": "BUILDING", "op": "="}])).select("c_custkey", "c_name")


@query("select p_partkey, p_name from part where p_name > 'm' and p_size < 10")
def string_compare(spark, d):
    return table(spark, d, "part").where(T.where_list([{"field": "p_name", "value": "m", "op": ">"}, {"field": "p_size", "value": 10, "op": "<"}])).select("p_partkey", "p_name")


@query("select c_custkey as customer_c_custkey, c_name as customer_c_name, o_orderkey as orders_o_orderkey, o_totalprice as orders_o_totalprice from customer join orders on c_custkey = o_custkey")
def join_inner(spark, d):
    customer, orders = table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return T.equi_join(customer, "customer", "c_custkey", orders, "orders", "o_custkey").drop("orders_o_custkey")


@query("select n_name as nation_n_name, c_name as customer_c_name, o_orderkey as orders_o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 400000")
def join_three_way(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    out = T.chain_join(orders, "orders", ("orders_o_custkey", table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "customer", "c_custkey"), ("customer_c_nationkey", table(spark, d, "nation").select("n_nationkey", "n_name"), "nation", "n_nationkey"))
    return out.select("nation_n_name", "customer_c_name", "orders_o_orderkey")


@query("select s_name as supplier_s_name, p_name as part_p_name, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey where l_quantity = 50 group by 1, 2")
def join_string_keys(spark, d):
    items = table(spark, d, "lineitem").where("l_quantity = 50").select("l_suppkey", "l_partkey")
    out = T.chain_join(items, "l", ("l_l_suppkey", table(spark, d, "supplier").select("s_suppkey", "s_name"), "supplier", "s_suppkey"), ("l_l_partkey", table(spark, d, "part").select("p_partkey", "p_name"), "part", "p_partkey"))
    return out.groupBy("supplier_s_name", "part_p_name").agg(F.count("*").alias("n"))


@query("select count(*) <= 1000 as within from orders")
def max_rows_guard(spark, d):
    return T.within(table(spark, d, "orders"), 1000)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 20 offset 100")
def order_limit_offset(spark, d):
    return T.select(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), None, "o_totalprice", True, 20, 100, ("o_orderkey",))


@query("select o_orderkey, o_totalprice from orders order by o_orderkey offset 1000000000")
def offset_past_end(spark, d):
    return T.select(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), None, "o_orderkey", True, 0, 1_000_000_000)


@query("select row_number() over (order by c_custkey) as _rowid, c_custkey, c_name from customer")
def insert_rows(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    half = rows.agg(F.max("c_custkey")).first()[0] // 2
    first = T.managed(rows.where(F.col("c_custkey") <= half), "c_custkey")
    return T.insert(first, rows.where(F.col("c_custkey") > half), "c_custkey").select("_rowid", "c_custkey", "c_name")


@query("select row_number() over (order by o_orderkey) as _rowid, o_orderkey, case when o_orderkey % 7 = 0 then o_totalprice * 2 else o_totalprice end as o_totalprice from orders")
def update_by_id(spark, d):
    rows = T.managed(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    changed = rows.where("o_orderkey % 7 = 0").select("_rowid", "o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return T.update(rows, changed).select("_rowid", "o_orderkey", "o_totalprice")


@query("select count(*) filter (o_orderkey % 3 <> 0) as live, count(*) filter (o_orderkey % 3 = 0) as deleted from orders")
def soft_delete(spark, d):
    rows = T.delete(T.managed(table(spark, d, "orders").select("o_orderkey"), "o_orderkey"), F.col("o_orderkey") % 3 == 0)
    return rows.agg(F.count_if(~F.col("_deleted")).alias("live"), F.count_if("_deleted").alias("deleted"))


@query("select row_number() over (order by o_orderkey) as _rowid, o_orderkey, o_totalprice from orders where o_orderkey % 3 <> 0")
def soft_delete_compact(spark, d):
    rows = T.managed(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return T.compact(T.delete(rows, F.col("o_orderkey") % 3 == 0)).select("_rowid", "o_orderkey", "o_totalprice")


@query("select round(count(*) filter (o_orderkey % 3 = 0) / count(*), 6) as deleted_ratio from orders")
def deleted_ratio(spark, d):
    rows = T.delete(T.managed(table(spark, d, "orders").select("o_orderkey"), "o_orderkey"), F.col("o_orderkey") % 3 == 0)
    return T.deleted_ratio(rows).select(rounded("deleted_ratio").alias("deleted_ratio"))


@query("select user_id, event_type, event_id as lsn, value from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as n from events) where n = 1 and event_id % 3 + 1 <> 3")
def replay_log(spark, d):
    log = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("lsn"), (F.col("event_id") % 3 + 1).alias("op"), "value")
    return T.replay(log, "user_id", "event_type").select("user_id", "event_type", "lsn", "value")


@query("select count(*) as n from events where event_id % 5 <> 0")
def valid_log(spark, d):
    log = table(spark, d, "events").select("event_id", F.col("props").alias("body"), (F.crc32(F.col("props").cast("binary")) + (F.col("event_id") % 5 == 0).cast("int")).alias("crc"))
    return T.valid_log(log).agg(F.count("*").alias("n"))


@query("select count(*) as rows, count(*) as max_rowid, count(*) filter (o_orderkey % 3 = 0) as deleted, true as sound from orders")
def integrity_check(spark, d):
    rows = T.delete(T.managed(table(spark, d, "orders").select("o_orderkey"), "o_orderkey"), F.col("o_orderkey") % 3 == 0)
    return T.check(rows)


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as n from orders")
def row_numbers(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumn("_neg", -F.col("o_totalprice"))
    return ranking.numbered(rows, "_neg", "o_orderkey").drop("_neg")


@query("select c_custkey, left(c_name, 7) as name from customer")
def fixed_string(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.fixed_string(F.col("c_name"), 8).alias("name"))


@query("select n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as json from nation")
def json_rows(spark, d):
    from quillstone.sources.files import json_rows as rows

    nation = table(spark, d, "nation")
    return rows(nation.select("n_nationkey", "n_name")).select(F.get_json_object("json", "$.n_nationkey").cast("int").alias("n_nationkey"), "json")


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem where l_partkey = 10 and l_suppkey < 100")
def composite_filter(spark, d):
    return table(spark, d, "lineitem").where(T.where_clause(l_partkey=10, l_suppkey__lt=100)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")

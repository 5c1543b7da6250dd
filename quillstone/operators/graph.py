"""Call graphs: fan-in and fan-out, sites, paths and flow over edge tables (src calls dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.ranking import first_per, top
from quillstone.sources.staging import staged

#: Levels and paths that an expansion goes at most, and sites of one name that an array holds.
MAX_DEPTH, MAX_PATHS, MAX_SITES = 5, 50, 1000


def fan_in(edges: DataFrame) -> DataFrame:
    """name, fan_in: distinct callers."""
    return edges.groupBy(F.col("dst").alias("name")).agg(F.count_distinct("src").alias("fan_in"))


def fan_out(edges: DataFrame) -> DataFrame:
    """name, fan_out: distinct callees."""
    return edges.groupBy(F.col("src").alias("name")).agg(F.count_distinct("dst").alias("fan_out"))


def top_fan_in(edges: DataFrame, n: int = 20) -> DataFrame:
    return top(fan_in(edges), n, "fan_in", "name")


def top_fan_out(edges: DataFrame, n: int = 20) -> DataFrame:
    return top(fan_out(edges), n, "fan_out", "name")


def _grouped(sites: DataFrame, name: str, function: str, most: int) -> DataFrame:
    counts = sites.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("count"))
    first = first_per(sites.select(F.col(name).alias("name"), F.col(function).alias("function"), "file", "line"), most, "name", "function", "file", "line")
    lists = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("function", "file", "line"))).alias("sites"))
    return counts.join(lists, "name")


def callers(sites: DataFrame, most: int = MAX_SITES) -> DataFrame:
    """name, count, sites: how many call sites (src, dst, file, line) a callee has, and the first `most` of them by
    function, file and line; all of them are the rows of `sites`."""
    return _grouped(sites, "dst", "src", most)


def callees(sites: DataFrame, most: int = MAX_SITES) -> DataFrame:
    """name, count, sites: the same of each caller."""
    return _grouped(sites, "src", "dst", most)


def neighbourhood(sites: DataFrame, name: str | Column, depth: int = 2) -> DataFrame:
    """name, direction (callers or callees), depth: the functions within `depth` calls of one function."""
    start = sites.sparkSession.range(1).select(F.lit(name).cast(dict(sites.dtypes)["src"]).alias("name"))
    edges = sites.select("src", "dst").distinct()
    down = reach(edges, start, depth).withColumn("direction", F.lit("callees"))
    up = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, depth).withColumn("direction", F.lit("callers"))
    return up.unionByName(down).where("depth > 0").select("name", "direction", "depth")


def referenced(sites: DataFrame, n: int = 20) -> DataFrame:
    """name, references: how often names occur as caller or callee."""
    both = sites.select(F.explode(F.array("src", "dst")).alias("name"))
    return top(both.groupBy("name").agg(F.count("*").alias("references")), n, "references", "name")


def paths_up(edges: DataFrame, start, max_depth: int = MAX_DEPTH, max_paths: int = MAX_PATHS) -> DataFrame:
    """path: ways from `start` to its callers' callers.  A path ends at a function without callers, at
    max_depth calls, or at a node that it already has, which it then includes; the first max_paths by
    path.  max_depth joins of the frontier with the edges; no state on the driver.  A path's continuations
    stand together in the order of paths, so of each level only the first max_paths can matter; every level
    is staged, as the next one reads it twice."""
    pairs = edges.select("src", "dst").distinct()
    kind = dict(edges.dtypes)["src"]
    frontier = edges.sparkSession.range(1).select(F.array(F.lit(start).cast(kind)).alias("path"), F.lit(start).cast(kind).alias("at"), F.lit(False).alias("looped"))
    done = None
    for level in range(max_depth):
        step = frontier.where("not looped").join(pairs.withColumnRenamed("dst", "at"), "at", "left")
        closed = frontier.where("looped").select("path").unionByName(step.where("src is null").select("path"))
        done = closed if done is None else done.unionByName(closed)
        onward = step.where("src is not null")
        frontier = onward.select(F.array_append("path", F.col("src")).alias("path"), F.col("src").alias("at"), F.array_contains("path", F.col("src")).alias("looped"))
        frontier = frontier.orderBy("path").limit(max_paths)
        if level + 1 < max_depth:
            frontier = staged(frontier, "paths")
    return done.unionByName(frontier.select("path")).orderBy("path").limit(max_paths)


def reach(edges: DataFrame, start: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """name, depth: breadth-first from `start` (name) along the calls; every function at its least depth.  Each
    level is staged, as the next ones read it several times."""
    seen = start.select("name", F.lit(0).alias("depth")).distinct()
    frontier, pairs = seen, edges.select(F.col("src").alias("name"), "dst").distinct()
    for depth in range(1, max_depth + 1):
        step = frontier.join(pairs, "name").select(F.col("dst").alias("name")).distinct()
        frontier = staged(step.join(seen, "name", "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def flow(edges: DataFrame, variable: str, defined_in: DataFrame, occurrences: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """name, depth, uses: functions that a variable reaches from where it is defined, along calls whose
    arguments contain it (edges src, dst, args array<string>), and whether they use it themselves."""
    carrying = edges.where(F.exists("args", lambda a: a.rlike(rf"(^|[^A-Za-z0-9_]){variable}([^A-Za-z0-9_]|$)")))
    reached = reach(carrying, defined_in, max_depth)
    users = occurrences.where(F.col("variable") == variable).select(F.col("function").alias("name"), F.lit(True).alias("_u")).distinct()
    return reached.join(users, "name", "left").select("name", "depth", F.coalesce("_u", F.lit(False)).alias("uses"))


def resolve_callees(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """dst for calls (src, token): the caller's own scope (A::token), else the only X::token, else token.

    Calls of unknown functions and of the caller itself are dropped."""
    known = functions.select(F.col("name").alias("_known")).distinct()
    scoped = known.where(F.contains("_known", F.lit("::"))).select(F.col("_known").alias("_only"), F.element_at(F.split("_known", "::"), -1).alias("token"))
    unique = scoped.groupBy("token").agg(F.count("*").alias("_n"), F.first("_only").alias("_only")).where("_n = 1").drop("_n")
    own = F.concat(F.regexp_extract("src", r"^(.*)::[^:]*$", 1), F.lit("::"), F.col("token"))
    rows = calls.withColumn("_own", F.when(F.contains("src", F.lit("::")), own))
    rows = rows.join(known.select(F.col("_known").alias("_own"), F.lit(True).alias("_a")), "_own", "left").join(unique, "token", "left")
    rows = rows.join(known.select(F.col("_known").alias("token"), F.lit(True).alias("_b")), "token", "left")
    out = rows.withColumn("dst", F.coalesce(F.when(F.col("_a"), F.col("_own")), F.col("_only"), F.when(F.col("_b"), F.col("token"))))
    return out.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).drop("_own", "_a", "_b", "_only")

"""Connected components by repeated hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.storage import cut

#: Edges that one file of a round's tables stands for; fewer and larger files as the edges shrink.
FILE_EDGES, FEWEST_FILES = 200_000, 8


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns node, component (the smallest node reachable) for every node of `edges` (a, b: long).

    Each round hooks every node to its smallest neighbour, jumps pointers twice,
    maps the edges onto the new labels and drops those inside one label, so the
    edge table shrinks geometrically.  Every round cuts its pointers and edges to
    the shared folder; labels are the pointers of all rounds joined in turn.  The
    driver only sees how many edges are left.  No edges: no rows.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while left := edges.count():
        files = max(FEWEST_FILES, -(-left // FILE_EDGES))
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        parent = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).select(F.col("a").alias("n"), "p")
        for _ in range(2):
            up = parent.toDF("p", "q")
            parent = parent.join(up, "p", "left").select("n", F.coalesce("q", "p").alias("p"))
        parent = cut(parent.coalesce(files), "jump")
        if labels is None:
            labels = parent.toDF("node", "component")
        else:
            labels = labels.join(parent.toDF("component", "p"), "component", "left").select("node", F.coalesce("p", "component").alias("component"))
        edges = edges.join(parent.toDF("a", "pa"), "a").join(parent.toDF("b", "pb"), "b").where("pa <> pb")
        edges = cut(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct().coalesce(files), "edges")
    return labels if labels is not None else edges.toDF("node", "component")

"""Connected components of a graph whose edges are too many for one machine.

Alternating star steps: every vertex links its larger neighbours, then itself and its smaller ones, to the least vertex
that it sees. Each step is a grouping with partial aggregation and a join; the number of rounds grows with the logarithm
of the number of vertices. A vertex with very many edges meets its least neighbour in PARTS parts. Rounds end in files of
the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyhouse.llm.common import Store

#: Parts of a hub's edges. A hub has at least LEAST edges and a HUBS-th of all, so there are at most 2 * HUBS.
PARTS, LEAST, HUBS = 64, 2000, 200
#: Edges of a task that writes a step's result.
A_TASK = 50_000


def _met(edges: DataFrame, least: DataFrame, hubs: list[int]) -> DataFrame:
    """edges (a, b) with the m of least (a, m)."""
    if not hubs:
        return edges.join(least, "a")
    is_hub = F.col("a").isin(hubs)
    edges = edges.withColumn("part", F.when(is_hub, F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")).otherwise(0))
    parts = F.when(is_hub, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return edges.join(least.withColumn("part", F.explode(parts)), ["a", "part"])


def _large_star(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """Edges (a, b), a > b, repeats among them: each vertex links its larger neighbours to the least of itself and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _met(both, least, hubs).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """Edges (a, b), a > b: each vertex links itself and its smaller neighbours to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = _met(edges, least, hubs).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every vertex of (a bigint, b bigint): component_id is the least vertex that it reaches.

    Loops and edges with a null end are left out; repeated and reversed edges count once. No edges give no rows.
    """
    store = Store(edges.sparkSession, "components")
    now = store.put(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    while True:
        ends = now.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        degrees = ends.groupBy("a").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        # Done when every vertex is either linked once, to a lesser one, or is such a lesser one.
        open_, edges_, most = degrees.agg(F.count(F.when(F.expr("up > 1 or up = 1 and down > 0"), 1)), F.sum("up"), F.max(F.col("up") + F.col("down"))).first()
        if not open_:
            break
        hub = max(LEAST, edges_ // HUBS)
        hubs = [r["a"] for r in degrees.where(F.col("up") + F.col("down") > hub).select("a").collect()] if most > hub else []  # at most 2 * HUBS
        # A step makes no more than two rows of an edge, so few edges need few tasks and files, whatever the shuffle has.
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges_ // A_TASK))
        large = store.put(_large_star(now, hubs).coalesce(tasks))
        now = store.put(_small_star(large, hubs).coalesce(tasks))
        store.drop_all_but(now)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())

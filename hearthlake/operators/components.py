"""Connected components of a graph as joins and sums, and the main cluster of a group's points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..shared import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> node, root: the smallest node that each node of an edge is connected with.

    Alternates two contractions: larger neighbours of a node are tied to its smallest one, then smaller ones are. Every round is cut
    off in the shared folder; the rounds end when the edges are stars, after some log of the longest way.
    """
    down = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(e: DataFrame) -> tuple:
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    seen = mark(down)
    for _ in range(most_rounds):
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        larger = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        lowest = larger.groupBy("a").agg(F.min("b").alias("low"))
        smaller = larger.join(lowest, "a")
        down = smaller.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        down = cut(down)
        now = mark(down)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components aren't finished after {most_rounds} rounds")
    roots = down.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def cell_clusters(points: DataFrame, keys: list[str], size: float = 0.02) -> DataFrame:
    """keys, cluster, n, lat_sum, lng_sum: clusters of occupied cells that touch, corners included, by their first cell. Null points don't count.

    Cells of a row that lie side by side are one node of the graph, and nodes are numbers.
    """
    g = F.struct(*keys).alias("g")
    cells = points.filter("lat is not null and lng is not null").groupBy(g, geo.cell(F.col("lat"), size).alias("r"), geo.cell(F.col("lng"), size).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("lat").alias("lat_sum"), F.sum("lng").alias("lng_sum"))
    row = Window.partitionBy("g", "r").orderBy("c")
    start = F.when(F.coalesce(F.col("c") - F.lag("c").over(row) > 1, F.lit(True)), F.col("id"))
    cells = cells.withColumn("id", F.monotonically_increasing_id()).withColumn("start", start)
    cells = cut(cells.withColumn("run", F.last("start", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))).drop("id", "start"))
    above = cells.select("g", (F.col("r") + 1).alias("r"), F.explode(F.array(*(F.col("c") + k for k in (-1, 0, 1)))).alias("c"), F.col("run").alias("a"))
    root = components(above.join(cells.select("g", "r", "c", F.col("run").alias("b")), ["g", "r", "c"]).select("a", "b"))
    runs = cells.groupBy("g", F.col("run").alias("node")).agg(F.min("r").alias("r"), F.min("c").alias("c"), *(F.sum(x).alias(x) for x in ("n", "lat_sum", "lng_sum")))
    own = runs.join(root, "node", "left").withColumn("of", F.coalesce("root", "node"))
    sums = own.groupBy("g", "of").agg(F.min(F.struct("r", "c")).alias("cluster"), *(F.sum(x).alias(x) for x in ("n", "lat_sum", "lng_sum")))
    return sums.select("g.*", "cluster", "n", "lat_sum", "lng_sum")


def main_clusters(points: DataFrame, keys: list[str], size: float = 0.02, share: float = 0.8) -> DataFrame:
    """keys, lat, lng, n, of, clusters: centre and size of the cluster that holds at least ``share`` of a group's points.

    Groups without one are left out: their points lie around several places, of which none is the group's.
    """
    best = F.max_by(F.struct("n", "lat_sum", "lng_sum"), F.struct("n", (-F.col("cluster.r")).alias("r"), (-F.col("cluster.c")).alias("c")))
    g = cell_clusters(points, keys, size).groupBy(*keys).agg(best.alias("best"), F.sum("n").alias("of"), F.count(F.lit(1)).alias("clusters"))
    g = g.filter(F.col("best.n") >= F.col("of") * F.lit(share))
    return g.select(*keys, (F.col("best.lat_sum") / F.col("best.n")).alias("lat"), (F.col("best.lng_sum") / F.col("best.n")).alias("lng"), F.col("best.n").alias("n"), "of", "clusters")

"""Connected components of an edge table, by alternating stars; each round is a written table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurelens.llm.tables import stored


def same_id_links(rows: DataFrame, node: str, centre: str) -> DataFrame:
    """Links (a, b) between the centres of ids that occur with several: rows with equal ids are one node."""
    several = rows.groupBy(F.col(node).alias("_node")).agg(F.min(centre).alias("_low"), F.max(centre).alias("_high")).where("_low < _high")
    return rows.join(several, F.col(node) == F.col("_node")).where(F.col(centre) != F.col("_low")).select(F.col("_low").alias("a"), F.col(centre).alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component_id`` (the smallest id reachable) of every id on an edge.

    A round hangs each node's larger neighbours on its smallest neighbour, then its smaller
    ones.  Rounds are joins and minima, so the centre of a star with very many leaves is
    one key of an aggregate with map-side combining and one side of a join that can be split.
    Every round reads the table that the last one wrote; it ends when the edges no longer
    change, in a number of rounds that grows with the logarithm of the graph's size.
    """
    def stars(e, larger):
        """(node, centre) after hanging the neighbours on the smallest of each neighbourhood."""
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if larger:
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            low = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = low.groupBy("u").agg(F.min("v").alias("m"))
            out = low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = stored(edges.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v")).where("u <> v").distinct(), "edges")
    before = mark(e)
    while before[0]:
        e = stored(stars(stars(e, True), False), "edges")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())

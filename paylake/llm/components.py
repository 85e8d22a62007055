"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import save, scratch


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """True if every node points to one smaller node that points to none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in_")).unionAll(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in_"))
    )
    bad = ends.groupBy("n").agg(F.sum("out").alias("o"), F.max("in_").alias("i"))
    return bad.where((F.col("o") > 1) | ((F.col("o") > 0) & (F.col("i") > 0))).limit(1).isEmpty()


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``edges`` (two bigint columns) -> one row per node of an edge: ``node``, ``component`` (the
    smallest node reachable). Null ends and loops are ignored; no edges give no rows.

    Each round is two minimum aggregations (combined before the shuffle) and two equi-joins on a
    node; a hub's rows are split by adaptive skew joins. No component meets in one task. Rounds
    grow with the logarithm of a component's size; each is written to the shared folder.
    """
    with scratch(spark):
        e = save(
            spark,
            edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
            .distinct(),
            "edges",
        )
        for _ in range(most_rounds):
            if _is_forest_of_stars(e):
                # every u once; every root is some v
                both = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
                return save(spark, both, "components", keep=True)
            both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = (
                both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            )
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = (
                large.join(low, "u")
                .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
                .select("x.u", "x.v")
                .where("u <> v")
                .distinct()
            )
            e = save(spark, small, "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

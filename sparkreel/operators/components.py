"""Connected parts: of graphs by shrinking labels, of rasters by the runs of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.session import scratch_dir


def _written(df: DataFrame) -> DataFrame:
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Adds label to the nodes: the least node reachable over edges (a, b), either way.

    In a round every node takes the least label beside it, and then its label's label, so chains halve. Every
    round is written once and ends the lineage; a round without a change is the last.
    """
    both = _written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = _written(nodes.select(F.col(node).alias("id"), F.col(node).alias("label")).distinct())
    while True:
        beside = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_n"))
        # a node's label hears of what its nodes have beside them
        lower = labels.join(beside, "id").select(F.explode(F.array("id", "label")).alias("id"), "_n").groupBy("id").agg(F.min("_n").alias("_n"))
        low = labels.join(lower, "id", "left").select("id", F.least("label", F.coalesce("_n", "label")).alias("label"), F.col("label").alias("_was"))
        jump = low.select(F.col("id").alias("label"), F.col("label").alias("_up"))
        new = _written(low.join(jump, "label", "left").select("id", F.least("label", F.coalesce("_up", "label")).alias("label"), "_was"))
        labels = new.select("id", "label")
        if new.where("label <> _was").limit(1).count() == 0:
            break
    return nodes.join(labels.withColumnRenamed("id", node), node)


def row_runs(px: DataFrame, on: Column, img: str = "img") -> DataFrame:
    """(img, y, x1, x2) of the runs of pixels that are on in each row."""
    island = F.col("x") - F.row_number().over(W.partitionBy(img, "y").orderBy("x"))
    return px.where(on).withColumn("_i", island).groupBy(img, "y", "_i").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("_i")


def raster_components(px: DataFrame, on: Column, img: str = "img") -> DataFrame:
    """(img, component, x1, y1, x2, y2, pixels) of the parts of each raster that hang together, corners included.

    Runs of neighbouring rows meet in a join by row; only runs are labelled, not pixels. component is (y, x) of the
    part's first pixel in page order.
    """
    key = F.struct(F.col(img).alias("img"), "y", "x1")
    runs = _written(row_runs(px, on, img).withColumn("id", key))
    below = runs.select(img, (F.col("y") - 1).alias("y"), F.col("x1").alias("_x1"), F.col("x2").alias("_x2"), F.col("id").alias("b"))
    edges = runs.withColumnRenamed("id", "a").join(below, [img, "y"]).where("x1 <= _x2 + 1 and x2 >= _x1 - 1").select("a", "b")
    parts = connected(runs, edges).groupBy(img, "label").agg(F.min("x1").alias("x1"), F.min("y").alias("y1"), F.max("x2").alias("x2"), F.max("y").alias("y2"), F.sum(F.col("x2") - F.col("x1") + 1).alias("pixels"))
    return parts.select(img, F.struct(F.col("label.y").alias("y"), F.col("label.x1").alias("x")).alias("component"), "x1", "y1", "x2", "y2", "pixels")

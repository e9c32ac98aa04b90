"""Timelines: ordered slots of a group, some of them holes; filling, cutting, looking up, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def positions(df: DataFrame, grp: str, *order: str) -> DataFrame:
    """Adds pos, the 0-based place of each row in its group."""
    return df.withColumn("pos", F.row_number().over(W.partitionBy(grp).orderBy(*order)).cast("long") - 1)


def hold(df: DataFrame, grp: str, content: str, to: str = "shown") -> DataFrame:
    """Holes show the content before them, leading holes the first content; a group without content stays empty."""
    w = W.partitionBy(grp).orderBy("pos")
    before, first = F.last(content, True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(content, True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn(to, F.coalesce(before, first))


def keep_intervals(df: DataFrame, grp: str, content: str) -> DataFrame:
    """(grp, from, to) of each run of filled slots, half open; groups without a hole give none."""
    filled = df.withColumn("_holes", F.count_if(F.col(content).isNull()).over(W.partitionBy(grp))).where(F.col(content).isNotNull() & (F.col("_holes") > 0))
    island = F.col("pos") - F.row_number().over(W.partitionBy(grp).orderBy("pos"))
    return filled.withColumn("_i", island).groupBy(grp, "_i").agg(F.min("pos").alias("from"), (F.max("pos") + 1).alias("to")).drop("_i")


def check_keep(intervals: DataFrame, grp: str) -> DataFrame:
    """(grp, ordered, frames): whether no interval begins before its predecessor ends, and their total length."""
    before = F.lag("to").over(W.partitionBy(grp).orderBy("from", "to"))
    return intervals.withColumn("_ok", F.coalesce(before <= F.col("from"), F.lit(True))).groupBy(grp).agg(F.bool_and("_ok").alias("ordered"), F.sum(F.col("to") - F.col("from")).alias("frames"))


def js_round(x: Column) -> Column:
    """Half-way cases go up: floor(x + 0.5)."""
    return F.floor(x + 0.5).cast("long")


def splice_bounds(intervals: DataFrame, grp: str, rate: int, fps: float) -> DataFrame:
    """Adds the source samples [src_from, src_to) of each interval and where they begin in the output."""
    w = W.partitionBy(grp).orderBy("from")
    out = intervals.withColumn("src_from", js_round(F.col("from") * rate / fps)).withColumn("src_to", js_round(F.col("to") * rate / fps))
    before = F.coalesce(F.sum(F.col("to") - F.col("from")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("out_from", js_round(before * rate / fps))


def crossfade_samples(intervals: DataFrame, grp: str, rate: int, fps: float, seconds: float, have: str = "have") -> DataFrame:
    """(grp, from, i, weight): every sample of the fade into each interval that does not touch the one before it, (i + 1/2) / m for i below m.

    m is the least of the fade's samples, those that the source, `have` samples long, has for the interval, and
    those that it has behind the interval before.
    """
    w = W.partitionBy(grp).orderBy("from")
    at = lambda x: js_round(x * rate / fps)
    before = F.coalesce(F.sum(F.col("to") - F.col("from")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = intervals.withColumn("_src", at(F.col("from"))).withColumn("_len", at(before + F.col("to") - F.col("from")) - at(before))
    rows = rows.withColumn("_gap", F.col("from") - F.lag("to").over(w)).withColumn("_end", F.lag(F.col("_src") + F.col("_len")).over(w)).where("_gap > 0")
    m = F.least(F.greatest(F.lit(1).cast("long"), js_round(F.lit(rate * seconds))), F.greatest(F.lit(0), F.least("_len", F.col(have) - F.col("_src"))), F.greatest(F.lit(0), F.col(have) - F.col("_end")))
    rows = rows.select(grp, "from", m.alias("_m")).where("_m > 0").select(grp, "from", "_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("i"))
    return rows.withColumn("weight", (F.col("i") + 0.5) / F.col("_m")).drop("_m")


def as_of(asks: DataFrame, rows: DataFrame, grp: str, at: str, value: str) -> DataFrame:
    """Adds to each ask the value of the last row at or before it in its group: one sort of both sides, no join."""
    both = asks.select(grp, at, F.lit(1).alias("_ask"), F.lit(None).cast(rows.schema[value].dataType).alias(value)).unionByName(rows.select(grp, at, F.lit(0).alias("_ask"), value))
    w = W.partitionBy(grp).orderBy(at, "_ask").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, True).over(w)).where("_ask = 1").drop("_ask")


def prioritised(slots: DataFrame, frames: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Left outer join by the first of several keys that finds a frame; frames' names must be unique. Adds frame and via (1-based key)."""
    out, rest = slots, slots.columns
    for k in keys:
        out = out.join(frames.select(F.col(name).alias(k), F.col("frame").alias(f"_{k}")), k, "left")
    via = F.coalesce(*[F.when(F.col(f"_{k}").isNotNull(), F.lit(i).cast("long")) for i, k in enumerate(keys, 1)])
    return out.select(*rest, F.coalesce(*[F.col(f"_{k}") for k in keys]).alias("frame"), via.alias("via"))


def next_use(df: DataFrame, grp: str, item: str) -> DataFrame:
    """Adds the place of the next slot of the same group with the same item."""
    return df.withColumn("next_pos", F.lead("pos").over(W.partitionBy(grp, item).orderBy("pos")))


def first_seen(df: DataFrame, grp: str, item: str) -> DataFrame:
    """(grp, item, first_pos, uses) of each distinct item, in order of first use."""
    return df.groupBy(grp, item).agg(F.min("pos").alias("first_pos"), F.count("*").alias("uses"))

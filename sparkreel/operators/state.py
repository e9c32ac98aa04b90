"""Rules over what happened before: stalls, expiry, retries, merging once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stalls(df: DataFrame, key: str, at: str, seconds: float) -> DataFrame:
    """(key, stalled_from, gap) of the gaps between a key's rows that are longer than so many seconds."""
    w = W.partitionBy(key).orderBy(at)
    gap = (F.col(at).cast("timestamp").cast("double") - F.lag(at).over(w).cast("timestamp").cast("double")).alias("gap")
    return df.select(key, F.lag(at).over(w).alias("stalled_from"), gap).where(F.col("gap") > seconds)


def expired(df: DataFrame, key: str, at: str, closed: str, now: str, grace: float) -> DataFrame:
    """(key, last_seen, closed) of keys to sweep away: closed ones, and those not heard of for `grace` seconds before now."""
    rows = df.groupBy(key).agg(F.max(at).alias("last_seen"), F.max_by(F.col(closed), F.col(at)).alias("closed"))
    age = F.lit(now).cast("timestamp").cast("double") - F.col("last_seen").cast("timestamp").cast("double")
    return rows.where(F.col("closed") | (age > grace))


def retry_allowed(df: DataFrame, key: str, at: str, failed: str, most: int, wait: float) -> DataFrame:
    """Adds allowed: whether a try right after a row may go on: fewer than `most` failures in a row, or `wait` seconds since the last."""
    w = W.partitionBy(key).orderBy(at)
    rows = df.withColumn("_run", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    fails = F.count_if(F.col(failed)).over(W.partitionBy(key, "_run").orderBy(at).rowsBetween(W.unboundedPreceding, 0))
    after = F.lead(at).over(w).cast("timestamp").cast("double") - F.col(at).cast("timestamp").cast("double")
    return rows.withColumn("fails", fails).withColumn("allowed", (F.col("fails") < most) | F.coalesce(after >= wait, F.lit(False))).drop("_run")


def merge_once(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def merged_maps(old: str, new: str, incoming_wins: bool):
    """One map of both, by the given winner."""
    pick = (lambda k, a, b: F.coalesce(b, a)) if incoming_wins else (lambda k, a, b: F.coalesce(a, b))
    return F.map_zip_with(old, new, pick)


def saved(store, name: Column, entry: Column) -> Column:
    """The map with an entry put under a name, in place of one that is there."""
    return F.map_zip_with(store, F.create_map(name, entry), lambda k, a, b: F.coalesce(b, a))


def deleted(store, name: Column) -> Column:
    return F.map_filter(store, lambda k, v: k != name)


def listed(store) -> Column:
    """The names in a map in order; none for null."""
    return F.coalesce(F.array_sort(F.map_keys(store)), F.array().cast("array<string>"))


def merged_stores(current: DataFrame, incoming: DataFrame, incoming_wins: bool = False, left_out: tuple[str, ...] = ("flags",)) -> DataFrame:
    """(kind, name, value) of two stores of such rows: an entry of both is the winner's; kinds left out don't travel.

    One shuffle by (kind, name), combined before it. A name twice in one store: its smallest value.
    """
    travels = incoming.where(~F.col("kind").isin(*left_out)) if left_out else incoming
    both = current.select("kind", "name", F.lit(1).alias("_rank"), "value").unionByName(travels.select("kind", "name", F.lit(0 if incoming_wins else 2).alias("_rank"), "value"))
    return both.groupBy("kind", "name").agg(F.min(F.struct("_rank", "value"))["value"].alias("value"))


def swept(folders: DataFrame, key: str, now: str, every: float = 300, grace: float = 3600, kept: float = 600) -> DataFrame:
    """(key, emptied) of the folders (key, last, closed, locked, output) to sweep.

    A folder is swept if it is marked closed, or its last sign of life (null: none) is `grace` old or more than
    `every` ahead of now (a clock set back), and nobody holds its lock. It is emptied whole unless its
    youngest output is `kept` old at most.
    """
    age = lambda c: F.lit(now).cast("timestamp").cast("double") - F.col(c).cast("timestamp").cast("double")
    alive = F.coalesce((age("last") > -every) & (age("last") < grace), F.lit(False))
    gone = folders.where((F.col("closed") | ~alive) & ~F.col("locked"))
    return gone.select(key, F.coalesce(age("output") > kept, F.lit(True)).alias("emptied"))

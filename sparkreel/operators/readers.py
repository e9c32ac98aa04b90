"""Folders that readers keep from being deleted, sequences with few distinct pictures, and frames asked for out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.session import scratch_dir


def deletions(clears: DataFrame, holds: DataFrame, cache: str) -> DataFrame:
    """(cache, generation, cleared, deleted) of every folder that was cleared: when it can be deleted, null if a reader never lets go.

    clears: (cache, at): each ends a generation and begins the next, counted from 0. holds: (cache, start, end,
    narrowed): a reader holds all generations from the one at its start on until its end, once narrowed only that one;
    end and narrowed may be null. A hold and a clear at one instant: the hold came first. One sort by cache,
    no pairs of folders and readers: what counts of the holds before a clear are the latest ends, those of the
    same generation and the earlier ones.
    """
    kind = dict(clears.dtypes)["at"]
    both = clears.select(cache, "at", F.lit(1).alias("_clear"), F.lit(None).cast(kind).alias("end"), F.lit(None).cast(kind).alias("narrowed"))
    both = both.unionByName(holds.select(cache, F.col("start").alias("at"), F.lit(0).alias("_clear"), "end", "narrowed"))
    w = W.partitionBy(cache).orderBy("at", "_clear")
    generation = F.coalesce(F.sum("_clear").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = both.withColumn("generation", generation)
    # a null end never comes: such holds are counted apart, all others by their latest end
    until = F.least(F.coalesce("end", "narrowed"), F.coalesce("narrowed", "end"))
    rows = rows.withColumns({"_hold": F.col("_clear") == 0, "_until": until})
    own = W.partitionBy(cache, "generation").orderBy("at", "_clear").rowsBetween(W.unboundedPreceding, -1)
    per = rows.groupBy(cache, "generation").agg(F.max(F.when(F.col("_hold"), F.col("_until"))).alias("_u"), F.count_if(F.col("_hold") & F.col("_until").isNull()).alias("_n"))
    before = W.partitionBy(cache).orderBy("generation").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(cache, "generation", F.max("_u").over(before).alias("_earlier"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ever"))
    rows = rows.withColumns({"_latest": F.max(F.when(F.col("_hold"), F.col("end"))).over(own), "_open": F.coalesce(F.count_if(F.col("_hold") & F.col("end").isNull()).over(own), F.lit(0))})
    rows = rows.where("_clear = 1").join(per, [cache, "generation"])
    at = F.greatest("at", F.coalesce("_latest", "at"), F.coalesce("_earlier", "at"))
    return rows.select(cache, "generation", F.col("at").alias("cleared"), F.when((F.col("_open") == 0) & (F.col("_ever") == 0), at).alias("deleted"))


def conform_plan(sequence: DataFrame, infos: DataFrame, grp: str, content: str) -> tuple[DataFrame, DataFrame]:
    """The plan of every sequence, and what becomes of each position.

    sequence: (grp, pos, content), equal pictures having equal contents; infos: (content, w, h, sixteen, alpha, png,
    colour), one row each. The plan has the size most positions have (of equally frequent ones the first seen), 16 bits
    or alpha if any picture has; a picture is copied if it is a PNG of just that kind, else put in the middle if its
    size differs by 4 or a hundredth at most, else resized. Every picture is looked at once, whatever its positions.

    Returns (grp, w, h, sixteen, alpha, frames, unique, passthrough, conform, resized) and (grp, pos, content, verdict).
    """
    used = sequence.groupBy(grp, content).agg(F.count("*").alias("_uses"), F.min("pos").alias("_first")).join(infos, content)
    sizes = used.groupBy(grp, "w", "h").agg(F.sum("_uses").alias("_votes"), F.min("_first").alias("_seen"))
    best = sizes.groupBy(grp).agg(F.max_by(F.struct("w", "h"), F.struct("_votes", -F.col("_seen"))).alias("_b"))
    kinds = used.groupBy(grp).agg(F.bool_or("sixteen").alias("_deep"), F.bool_or("alpha").alias("_alpha"))
    rows = used.join(best.join(kinds, grp), grp)
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(4), F.floor(b / 100))
    w, h = F.col("_b.w"), F.col("_b.h")
    copy = F.col("png") & (F.col("w") == w) & (F.col("h") == h) & (F.col("sixteen") == F.col("_deep")) & (F.col("colour") == F.when(F.col("_alpha"), 6).otherwise(2))
    verdict = F.when(copy, "copy").when(near(F.col("w"), w) & near(F.col("h"), h), "centre").otherwise("resize")
    rows = rows.select(grp, content, "_uses", w.alias("w"), h.alias("h"), "_deep", "_alpha", verdict.alias("verdict"))
    plan = rows.groupBy(grp).agg(
        F.first("w").alias("w"), F.first("h").alias("h"), F.first("_deep").alias("sixteen"), F.first("_alpha").alias("alpha"), F.sum("_uses").alias("frames"), F.count("*").alias("unique"),
        F.count_if(F.col("verdict") == "copy").alias("passthrough"), F.count_if(F.col("verdict") != "copy").alias("conform"), F.count_if(F.col("verdict") == "resize").alias("resized"),
    )
    return plan, sequence.join(rows.select(grp, content, "verdict"), [grp, content]).select(grp, "pos", content, "verdict")


def in_one_pass(asks: DataFrame, frames: DataFrame, file: str, at: str, content: str) -> DataFrame:
    """Asks (file, ordinal, at) with the content of the last frame (file, at, content) at or before each, null before a file's first.

    Asks are cut into ranges of (file, at), so a file that many ask for is many stretches of time; each is served in
    time order by one task, in one pass over its own frames. What a stretch needs of those before it is one frame,
    found from the last ones of the stretches.
    """
    spark, path = asks.sparkSession, scratch_dir(asks.sparkSession)
    ranged = asks.select(file, at).repartitionByRange(file, at).groupBy(file, F.spark_partition_id().alias("_p")).agg(F.min(at).alias("_low"))
    ranged.write.parquet(path)  # a repeated task must find the same ranges
    lows = spark.read.schema(ranged.schema).parquet(path).groupBy(file).agg(F.array_sort(F.collect_set("_low")).alias("_lows"))
    stretch = F.size(F.filter("_lows", lambda low: low <= F.col(at)))
    frame = F.struct(F.col(at).alias("at"), F.col(content).alias("content"))
    mine = asks.join(lows, file).select(*asks.columns, stretch.alias("_s"), F.lit(1).alias("_ask"))
    shown = frames.join(lows, file).select(file, at, stretch.alias("_s"), F.lit(0).alias("_ask"), frame.alias("_f"))
    last = shown.groupBy(file, "_s").agg(F.max("_f").alias("_f"))
    all_ = lows.select(file, F.explode(F.sequence(F.lit(0), F.size("_lows"))).alias("_s")).join(last, [file, "_s"], "left")
    before = W.partitionBy(file).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carried = all_.select(file, "_s", F.last("_f", True).over(before).alias("_carried"))
    w = W.partitionBy(file, "_s").orderBy(at, "_ask").rowsBetween(W.unboundedPreceding, 0)
    rows = mine.unionByName(shown, True).withColumn("_f", F.last("_f", True).over(w)).where("_ask = 1").join(carried, [file, "_s"])
    return rows.select(*asks.columns, F.coalesce("_f", "_carried")["content"].alias(content))

"""Tone curves: monotone fits, smoothing, interpolation, distribution functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.operators import curves

#: Half up to whole numbers, what lies below a half by less than half a billionth being one.
HALF = 0.5 + 5e-10


def isotonic(df: DataFrame, grp: str, x: str, y: str) -> DataFrame:
    """Adds fit, the non-decreasing least-squares fit of each group's curve: pooled in one pass over its points."""
    curve = df.groupBy(grp).agg(F.array_sort(F.collect_list(F.struct(x, y))).alias("_p"))
    pools = curves.isotonic(F.transform("_p", lambda p: p[y].cast("double")))
    rows = curve.select(grp, F.explode(F.arrays_zip(F.col("_p").alias("p"), pools.alias("pool"))).alias("z")).select(grp, f"z.p.{x}", f"z.p.{y}", "z.pool")
    # the same bits as a difference of running sums
    rows = rows.withColumn("_s", F.sum(y).over(W.partitionBy(grp).orderBy(x).rowsBetween(W.unboundedPreceding, 0)))
    pool = W.partitionBy(grp, "pool").orderBy(x).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn("fit", (F.last("_s").over(pool) - F.first("_s").over(pool) + F.first(y).over(pool)) / F.count("*").over(pool)).select(grp, x, y, "fit")


def moving_mean(df: DataFrame, grp: str, x: str, y: str, radius: int) -> DataFrame:
    """Adds smooth, the mean of as many points on each side as both sides have, `radius` at most; end points stay."""
    w = W.partitionBy(grp).orderBy(x)
    near = w.rowsBetween(-radius, radius)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(W.partitionBy(grp)))
    rows = rows.withColumn("_h", F.least(F.lit(radius), F.col("_i") - 1, F.col("_n") - F.col("_i"))).withColumn("_near", F.collect_list(y).over(near))
    inside = F.slice("_near", F.least(F.col("_i") - 1, F.lit(radius)) - F.col("_h") + 1, 2 * F.col("_h") + 1)
    return rows.withColumn("smooth", F.aggregate(inside, F.lit(0.0), lambda a, v: a + v) / (2 * F.col("_h") + 1)).drop("_i", "_n", "_h", "_near")


def slopes(df: DataFrame, grp: str, x: str, y: str) -> DataFrame:
    """Adds d, the monotone cubic slope: harmonic mean of the neighbouring chords weighted by their widths, 0 where they turn."""
    w = W.partitionBy(grp).orderBy(x)
    h0, h1 = F.col(x) - F.lag(x).over(w), F.lead(x).over(w) - F.col(x)
    s0, s1 = (F.col(y) - F.lag(y).over(w)) / h0, (F.lead(y).over(w) - F.col(y)) / h1
    rows = df.withColumns({"_h0": h0, "_h1": h1, "_s0": s0, "_s1": s1})
    w1, w2 = 2 * F.col("_h1") + F.col("_h0"), F.col("_h1") + 2 * F.col("_h0")
    inner = F.when(F.col("_s0") * F.col("_s1") > 0, (w1 + w2) / (w1 / F.col("_s0") + w2 / F.col("_s1"))).otherwise(F.lit(0.0))
    return rows.withColumn("d", F.when(F.col("_s0").isNull(), F.col("_s1")).when(F.col("_s1").isNull(), F.col("_s0")).otherwise(inner)).drop("_h0", "_h1", "_s0", "_s1")


def hermite(t: Column, h: Column, y0: Column, y1: Column, d0: Column, d1: Column) -> Column:
    """The cubic with those ends and slopes at t in 0..1 of a segment of width h."""
    a, b = 1 + 2 * t, 1 - t
    return a * b * b * y0 + t * b * b * h * d0 + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * h * d1


def cdf(df: DataFrame, grp: str, x: str, n: str) -> DataFrame:
    """Adds cdf: cumulative share, scaled so that the first is 0 and the last 1."""
    up, whole = W.partitionBy(grp).orderBy(x).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(grp)
    rows = df.withColumn("_c", F.sum(n).over(up))
    low, high = F.min("_c").over(whole), F.max("_c").over(whole)
    return rows.withColumn("cdf", F.when(high > low, (F.col("_c") - low) / (high - low)).otherwise(F.lit(0.0))).drop("_c")


def running_max(df: DataFrame, grp: str, x: str, y: str, to: str) -> DataFrame:
    return df.withColumn(to, F.max(y).over(W.partitionBy(grp).orderBy(x).rowsBetween(W.unboundedPreceding, 0)))


def inverse_at(df: DataFrame, grp: str, x: str, y: str, values: list[float]) -> DataFrame:
    """(grp, want, x): where each group's rising curve reaches the values, straight between points; its last x beyond the end, no row below its first y."""
    w = W.partitionBy(grp).orderBy(x)
    rows = df.select(grp, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lead(x).over(w).alias("_x1"), F.lead(y).over(w).alias("_y1"))
    asked = rows.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias("want")).where("_y <= want")
    last = asked.groupBy(grp, "want").agg(F.max_by(F.struct("_x", "_y", "_x1", "_y1"), "_x").alias("s"))
    between = F.col("s._x") + F.try_divide((F.col("s._x1") - F.col("s._x")) * (F.col("want") - F.col("s._y")), F.col("s._y1") - F.col("s._y"))
    return last.select(grp, "want", F.coalesce(between, F.col("s._x")).alias(x))


def ink_ramps(df: DataFrame, stops: Column, ink: Column) -> DataFrame:
    """Rows with x, 0..255, and the whole colours r, g and b of their ramp at that density: straight between stops, half up.

    stops: array<struct(d, r, g, b)>, in any order (of equal densities the first counts as the lower); without stops, or
    null, white at 0 and the ink, struct(r, g, b), at 255. Densities are cut to 0..255; paper is white at 0 unless a
    stop lies within half a step of it, and the last stop's colour goes on to 255.
    """
    point = lambda d, i, c: F.struct(d.cast("double").alias("d"), i.cast("int").alias("i"), *[c[k].cast("double").alias(k) for k in "rgb"])
    white = F.struct(*[F.lit(255).alias(k) for k in "rgb"])
    given = F.array_sort(F.transform(stops, lambda s, i: point(F.greatest(F.lit(0.0), F.least(F.lit(255.0), s["d"].cast("double"))), i, s)))
    first, last = F.get(given, F.lit(0)), F.get(given, F.size(given) - 1)
    none = F.filter(given, lambda s: F.lit(False))
    started = F.concat(F.when(first["d"] > 0.5, F.array(point(F.lit(0), F.lit(-1), white))).otherwise(none), given)
    whole = F.concat(started, F.when(last["d"] < 254.5, F.array(point(F.lit(255), F.lit(1 << 30), last))).otherwise(none))
    plain = F.array(point(F.lit(0), F.lit(0), white), point(F.lit(255), F.lit(1), ink))
    anchors = F.when(F.coalesce(F.size(stops), F.lit(0)) > 0, whole).otherwise(plain)

    def parts(a: Column) -> Column:
        """Each anchor with the next one and the whole densities from behind it to that one."""
        below = lambda s: F.floor(s["d"]).cast("int")
        start = lambda s, i: F.when(i == 0, F.lit(0)).otherwise(below(s) + 1)
        end = lambda i: F.when(i == F.size(a) - 1, F.lit(255)).otherwise(below(F.get(a, i + 1)))
        part = lambda s, i: F.struct(s.alias("low"), F.get(a, F.least(i + 1, F.size(a) - 1)).alias("high"), start(s, i).alias("start"), end(i).alias("end"))
        return F.filter(F.transform(a, part), lambda p: p["start"] <= p["end"])

    rows = df.select("*", F.explode(curves.let(anchors, parts)).alias("_p")).select("*", F.explode(F.sequence("_p.start", "_p.end")).alias("x"))
    low, high = F.col("_p.low"), F.col("_p.high")
    t = F.when(high["d"] > low["d"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x") - low["d"]) / (high["d"] - low["d"])))).otherwise(0.0)
    return rows.select(*df.columns, "x", *[F.floor(low[c] + (high[c] - low[c]) * t + HALF).cast("long").alias(c) for c in "rgb"])

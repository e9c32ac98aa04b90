"""Tone curves as arrays: a chart's correction curve from its prints, content curves, level curves of a gray strip.

A curve has a few hundred points at most and lives in one row; tables of curves are rows in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the method: points of the fine grid, width of its moving mean, points of a curve, width of the histogram's mean, share of even slope.
GRID, POLISH, POINTS, HISTOGRAM, EVEN = 2048, 31, 256, 21, 0.15
#: Fixed: part of the range by which prints may differ on average, least gap of two level points, least contrast of a strip.
SPREAD, LEAST_GAP, CONTRAST = 0.03, 2.55, 12.75


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _range(a, b) -> Column:
    """a to b, nothing if b is below a."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def _windows(ext: Column, n: Column, width) -> Column:
    """Means of `width` neighbours in an array padded on both sides."""
    return F.transform(_range(0, n - 1), lambda i: _sum(F.slice(ext, i + 1, width)) / width)


def smooth_adaptive(y: Column) -> Column:
    """Moving mean over an odd window of a sixteenth of the points, 3 at least, mirrored at the ends without the end point; the end points stay."""

    def run(y: Column, n: Column, v: Column) -> Column:
        h = F.floor(v / 2).cast("int")
        left = F.transform(F.sequence(h, F.lit(1), F.lit(-1)), lambda i: F.get(y, F.least(i, n - 1)))
        right = F.transform(F.sequence(F.lit(0), h - 1), lambda i: F.get(y, F.greatest(n - 2 - i, F.lit(0))))
        return let(F.concat(left, y, right), lambda e: let(_windows(e, n, v), lambda s: F.transform(s, lambda x, i: F.when((i == 0) | (i == n - 1), F.get(y, i)).otherwise(x))))

    window = lambda n: F.greatest(F.lit(3), F.floor(n / 16).cast("int").bitwiseOR(F.lit(1)))
    return let(y, lambda a: F.when(F.size(a) < 3, a).otherwise(run(a, F.size(a), window(F.size(a)))))


def isotonic(y: Column) -> Column:
    """The non-decreasing least-squares fit of an array, by pooling neighbours that fall."""
    pool = lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n"))
    none = F.array().cast("array<struct<s:double,n:int>>")

    def add(stack: Column, v: Column) -> Column:
        new = F.struct(F.struct(v.cast("double").alias("s"), F.lit(1).alias("n")).alias("b"), none.alias("kept"))

        def down(state: Column, top: Column) -> Column:
            stays = (F.size(state["kept"]) > 0) | (top["s"] / top["n"] < state["b"]["s"] / state["b"]["n"])
            return F.when(stays, F.struct(state["b"].alias("b"), F.concat(state["kept"], F.array(top)).alias("kept"))).otherwise(F.struct(pool(top, state["b"]).alias("b"), state["kept"].alias("kept")))

        return let(F.aggregate(F.reverse(stack), new, down), lambda s: F.concat(F.reverse(s["kept"]), F.array(s["b"])))

    return F.flatten(F.transform(F.aggregate(y, none, add), lambda b: F.array_repeat(b["s"] / b["n"], b["n"])))


def rising(y: Column, step: Column) -> Column:
    """Each value that is not above the one before becomes that one plus a step."""
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(y, F.array().cast("array<double>"), lambda a, v: F.concat(a, F.array(F.when((F.size(a) > 0) & (v <= F.coalesce(F.try_element_at(a, F.lit(-1)), v)), last(a) + step).otherwise(v))))


def running_max(y: Column) -> Column:
    return F.aggregate(y, F.array().cast("array<double>"), lambda a, v: F.concat(a, F.array(F.greatest(v, F.coalesce(F.try_element_at(a, F.lit(-1)), v)))))


def pchip(x: Column, y: Column, points: Column) -> Column:
    """The monotone cubic through (x, y) at the points asked for; the end segments go on beyond the ends."""

    def run(x: Column, y: Column, n: Column) -> Column:
        h = F.transform(_range(0, n - 2), lambda i: F.get(x, i + 1) - F.get(x, i))
        chord = lambda h: F.transform(_range(0, n - 2), lambda i: (F.get(y, i + 1) - F.get(y, i)) / F.get(h, i))

        def slopes(h: Column, d: Column) -> Column:
            def inner(i: Column) -> Column:
                a, b, w1, w2 = F.get(d, i - 1), F.get(d, i), 2 * F.get(h, i) + F.get(h, i - 1), F.get(h, i) + 2 * F.get(h, i - 1)
                return F.when(a * b <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / a + w2 / b))

            return F.transform(_range(0, n - 1), lambda i: F.when(i == 0, F.get(d, F.lit(0))).when(i == n - 1, F.get(d, n - 2)).otherwise(inner(i)))

        def at(q: Column, h: Column, m: Column) -> Column:
            def cubic(i: Column) -> Column:
                t = (q - F.get(x, i)) / F.get(h, i)
                return (2 * t * t * t - 3 * t * t + 1) * F.get(y, i) + (t * t * t - 2 * t * t + t) * F.get(h, i) * F.get(m, i) + (3 * t * t - 2 * t * t * t) * F.get(y, i + 1) + (t * t * t - t * t) * F.get(h, i) * F.get(m, i + 1)

            return let(F.greatest(F.lit(0), F.least(n - 2, F.size(F.filter(x, lambda v: v <= q)) - 1)), cubic)

        return let(h, lambda h: let(chord(h), lambda d: let(slopes(h, d), lambda m: F.transform(points, lambda q: at(q, h, m)))))

    return let(x, lambda x: let(y, lambda y: F.when(F.size(x) < 2, F.transform(points, lambda q: F.get(y, F.lit(0)))).otherwise(run(x, y, F.size(x)))))


def polished(y: Column, width: int = POLISH) -> Column:
    """Moving mean of an odd width over an array continued at both ends by turning it about its end points."""
    h = width // 2

    def run(y: Column) -> Column:
        n = F.size(y)
        first, last = F.get(y, F.lit(0)), F.element_at(y, -1)
        left = F.transform(F.sequence(F.lit(h), F.lit(1), F.lit(-1)), lambda i: 2 * first - F.get(y, i))
        right = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda i: 2 * last - F.get(y, n - 2 - i))
        return let(F.concat(left, y, right), lambda e: _windows(e, n, F.lit(width)))

    return let(y, run)


def inverted(x: Column, y: Column, points: int = POINTS) -> Column:
    """x at evenly spaced values of a rising y, from its first to its last, cut to 0..255 and rounded to hundredths."""

    def run(x: Column, y: Column) -> Column:
        low, high, n = F.get(y, F.lit(0)), F.element_at(y, -1), F.size(y)

        def at(t: Column) -> Column:
            between = lambda i: F.get(x, i) + (F.get(x, i + 1) - F.get(x, i)) * (t - F.get(y, i)) / F.greatest(F.get(y, i + 1) - F.get(y, i), F.lit(1e-12))
            return F.when(t <= low, F.get(x, F.lit(0))).when(t >= high, F.element_at(x, -1)).otherwise(let(F.least(n - 2, F.size(F.filter(y, lambda v: v <= t)) - 1), between))

        wanted = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda g: low + g / F.lit(float(points - 1)) * (high - low))
        return F.transform(wanted, lambda t: F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), at(t))) * 100) / 100)

    return let(x, lambda x: let(y, lambda y: run(x, y)))


def averaged_prints(measured: DataFrame, grp: str, patch: str, value: str, parts: int = 1) -> DataFrame:
    """(grp, patch, mean, off, prints): each patch's mean over the prints where it was measured, to tenths, and its mean deviation (null of a single print).

    Values may be whole parts of a unit, `parts` to one. They are added in ascending order, so the order of
    files or rows changes no bit; of two tenths equally near the mean takes the upper one.
    """
    ordered = lambda xs: F.aggregate(F.array_sort(xs), F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    rows = measured.where(F.col(value).isNotNull()).groupBy(grp, patch).agg(F.collect_list(F.col(value).cast("double")).alias("_v"))
    rows = rows.withColumn("_m", ordered(F.col("_v")))
    off = F.when(F.size("_v") > 1, ordered(F.transform("_v", lambda x: F.abs(x - F.col("_m")))))
    tenths = F.floor(F.col("_m") * 10 + 0.5 if parts == 1 else F.col("_m") / (parts / 10) + 0.5)
    return rows.select(grp, patch, (tenths / 10).alias("mean"), (off / parts).alias("off"), F.size("_v").cast("long").alias("prints"))


def uneven_prints(averages: DataFrame, grp: str) -> DataFrame:
    """(grp, spread, uneven): the patches' mean deviation as a share of the range of their means, and whether it exceeds SPREAD."""
    spread = F.avg("off") / F.greatest(F.max("mean") - F.min("mean"), F.lit(1e-9))
    return averages.groupBy(grp).agg(spread.alias("spread")).withColumn("uneven", F.coalesce(F.col("spread") > SPREAD, F.lit(False)))


def curve_rows(points: DataFrame, grp: str, x: str, y: str) -> DataFrame:
    """(grp, x, y): arrays by ascending x, equal ones averaged."""
    means = points.groupBy(grp, x).agg(F.avg(y).alias("_y"))
    rows = means.groupBy(grp).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col("_y").cast("double").alias("y")))).alias("_p"))
    return rows.select(grp, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def response_summary(curves: DataFrame) -> DataFrame:
    """Adds range, inverted and flat: the share of 0..255 that a response covers, whether its first quarter lies more than 8 above its last, and whether it covers less than a tenth; under three points it is flat."""
    part = F.greatest(F.lit(1), F.floor(F.size("y") / 4).cast("int"))
    head, tail = _sum(F.slice("y", F.lit(1), part)) / part, _sum(F.slice("y", F.size("y") - part + 1, part)) / part
    few, span = F.size("y") < 3, (F.array_max("y") - F.array_min("y")) / 255
    return curves.withColumns({"range": F.when(few, 0.0).otherwise(span), "inverted": F.when(few, False).otherwise(head > tail + 8), "flat": F.when(few, True).otherwise(span < 0.1)})


def check_response(curves: DataFrame, least: int = POINTS // 2) -> DataFrame:
    """Adds error, the first that holds of: fewer than `least` patches, inverted, flat; else null."""
    return response_summary(curves).withColumn("error", F.when(F.size("y") < least, "too few patches").when(F.col("inverted"), "inverted").when(F.col("flat"), "flat"))


def chart_lut(curves: DataFrame, points: int = POINTS) -> DataFrame:
    """Adds lut to curves (x, y): smoothed, fitted to rise, interpolated on the fine grid, polished and inverted."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda i: F.lit(255.0) * i / (GRID - 1))

    def fine(iso: Column, x: Column) -> Column:
        step = F.greatest((F.element_at(iso, -1) - F.get(iso, F.lit(0))) * 1e-9, F.lit(1e-12))
        return running_max(polished(running_max(pchip(x, rising(iso, step), grid))))

    return curves.withColumn("lut", let(isotonic(smooth_adaptive(F.col("y"))), lambda iso: inverted(grid, fine(iso, F.col("x")), points)))


def prior_curve(lut: Column) -> Column:
    """A curve that was applied to a chart, cut to 0..255; null if it has not 256 points, an invalid one, or falls by more than a half."""
    whole = (F.size(lut) == POINTS) & F.forall(lut, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    cut = F.transform(lut, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)))
    return F.when(whole, let(cut, lambda c: F.when(F.forall(F.sequence(F.lit(1), F.lit(POINTS - 1)), lambda i: F.get(c, i) >= F.get(c, i - 1) - 0.5), c)))


def lerp256(table: Column, x: Column) -> Column:
    """A table of 256 values at a place between 0 and 255."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(255.0), x.cast("double")))
    i = F.least(F.floor(at).cast("int"), F.lit(254))
    return F.get(table, i) + (F.get(table, i + 1) - F.get(table, i)) * (at - i)


def content_cdf(histogram: Column) -> Column:
    """0..1 over 256 grays: the histogram smoothed with its edges repeated, EVEN of even slope added, summed and stretched."""
    smooth = lambda h: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: _sum(F.transform(F.sequence(i - HISTOGRAM // 2, i + HISTOGRAM // 2), lambda k: F.get(h, F.greatest(F.lit(0), F.least(F.lit(255), k))))) / HISTOGRAM)
    share = lambda s: let(F.greatest(_sum(s), F.lit(1e-12)), lambda all_: F.transform(s, lambda v: (v / all_ + EVEN / 256) / (1 + EVEN)))
    up = lambda s: F.aggregate(s, F.array().cast("array<double>"), lambda a, v: F.concat(a, F.array(v + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))))
    stretch = lambda c: F.transform(c, lambda v: (v - F.get(c, F.lit(0))) / F.greatest(F.element_at(c, -1) - F.get(c, F.lit(0)), F.lit(1e-12)))
    return let(smooth(histogram), lambda s: let(up(share(s)), stretch))


def effective_lut(lut: Column, strength: float, adapt: float, histogram: Column) -> Column:
    """The curve mixed with the identity by strength, read at places moved towards the content's distribution by adapt (both 0..100); null where that changes nothing."""
    a, b = min(100.0, max(0.0, strength)) / 100, min(100.0, max(0.0, adapt)) / 100
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))
    grays = F.sequence(F.lit(0), F.lit(255))
    mixed = F.transform(grays, lambda i: i * (1 - a) + a * F.when(F.size(lut) == POINTS, cut(F.get(lut, i))).otherwise(i.cast("double")))

    def moved(base: Column) -> Column:
        place = lambda c, i: 255 * ((1 - b) * (i / F.lit(255.0)) + b * F.get(c, i))
        def at(x: Column) -> Column:
            low = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x).cast("int")))
            return F.get(base, low) * (1 - (x - low)) + F.get(base, F.least(low + 1, F.lit(255))) * (x - low)
        return let(content_cdf(histogram), lambda c: F.transform(grays, lambda i: let(place(c, i), at)))

    some = histogram.isNotNull() & (_sum(histogram) > 0) if b > 0 else F.lit(False)
    out = let(mixed, lambda base: F.when(some, moved(base)).otherwise(base))
    return let(out, lambda o: F.when(F.exists(F.transform(o, lambda v, i: F.abs(v - i) >= 1e-9), lambda x: x), F.transform(o, cut)))


def patch_curve(measured: Column, levels: Column, target: Column) -> Column:
    """Control points array<struct(x, y)> of one channel: from the patch of the lowest level to that of the highest, those where measured value (by LEAST_GAP) and target both rise; null if fewer than two."""
    order = F.array_sort(F.transform(levels, lambda v, i: F.struct(v.alias("level"), i.alias("i"))))
    points = F.transform(order, lambda o: F.struct(F.get(measured, o["i"]).cast("double").alias("x"), F.get(target, o["i"]).cast("double").alias("y")))
    none = F.array().cast("array<struct<x:double,y:double>>")

    def add(kept: Column, p: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when((F.size(kept) > 0) & ((p["x"] - last["x"] < LEAST_GAP) | (p["y"] <= last["y"])), kept).otherwise(F.concat(kept, F.array(p)))

    return let(F.aggregate(points, none, add), lambda k: F.when(F.size(k) > 1, k))


def level_curve(measured: Column, levels: Column, reference: Column | None = None) -> Column:
    """patch_curve to the printed levels, by the patches of the lowest and the highest level alone; with a reference strip, to that one by all patches."""
    if reference is not None:
        return F.when((F.size(measured) == F.size(levels)) & (F.size(reference) == F.size(levels)), patch_curve(measured, levels, reference))
    ends = F.array(F.array_min(levels), F.array_max(levels))
    at = F.transform(ends, lambda v: F.get(measured, (F.array_position(levels, v) - 1).cast("int")))
    return F.when((F.size(measured) == F.size(levels)) & (F.size(levels) > 1), patch_curve(at, ends, ends))


def on_level_curve(points: Column, v: Column, top: int = 255) -> Column:
    """A value 0..top through control points in 0..255: straight between them, the end segments going on, rounded and cut."""
    scale = top / 255

    def run(p: Column) -> Column:
        i = F.greatest(F.lit(1), F.least(F.size(p) - 1, F.size(F.filter(p, lambda q: q["x"] <= v / scale))))
        a, b = F.get(p, i - 1), F.get(p, i)
        return a["y"] + (v / scale - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])

    return F.when(points.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(top), F.round(let(points, run) * scale))).cast("long"))


def measured_strip(px: DataFrame, grp: str, patch: str, channels: list[str], level: str, top: int = 255) -> DataFrame:
    """(grp, levels, measured): upper medians of a strip's patches by channel, on 0..255, patches by level.

    px: (grp, patch, level, channels) pixels of the patches' middles. measured is null where the lightest patch
    is not CONTRAST above the darkest in every channel.
    """
    median = lambda c: (F.expr(f"percentile_disc(0.5) within group (order by {c} desc)") * 255 / top).cast("double")
    medians = px.groupBy(grp, patch, level).agg(F.array(*[median(c) for c in channels]).alias("_m"))
    strips = medians.groupBy(grp).agg(F.array_sort(F.collect_list(F.struct(F.col(level).alias("l"), F.col(patch).alias("p"), F.col("_m").alias("m")))).alias("_s"))
    low, high = F.get("_s", F.lit(0))["m"], F.element_at("_s", -1)["m"]
    enough = F.forall(F.arrays_zip(low.alias("a"), high.alias("b")), lambda z: z["b"] - z["a"] >= CONTRAST)
    return strips.select(grp, F.col("_s.l").alias("levels"), F.when(enough & (F.size("_s") > 1), F.col("_s.m")).alias("measured"))

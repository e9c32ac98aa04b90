"""Sampling times, sound blocks, colour matrices, sizes and dates as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.operators.timeline import js_round


def sample_times(spans: DataFrame, start: str, end: str, fps: float) -> DataFrame:
    """A row for each instant start + k / fps below end, at least one a span: adds k and t."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil((F.col(end) - 1e-9 - F.col(start)) * fps))
    rows = spans.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.withColumn("t", F.col(start) + F.col("k") / fps)


def sound_time(frame: Column, span_from: Column, span_at: Column, fps: float) -> Column:
    """The source time of an output frame in its kept span (from, and at: its first output frame); without spans the frame's own time."""
    return F.coalesce(span_from + frame - span_at, frame) / fps


def placed_blocks(blocks: DataFrame, asks: DataFrame, grp: str) -> DataFrame:
    """(grp, ask, block, at, from, n): where the samples of sound blocks go that overlap an asked interval.

    blocks: (grp, block, stamp, rate, count); asks: (grp, ask, start, duration), times in seconds. Samples outside the
    interval are left out at both ends, to the sample; what would pass the interval's own sample count too.
    """
    b = blocks.withColumn("_end", F.col("stamp") + F.col("count") / F.col("rate"))
    a = asks.withColumn("_stop", F.col("start") + F.col("duration"))
    met = b.join(a, grp).where((F.col("stamp") < F.col("_stop")) & (F.col("_end") > F.col("start")))
    first = F.when(F.col("stamp") < F.col("start"), js_round((F.col("start") - F.col("stamp")) * F.col("rate"))).otherwise(F.lit(0).cast("long"))
    last = F.when(F.col("_end") > F.col("_stop"), js_round((F.col("_stop") - F.col("stamp")) * F.col("rate"))).otherwise(F.col("count"))
    met = met.withColumns({"from": first, "_to": last, "_all": F.greatest(F.lit(1).cast("long"), js_round(F.col("duration") * F.col("rate")))})
    met = met.withColumn("at", F.greatest(F.lit(0).cast("long"), js_round((F.col("stamp") + F.col("from") / F.col("rate") - F.col("start")) * F.col("rate"))))
    return met.withColumn("n", F.least(F.col("_to") - F.col("from"), F.col("_all") - F.col("at"))).where("n > 0").select(grp, "ask", "block", "at", "from", "n")


def colour_matrix(name: Column, height: Column) -> Column:
    """The matrix by its tag; without a tag by the picture's height, null if that is 0 too or the tag is another."""
    by_height = F.when(height > 576, "bt709").when(height > 0, "bt601")
    return F.when(name == "bt709", "bt709").when(name.isin("bt470bg", "smpte170m"), "bt601").when(name == "bt2020-ncl", "bt2020").when(name.isNull(), by_height)


def encode_size(w: Column, h: Column) -> Column:
    """struct(w, h): the width up to a multiple of 4, the height to one of 2."""
    return F.struct((F.ceil(w / 4) * 4).alias("w"), (h + h % 2).cast("long").alias("h"))


def near(a: Column, b: Column) -> Column:
    """Whether two sizes differ by 4 or a hundredth of the second at most."""
    return F.abs(a - b) <= F.greatest(F.lit(4), F.floor(b / 100))


def fits_budget(w: Column, h: Column, most: int) -> Column:
    """Whether a picture has pixels and no more than so many; no product overflows."""
    return (w > 0) & (h > 0) & (w.cast("decimal(19,0)") * h.cast("decimal(19,0)") <= most)


def bytes_text(n: Column) -> Column:
    """GB and MB with one decimal, else whole KB; decimal units."""
    return F.when(n > 1e9, F.concat(F.format_string("%.1f", n / 1e9), F.lit(" GB"))).when(n > 1e6, F.concat(F.format_string("%.1f", n / 1e6), F.lit(" MB"))).otherwise(F.concat(js_round(n / 1e3).cast("string"), F.lit(" KB")))


def dos_datetime(at: Column) -> Column:
    """struct(time, date) as archives pack them: two-second steps, years from 1980."""
    time = F.shiftleft(F.hour(at), 11).bitwiseOR(F.shiftleft(F.minute(at), 5)).bitwiseOR(F.floor(F.second(at) / 2).cast("int"))
    date = F.shiftleft(F.greatest(F.lit(1980), F.year(at)) - 1980, 9).bitwiseOR(F.shiftleft(F.month(at), 5)).bitwiseOR(F.dayofmonth(at))
    return F.struct(time.cast("long").alias("time"), date.cast("long").alias("date"))


def upscale_factor(w: Column, h: Column, most: int) -> Column:
    """How often a small picture is enlarged so that its short side comes to about 400, within so many pixels; 1 from 360 on."""
    short = F.least(w, h)
    wanted = F.greatest(F.round(F.try_divide(F.lit(400.0), short)).cast("long"), F.lit(2).cast("long"))
    able = F.floor(F.sqrt(F.try_divide(F.lit(float(most)), (w * h).cast("double"))))
    return F.when((short == 0) | (short >= 360), F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.least(wanted, able)))


def size_estimate(df: DataFrame, grp: str, size: str, ratio: Column, deep: Column, untouched: Column) -> DataFrame:
    """(grp, size, any_deep, passthrough): estimated size by each row's ratio, whether any row is deep, how many pass untouched."""
    return df.groupBy(grp).agg(F.sum(F.col(size) * ratio).alias("size"), F.bool_or(deep).alias("any_deep"), F.count_if(untouched).alias("passthrough"))


def pages_in_flight(pages: DataFrame, grp: str, pixels: str, bytes_a_pixel: float, budget: int) -> DataFrame:
    """(grp, peak, pages): bytes of the largest page, and how many such fit the budget, one at least."""
    peak = F.max(F.col(pixels) * bytes_a_pixel)
    return pages.groupBy(grp).agg(peak.alias("peak")).withColumn("pages", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("peak"))))


def range_problem(start: Column, end: Column, duration: Column) -> Column:
    """Null for a range of finite ends in order, else what is wrong with it; a length that is null or 0 is not told."""
    finite = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    told = lambda v: F.when(finite(v), F.format_string("%.2f s", v)).otherwise("no number")
    length = F.when(duration != 0, F.format_string("; the video lasts %.2f s", duration)).otherwise("")
    return F.when(~(finite(start) & finite(end) & F.coalesce(end > start, F.lit(False))), F.concat(F.lit("the range from "), told(start), F.lit(" to "), told(end), F.lit(" is empty"), length))


#: Fixed: bytes that a scan's file grows to by its kind, growth beside a graphics processor and without, share of memory for scans, least and largest bleed in percent, bleed where none is told.
GROWTH, BESIDE, WITHOUT, SHARE, LEAST_BLEED, LARGEST_BLEED, BLEED = (12.0, 2.5, 5.0), 2.2, 3.5, 0.3, -100.0, 20.0, 1.5


def bleed_growth(percent: Column) -> Column:
    """How much more a scan takes for a negative bleed: a quarter of the area that its crops gain."""
    share = F.greatest(F.lit(LEAST_BLEED), F.least(F.lit(LARGEST_BLEED), F.coalesce(percent, F.lit(BLEED)))) / 100
    side = 1 - 2 * share
    return F.when(share < 0, 1 + (side * side - 1) * 0.25).otherwise(1.0)


def scan_peak(name: Column, size: Column, graphics: Column, bleed: Column) -> Column:
    """Estimated bytes that a scan takes at its peak, by its file's kind and size."""
    ratio = F.when(F.lower(name).rlike(r"\.(jpe?g|webp)$"), GROWTH[0]).when(F.lower(name).rlike(r"\.tiff?$"), GROWTH[1]).otherwise(GROWTH[2])
    return size * ratio * F.when(graphics, BESIDE).otherwise(WITHOUT) * bleed_growth(bleed)


def header_peak(w: Column, h: Column, deep: Column, bleed: Column) -> Column:
    """The same by the size and depth in a scan's header: two copies and a quarter around them."""
    return w * h * F.when(deep, 6).otherwise(3) * 2.5 * bleed_growth(bleed)


def scans_at_once(scans: DataFrame, grp: str, peak: str, memory_gb: float, workers: int, told: bool, single: str) -> DataFrame:
    """(grp, at_once): scans that fit a share of the memory, up to the workers and the scans, three if the memory is a guess; one where a group is a single sheet."""
    worst = F.greatest(F.lit(1.0), F.max(peak))
    most = F.least(F.greatest(F.lit(1).cast("long"), F.floor(F.lit(memory_gb * 1e9 * SHARE) / worst)), F.lit(workers).cast("long"), F.count("*"), F.lit(workers if told else 3).cast("long"))
    return scans.groupBy(grp).agg(F.when(F.bool_or(single), F.lit(1).cast("long")).otherwise(most).alias("at_once"))

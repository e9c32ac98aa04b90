"""Detected markers against a layout: correspondences, projections, residuals, covers and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.operators.robust import upper_median

#: Fixed: corners and error (px; mm times px a mm) from which a local shift is worth while, and the share of a sheet that markers should span.
LEAST_POINTS, LEAST_PX, LEAST_MM, LEAST_COVER = 16, 0.75, 0.15, 0.25


def first_detected(found: DataFrame, expected: DataFrame, scan: str, marker: str, *order: str) -> DataFrame:
    """Detections of expected markers, the first of each marker of a scan."""
    rows = found.join(expected.select(marker).distinct(), marker, "left_semi")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(scan, marker).orderBy(*order))).where("_n = 1").drop("_n")


def corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box's corners, clockwise from the top left, as array<struct(x, y)>."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])


def correspondences(found: DataFrame, layout: DataFrame, marker: str, scale: float) -> DataFrame:
    """A row for each corner of each detected marker that the layout has: adds corner, sx, sy (measured) and lx, ly (layout, scaled).

    found: (…, marker, corners); layout: (marker, x1, y1, x2, y2).
    """
    box = layout.select(marker, corners(*[F.col(c) * scale for c in ("x1", "y1", "x2", "y2")]).alias("_b"))
    rows = found.join(box, marker).select(*[c for c in found.columns if c != "corners"], F.posexplode(F.arrays_zip(F.col("corners").alias("s"), F.col("_b").alias("l"))).alias("corner", "_p"))
    return rows.select("*", *[F.col(f"_p.{a}.{c}").alias(f"{a}{c}") for a in "sl" for c in "xy"]).drop("_p")


def projected(h: list[float], x: Column, y: Column) -> Column:
    """struct(x, y) of a point under a 3 x 3 map by rows; a vanishing denominator counts as 1e-12."""
    d = h[6] * x + h[7] * y + h[8]
    d = F.when(F.abs(d) < 1e-12, F.lit(1e-12)).otherwise(d)
    return F.struct(((h[0] * x + h[1] * y + h[2]) / d).alias("x"), ((h[3] * x + h[4] * y + h[5]) / d).alias("y"))


def inverse(h: Column) -> Column:
    """The inverse of a 3 x 3 map by rows, null if its determinant is below 1e-12."""
    e = [F.get(h, F.lit(i)) for i in range(9)]
    minor = lambda a, b, c, d: e[a] * e[d] - e[b] * e[c]
    adj = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
    det = e[0] * adj[0] + e[1] * adj[3] + e[2] * adj[6]
    return F.when(F.abs(det) >= 1e-12, F.transform(F.array(*adj), lambda x: x / det))


def product(a: Column, b: Column) -> Column:
    """The product of two 3 x 3 maps by rows."""
    return F.array(*[sum((F.get(a, F.lit(3 * i + k)) * F.get(b, F.lit(3 * k + j)) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)])


def corner_residuals(pairs: DataFrame, h: list[float]) -> DataFrame:
    """Adds ex, ey and error to correspondences: where the map puts the measured corner, less where the layout has it."""
    rows = pairs.withColumn("_q", projected(h, F.col("sx"), F.col("sy")))
    rows = rows.withColumns({"ex": F.col("_q.x") - F.col("lx"), "ey": F.col("_q.y") - F.col("ly")}).drop("_q")
    return rows.withColumn("error", F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")))


def worth_shifting(residuals: DataFrame, grp: str, px_mm: float) -> DataFrame:
    """(grp, points, median, worth): a local shift needs LEAST_POINTS corners and an upper median error of LEAST_MM, or LEAST_PX if that is more."""
    rows = residuals.groupBy(grp).agg(F.count("*").alias("points"), upper_median("error").alias("median"))
    return rows.withColumn("worth", (F.col("points") >= LEAST_POINTS) & (F.col("median") >= max(LEAST_MM * px_mm, LEAST_PX)))


def cover(pairs: DataFrame, grp: str, page_w: float, page_h: float) -> DataFrame:
    """(grp, cover, small): the share of the page that the layout places span, and whether it is too small."""
    span = (F.max("lx") - F.min("lx")) * (F.max("ly") - F.min("ly")) / max(1.0, page_w * page_h)
    return pairs.groupBy(grp).agg(span.alias("cover")).withColumn("small", F.col("cover") < LEAST_COVER)


def resolved_markers(sheets: DataFrame, boxes: DataFrame, sheet: str, ids: str, place: str = "place") -> DataFrame:
    """(marker, sheet, place, box columns): the box of each marker id, its place in the sheet's list giving the box; of sheets that share an id the last wins.

    Ids of places without a box are left out.
    """
    listed = sheets.select(sheet, F.posexplode(ids).alias(place, "marker"))
    last = listed.groupBy("marker").agg(F.max_by(F.struct(sheet, place), F.struct(sheet, place)).alias("_l")).select("marker", f"_l.{sheet}", F.col(f"_l.{place}").cast("long").alias(place))
    return last.join(boxes, place)


def sheet_by_number(asks: DataFrame, sheets: DataFrame, number: str, *order: str) -> DataFrame:
    """Asks joined with the first sheet that has their number."""
    first = sheets.withColumn("_n", F.row_number().over(W.partitionBy(number).orderBy(*order))).where("_n = 1").drop("_n")
    return asks.join(first, number)


def polygon_area(points: Column) -> Column:
    """Area inside array<struct(x, y)>, whichever way round it goes."""
    n = F.size(points)
    turn = lambda i: F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"]
    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + turn(i))) / 2


def is_convex(points: Column) -> Column:
    """Whether all turns of a polygon go the same way; straight ones go either way."""
    n = F.size(points)

    def turn(i: Column) -> Column:
        a, b, c = (F.get(points, (i + k) % n) for k in range(3))
        return F.signum((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))

    ways = F.transform(F.sequence(F.lit(0), n - 1), turn)
    return ~(F.exists(ways, lambda s: s > 0) & F.exists(ways, lambda s: s < 0))

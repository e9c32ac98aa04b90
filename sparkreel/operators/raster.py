"""Small rasters as rows (img, x, y, gray), and the kernels that read whole neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pixels(df: DataFrame, img: str, values: str, width: int) -> DataFrame:
    """A row for each value of an array, min-max scaled to whole grays 0..255; flat images are 0. The range is found inside the row."""
    rows = df.select(F.col(img).alias("img"), values, F.array_min(values).cast("double").alias("low"), F.array_max(values).cast("double").alias("high"))
    rows = rows.select("img", "low", "high", F.posexplode(values).alias("i", "v"))
    gray = F.when(F.col("high") > F.col("low"), F.floor((F.col("v").cast("double") - F.col("low")) * 255 / (F.col("high") - F.col("low")) + 0.5)).otherwise(F.lit(0)).cast("long")
    return rows.select("img", (F.col("i") % width).cast("long").alias("x"), F.floor(F.col("i") / width).alias("y"), gray.alias("gray"))


def stretched(px: DataFrame, img: str = "img", gray: str = "gray") -> DataFrame:
    """Grays min-max scaled to whole 0..255 for each image, half up; a flat image stays as it is. The range travels, not the pixels."""
    span = px.groupBy(img).agg(F.min(gray).alias("_low"), F.max(gray).alias("_high"))
    scaled = F.floor((F.col(gray) - F.col("_low")) * 255 / (F.col("_high") - F.col("_low")) + 0.5)
    return px.join(span, img).withColumn(gray, F.when(F.col("_high") > F.col("_low"), scaled).otherwise(F.col(gray)).cast("long")).drop("_low", "_high")


def histogram(px: DataFrame, *by: str) -> DataFrame:
    """(by, gray, n) of all 256 grays."""
    counts = px.groupBy(*by, "gray").agg(F.count("*").alias("n"))
    all_ = px.select(*by).distinct() if by else px.sparkSession.range(1).select()
    full = all_.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(255).cast("long"))).alias("gray"))
    return full.join(counts, [*by, "gray"], "left").na.fill(0, ["n"])


def otsu(hist: DataFrame, img: str = "img") -> DataFrame:
    """(img, threshold): the lowest gray of largest between-class variance, to 6 decimals."""
    up, whole = W.partitionBy(img).orderBy("gray").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(img)
    rows = hist.select(img, "gray", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("gray")).over(up).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("gray")).over(whole).alias("s"))
    rows = rows.where("w0 > 0 and w0 < w")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    rows = rows.withColumn("var", F.round(F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * gap * gap, 6))
    return rows.groupBy(img).agg(F.max_by("gray", F.struct("var", -F.col("gray"))).alias("threshold"))


def box_mean(px: DataFrame, radius: int, line: str = "y", along: str = "x") -> DataFrame:
    """Adds mean: moving mean along a line, the ends repeated beyond the edges."""
    w = W.partitionBy("img", line).orderBy(along)
    inner, whole = w.rowsBetween(-radius, radius), W.partitionBy("img", line)
    left = F.greatest(F.lit(0), radius - F.col(along))
    right = F.greatest(F.lit(0), F.col(along) + radius - F.max(along).over(whole))
    first, last = F.first("gray").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.last("gray").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return px.withColumn("mean", (F.sum("gray").over(inner) + left * first + right * last) / (2 * radius + 1))


def area_mean(px: DataFrame, factor: int) -> DataFrame:
    """Means of factor x factor cells."""
    return px.groupBy("img", F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y")).agg(F.avg("gray").alias("gray"))


def flipped(px: DataFrame, width: int) -> DataFrame:
    return px.withColumn("x", width - 1 - F.col("x"))


def cropped(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    return px.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def reflected(i: Column, n: int) -> Column:
    """Any index brought into 0..n-1 by reflection at the edges, edges repeated."""
    m = F.pmod(i, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def blurred(px: DataFrame, sigma: float) -> DataFrame:
    """(img, x, y, mean, gray): three moving means along rows and columns, of radius 1.5 sigma rounded, 1 at least; 0 or less changes nothing.

    Rows are shuffled once, by picture: all six windows lie inside a picture.
    """
    radius, rows = max(1, int(sigma * 1.5 + 0.5)), px.select("img", "x", "y", F.col("gray").cast("double").alias("gray"))
    if sigma > 0:
        rows = rows.repartition("img")
        for line, along in (("y", "x"), ("x", "y")) * 3:
            rows = box_mean(rows, radius, line, along).select("img", "x", "y", F.col("mean").alias("gray"))
    whole = F.least(F.greatest(F.floor(F.col("gray") + 0.5), F.lit(0)), F.lit(255)).cast("long")
    return rows.select("img", "x", "y", F.col("gray").alias("mean"), whole.alias("gray"))


def darker_than_around(px: DataFrame, window: int, c: float) -> DataFrame:
    """Grays 255 where a pixel is more than c below the mean of the window around it, else 0."""
    radius = max(1, window // 2)
    rows = px.select("img", "x", "y", F.col("gray").alias("_own"), F.col("gray").cast("double").alias("gray")).repartition("img")
    for line, along in (("y", "x"), ("x", "y")):
        rows = box_mean(rows, radius, line, along).withColumn("gray", F.col("mean")).drop("mean")
    return rows.select("img", "x", "y", F.when(F.col("_own") < F.round(F.col("gray") - c, 9), 255).otherwise(0).cast("long").alias("gray"))


def _inside(x1: int, y1: int, x2: int, y2: int) -> Column:
    return F.col("x").between(x1, x2 - 1) & F.col("y").between(y1, y2 - 1)


def filled(px: DataFrame, x1: int, y1: int, x2: int, y2: int, gray: int) -> DataFrame:
    """The pixels with a rectangle (its far ends left out) in one gray; what of it lies outside does nothing."""
    return px.withColumn("gray", F.when(_inside(x1, y1, x2, y2), F.lit(gray).cast("long")).otherwise(F.col("gray")))


def stroked(px: DataFrame, x1: int, y1: int, x2: int, y2: int, width: int, gray: int) -> DataFrame:
    """The pixels with a frame of that width along the inside of a rectangle."""
    sides = ((x1, y1, x2, y1 + width), (x1, y2 - width, x2, y2), (x1, y1, x1 + width, y2), (x2 - width, y1, x2, y2))
    for side in sides:
        px = filled(px, *side, gray)
    return px


def pasted(px: DataFrame, top: DataFrame, x: int, y: int) -> DataFrame:
    """The pixels with another picture of the same img laid over at (x, y); what reaches beyond is cut."""
    over = top.select("img", (F.col("x") + x).alias("x"), (F.col("y") + y).alias("y"), F.col("gray").alias("_over"))
    return px.join(over, ["img", "x", "y"], "left").withColumn("gray", F.coalesce("_over", "gray")).drop("_over")


def inverted(gray: Column) -> Column:
    return 255 - gray


def widened(gray: Column) -> Column:
    """8 bits as 16: black and white stay so."""
    return gray * 257


def narrowed(gray: Column) -> Column:
    """The high byte of 16 bits."""
    return F.shiftright(gray, 8)

"""Video planes of more than 8 bits to 16-bit colours: grids of different resolution joined, turned as their metadata say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the standards: shares of red and blue in the luma of each matrix.
WEIGHTS = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}
#: Steps of the colour planes across and down by format.
STEPS = {"I420": (2, 2), "I422": (2, 1), "I444": (1, 1)}


def plane(frames: DataFrame, w: int, h: int, offset: Column, stride: Column, value: str, img: str = "img", data: str = "data") -> DataFrame:
    """(img, x, y, value) of a plane of 16-bit little-endian samples; a plane that the data do not hold, or a stride under a row, is an error."""
    end = offset + (h - 1) * stride + 2 * w
    fits = F.when(stride < 2 * w, F.raise_error(F.lit("a plane's stride is shorter than its row"))).when(end > F.octet_length(data), F.raise_error(F.lit("a plane ends behind the frame's data"))).otherwise(True)
    rows = frames.where(fits).select(img, F.col(data).alias("_d"), offset.alias("_o"), stride.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("_i"))
    rows = rows.withColumns({"x": (F.col("_i") % w).cast("long"), "y": F.floor(F.col("_i") / w)})
    at = (F.col("_o") + F.col("y") * F.col("_s") + F.col("x") * 2).cast("int")
    byte = lambda k: F.conv(F.hex(F.substring("_d", at + k, F.lit(1))), 16, 10).cast("long")
    return rows.select(img, "x", "y", (byte(1) + byte(2) * 256).alias(value))


def _near(at: Column, n: int) -> tuple[Column, Column, Column]:
    """The places below and above a point of a side of n, and its way to the upper one."""
    low = F.floor(at)
    return low, F.least(low + 1, F.lit(n - 1)), at - low


def rgb16(luma: DataFrame, chroma: DataFrame, w: int, h: int, chroma_format: str, bits: int, matrix: str, full: bool, img: str = "img") -> DataFrame:
    """(img, x, y, r, g, b) of 16 bits from luma (img, x, y, luma) and colour samples (img, x, y, u, v) of a coarser grid.

    Colours between samples are bilinear: a sample stands at the left pixel of its pair, and in the middle of two rows.
    Values beyond the largest code count as that; the narrow range has black at 16 and white at 235 of 255.
    """
    sx, sy = STEPS[chroma_format]
    cw, ch = -(-w // sx), -(-h // sy)
    top, unit = (1 << bits) - 1, 1 << (bits - 8)
    x0, x1, ax = _near(F.col("x") / sx, cw)
    y0, y1, ay = _near(F.greatest((F.col("y") + 0.5) / 2 - 0.5, F.lit(0.0)) if sy == 2 else F.col("y").cast("double"), ch)
    around = F.array(*[F.struct(i.alias("cx"), j.alias("cy"), (u * v).alias("weight")) for i, u in ((x0, 1 - ax), (x1, ax)) for j, v in ((y0, 1 - ay), (y1, ay))])
    rows = luma.select(img, "x", "y", "luma", F.explode(around).alias("n")).select(img, "x", "y", "luma", "n.*").where("weight > 0")
    code = lambda c: F.least(F.col(c), F.lit(top))
    seen = chroma.select(img, F.col("x").alias("cx"), F.col("y").alias("cy"), code("u").alias("u"), code("v").alias("v"))
    rows = rows.join(seen, [img, "cx", "cy"]).groupBy(img, "x", "y", "luma").agg(F.sum(F.col("u") * F.col("weight")).alias("u"), F.sum(F.col("v") * F.col("weight")).alias("v"))
    black, white, middle, colour = (0.0, float(top), float(1 << (bits - 1)), float(top)) if full else (16.0 * unit, 219.0 * unit, 128.0 * unit, 224.0 * unit)
    y, cb, cr = (code("luma") - black) / white, (F.col("u") - middle) / colour, (F.col("v") - middle) / colour
    kr, kb = WEIGHTS[matrix]
    kg = 1 - kr - kb
    red, blue = 2 * (1 - kr), 2 * (1 - kb)
    whole = lambda v: F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 65535, 6) + 0.5).cast("long")
    return rows.select(img, "x", "y", whole(y + red * cr).alias("r"), whole(y - blue * kb / kg * cb - red * kr / kg * cr).alias("g"), whole(y + blue * cb).alias("b"))


def turned(px: DataFrame, w: int, h: int, degrees: Column) -> DataFrame:
    """The pixels of pictures of w by h turned clockwise by 0, 90, 180 or 270 degrees; another number is an error."""
    x, y = F.col("x"), F.col("y")
    place = (
        F.when(degrees == 0, F.struct(x.alias("x"), y.alias("y")))
        .when(degrees == 90, F.struct((h - 1 - y).alias("x"), x.alias("y")))
        .when(degrees == 180, F.struct((w - 1 - x).alias("x"), (h - 1 - y).alias("y")))
        .when(degrees == 270, F.struct(y.alias("x"), (w - 1 - x).alias("y")))
        .otherwise(F.raise_error(F.concat(F.lit("no turn of "), degrees.cast("string"), F.lit(" degrees"))))
    )
    return px.withColumn("_p", place).withColumns({"x": F.col("_p.x").cast("long"), "y": F.col("_p.y").cast("long")}).drop("_p")

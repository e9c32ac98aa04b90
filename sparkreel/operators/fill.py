"""Filling what a crop or a scan leaves empty, over rasters as rows (img, x, y, gray).

Pixels that the scan did not reach are rows that are missing: drop them with covers() first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.operators.raster import reflected
from sparkreel.operators.robust import upper_median

MODES, LEGACY = ("paper", "mirror", "tile"), "legacy"

#: Fixed by the method: the border band that tells the paper's colour begins and ends at these shares of the short side.
SKIP, BAND = 0.005, 0.03


def covers(x: Column, y: Column, inverse: tuple[float, ...], w: int, h: int) -> Column:
    """Whether the inverse homography (nine numbers by rows) takes a point into a scan of w x h."""
    a, b, c, d, e, f, g, i, j = map(F.lit, inverse)
    below = g * x + i * y + j
    sx, sy = F.try_divide(a * x + b * y + c, below), F.try_divide(d * x + e * y + f, below)
    return F.coalesce(sx.between(0, w - 1) & sy.between(0, h - 1), F.lit(False))


def paper(px: DataFrame, w: int, h: int, white: int = 255) -> DataFrame:
    """(img, paper): the upper median of a band along the edges, from 0.5 to 3 % of the short side; white where no pixel is in it."""
    short = max(1, min(w, h))
    skip, step = int(short * SKIP), max(1, short // 400)
    band = max(int(short * BAND), skip + 4)
    edge = F.least("x", "y", w - 1 - F.col("x"), h - 1 - F.col("y"))
    picked = (edge >= skip) & (edge < band) & (F.col("x") % step == 0) & (F.col("y") % step == 0)
    seen = px.select("img", F.when(picked, F.col("gray")).alias("_edge"))
    return seen.groupBy("img").agg(F.coalesce(upper_median("_edge"), F.lit(white)).cast("long").alias("paper"))


def crop_filled(px: DataFrame, w: int, h: int, x: int, y: int, cw: int, ch: int, mode: str, white: int = 255) -> DataFrame:
    """(img, x, y, gray): a crop of cw x ch from (x, y), which may reach beyond the picture's w x h.

    Outside, mirror reflects at the edges with the edges repeated, tile starts anew, paper shows the
    paper; a pixel without data shows the paper in every mode. With mode legacy what is outside is white, what
    has no data black. One join by picture and place.
    """
    if mode not in (*MODES, LEGACY):
        raise ValueError(f"mode must be one of {MODES} or {LEGACY}")
    side = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asks = paper(px, w, h, white).select("*", side(cw).alias("dx")).select("*", side(ch).alias("dy"))
    at = {"sx": (F.col("dx") + x, w), "sy": (F.col("dy") + y, h)}
    if mode == "mirror":
        asks = asks.withColumns({k: reflected(i, n) for k, (i, n) in at.items()})
    elif mode == "tile":
        asks = asks.withColumns({k: F.pmod(i, F.lit(n)) for k, (i, n) in at.items()})
    else:
        asks = asks.withColumns({k: i for k, (i, _) in at.items()})
    held = px.where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1)).select("img", F.col("x").alias("sx"), F.col("y").alias("sy"), "gray")
    inside = F.col("sx").between(0, w - 1) & F.col("sy").between(0, h - 1)
    empty = F.when(inside, F.lit(0)).otherwise(F.lit(white)).cast("long") if mode == LEGACY else F.col("paper")
    return asks.join(held, ["img", "sx", "sy"], "left").select("img", F.col("dx").alias("x"), F.col("dy").alias("y"), F.coalesce("gray", empty).alias("gray"))


def fill_mode(name: str | None) -> str:
    """The mode that a settings file names; any other name is the old way."""
    return name if name in MODES else LEGACY


def erased(px: DataFrame, rects: DataFrame, w: int, h: int, white: int = 255) -> DataFrame:
    """The pixels with every rectangle (img, ord, x1, y1, x2, y2) painted in the colour around it.

    A rectangle is widened by 15 % of its short side and two pixels; its colour is the upper median of
    a ring of 25 % (three pixels at least) around that, the picture's paper where the ring is empty. Rings are read before
    anything is painted; of overlapping rectangles the one of highest ord shows. A picture has a
    few dozen rectangles: they join its pixels as one array.
    """
    side = F.greatest(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.lit(1.0))
    pad, ring = side * 0.15 + 2, F.greatest(side * 0.25, F.lit(3.0))
    whole = lambda v, n: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n))) + 0.5)
    box = lambda p: [whole(F.col("x1") - p, w), whole(F.col("y1") - p, h), whole(F.col("x2") + p, w), whole(F.col("y2") + p, h)]
    names = ("a", "b", "c", "d")
    marks = rects.select("img", F.struct("ord", F.struct(*[v.alias(k) for k, v in zip(names, box(pad))]).alias("inner"), F.struct(*[v.alias(k) for k, v in zip(names, box(pad + ring))]).alias("outer")).alias("r"))
    marks = marks.where("r.inner.c > r.inner.a and r.inner.d > r.inner.b")
    lists = marks.groupBy("img").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    within = lambda b: (F.col("x") >= b["a"]) & (F.col("x") < b["c"]) & (F.col("y") >= b["b"]) & (F.col("y") < b["d"])
    rows = px.join(lists, "img", "left")
    ringed = rows.select("img", "gray", F.explode(F.filter("rs", lambda r: within(r["outer"]) & ~within(r["inner"]))).alias("r"))
    tones = ringed.groupBy("img", F.col("r.ord").alias("ord")).agg(upper_median("gray").cast("long").alias("tone"))
    tones = tones.groupBy("img").agg(F.map_from_entries(F.collect_list(F.struct("ord", "tone"))).alias("tones"))
    out = rows.join(tones, "img", "left").join(paper(px, w, h, white), "img")
    over = F.try_element_at(F.filter("rs", lambda r: within(r["inner"])), F.lit(-1))
    hit = F.exists("rs", lambda r: within(r["inner"]))
    painted = F.when(hit, F.coalesce(F.try_element_at("tones", over["ord"]), F.col("paper"))).otherwise(F.col("gray"))
    return out.select("img", "x", "y", painted.alias("gray"))

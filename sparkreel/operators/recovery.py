"""Markers that detection missed, looked for where the others say they must be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.operators import points
from sparkreel.session import spread

#: Markers that a scan must have before others are looked for; part of a cell's side that is sampled, in its middle.
LEAST, INNER = 3, 0.6


def lost(expected: DataFrame, found: DataFrame, maps: DataFrame) -> DataFrame:
    """Expected markers (scan, marker, x1, y1, x2, y2) that were not found in scans with LEAST others, with the scan's map h from layout to scan."""
    enough = found.select("scan", "marker").distinct().groupBy("scan").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST).select("scan")
    return expected.join(found.select("scan", "marker"), ["scan", "marker"], "left_anti").join(enough, "scan").join(maps.select("scan", "h"), "scan")


def sampled_cells(quads: DataFrame, px: DataFrame, cells: int, samples: int, shifts: list[tuple[float, float]]) -> DataFrame:
    """(scan, marker, shift, cell, mean) of markers of `cells` by `cells`: the mean of samples x samples points in each cell's middle.

    quads: (scan, marker, x1, y1, x2, y2, h); px: (scan, x, y, gray). Points go through the map and by each shift, in
    scan pixels; between pixels grays are bilinear. A cell with a point outside the scan has no row.
    """
    some = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = spread(quads, "scan", "marker").withColumn("_k", some(cells * cells * samples * samples)).withColumn("cell", F.floor(F.col("_k") / (samples * samples)))
    i = F.col("_k") % (samples * samples)
    part = lambda cell, k: (cell + (1 - INNER) / 2 + INNER * (k + 0.5) / samples) / cells
    u, v = part(F.col("cell") % cells, i % samples), part(F.floor(F.col("cell") / cells), F.floor(i / samples))
    rows = rows.withColumn("_p", points.projected([F.get("h", F.lit(j)) for j in range(9)], F.col("x1") + u * (F.col("x2") - F.col("x1")), F.col("y1") + v * (F.col("y2") - F.col("y1"))))
    moved = F.array(*[F.struct(F.lit(n).alias("shift"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy")) for n, (dx, dy) in enumerate(shifts)])
    rows = rows.select("scan", "marker", "cell", "_p", F.explode(moved).alias("m")).select("scan", "marker", "cell", "m.shift", (F.col("_p.x") + F.col("m.dx")).alias("_x"), (F.col("_p.y") + F.col("m.dy")).alias("_y"))
    fx, fy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
    near = F.array(*[F.struct((F.floor("_x") + a).alias("x"), (F.floor("_y") + b).alias("y"), (wx * wy).alias("weight")) for a, wx in ((0, 1 - fx), (1, fx)) for b, wy in ((0, 1 - fy), (1, fy))])
    rows = rows.select("scan", "marker", "cell", "shift", F.explode(near).alias("n")).select("scan", "marker", "cell", "shift", "n.*").where("weight > 0")
    # a table of pixels may look small to the planner when it is made of few rows, and must not go through the driver
    rows = rows.join(px.select("scan", "x", "y", "gray").hint("merge"), ["scan", "x", "y"])
    means = rows.groupBy("scan", "marker", "shift", "cell").agg(F.sum(F.col("gray") * F.col("weight")).alias("_s"), F.sum("weight").alias("_w"))
    return means.where(F.abs(F.col("_w") - samples * samples) < 1e-6).select("scan", "marker", "shift", "cell", (F.col("_s") / F.col("_w")).alias("mean"))


def recovered(cells: DataFrame, codes: DataFrame, modules: int, allowed: int, bad_border: float) -> DataFrame:
    """(scan, marker, shift, errors) of the lost markers that stand where they were expected.

    cells: sampled_cells() of modules + 2 cells a side; codes: (marker, code), bit modules * row + column being white.
    A cell is white above the middle of its marker's darkest and lightest one, which must be 30 grays apart; no more
    than `bad_border` of the cells around the code may be white, and `allowed` bits may differ from its own code. Of
    several shifts the one with the fewest errors counts, then the first.
    """
    side = modules + 2
    grid = cells.groupBy("scan", "marker", "shift").agg(F.map_from_entries(F.collect_list(F.struct("cell", "mean"))).alias("m"), F.min("mean").alias("_low"), F.max("mean").alias("_high"), F.count("*").alias("_n"))
    grid = grid.where((F.col("_n") == side * side) & (F.col("_high") - F.col("_low") >= 30)).withColumn("_cut", (F.col("_low") + F.col("_high")) / 2)
    white = lambda r, c: (F.element_at("m", F.lit(r * side + c).cast("long")) > F.col("_cut")).cast("int")
    rim = [(r, c) for r in range(side) for c in range(side) if r in (0, side - 1) or c in (0, side - 1)]
    border: Column = sum((white(r, c) for r, c in rim), F.lit(0))
    code: Column = sum((white(r + 1, c + 1) * (1 << (modules * r + c)) for r in range(modules) for c in range(modules)), F.lit(0))
    read = grid.select("scan", "marker", "shift", border.alias("_rim"), code.cast("long").alias("_code")).where(F.col("_rim") <= bad_border * len(rim))
    read = read.join(codes.select("marker", "code"), "marker").withColumn("errors", F.bit_count(F.col("_code").bitwiseXOR(F.col("code").cast("long"))).cast("long")).where(F.col("errors") <= allowed)
    best = read.groupBy("scan", "marker").agg(F.min(F.struct("errors", "shift")).alias("b"))
    return best.select("scan", "marker", F.col("b.shift").cast("long").alias("shift"), F.col("b.errors").alias("errors"))

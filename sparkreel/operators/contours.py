"""Contours of thresholded rasters and the polygons in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.functions import borders
from sparkreel.operators import points

_POINTS = "array<struct<x: double, y: double>>"


def packed_rows(px: DataFrame, on: Column, w: int, h: int, img: str = "img") -> DataFrame:
    """(img, w, h, bits): whether each place of a raster is on, in page order, a raster a row."""
    places = px.where(on & F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1)).groupBy(img).agg(F.collect_set((F.col("y") * w + F.col("x")).cast("int")).alias("bits"))
    return px.select(img).distinct().join(places, img, "left").select(img, F.lit(w).alias("w"), F.lit(h).alias("h"), F.coalesce("bits", F.array().cast("array<int>")).alias("bits"))


def _points(line: list[tuple[int, int]]) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in line]


def contours(rasters: DataFrame, most: float, img: str = "img") -> DataFrame:
    """(img, contour, line, corners, area, convex) of every border in rasters (img, w, h, bits: places that are on).

    contour counts from 0 in the order of the borders' first places; line is the border place by place, corners are
    what is left of it within a distance of `most`. Holes have borders too; a border of fewer than four places has no row.
    """
    kind = rasters.schema[img].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for i, w, h, bits in zip(pdf[img], pdf["w"], pdf["h"], pdf["bits"], strict=True):
                on = np.zeros(int(w) * int(h), bool)
                on[np.asarray(bits, np.int64)] = True
                for n, line in enumerate(borders.borders(on.reshape(int(h), int(w)))):
                    out.append((i, n, _points(line), _points(borders.simplified(line, most))))
            yield pd.DataFrame(out, columns=[img, "contour", "line", "corners"])

    found = rasters.select(img, "w", "h", "bits").mapInPandas(run, f"{img} {kind}, contour long, line {_POINTS}, corners {_POINTS}")
    return found.withColumn("area", points.polygon_area(F.col("corners"))).withColumn("convex", points.is_convex(F.col("corners")))


def quadrilaterals(found: DataFrame, least_area: float) -> DataFrame:
    """Contours that may be markers: four corners, convex, of at least this area."""
    return found.where((F.size("corners") == 4) & F.col("convex") & (F.col("area") >= least_area))

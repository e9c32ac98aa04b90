"""Projective maps between point tables: sums of products as aggregates, robust ones from many samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from sparkreel.functions import samples
from sparkreel.session import spread

#: Rounds of samples, those tried at once, share of the limit below which the mean distance under a map ends the search.
ROUNDS, CHUNK, CLOSE = 2000, 250, 0.01


def product_sums(pairs: DataFrame, grp: str) -> DataFrame:
    """(grp, n, ts, td, sums): the 81 sums of products of the direct linear transform over a group's point pairs (x, y, u, v).

    Points are first moved and scaled, from (x, y) by the 3 x 3 map ts and (u, v) by td, so that their centre
    is 0 and their mean distance from it the root of 2.
    """
    centre = pairs.groupBy(grp).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"_{c}") for c in "xyuv"])
    rows = pairs.join(centre, grp)
    away = lambda a, b: F.avg(F.sqrt((F.col(a) - F.col(f"_{a}")) * (F.col(a) - F.col(f"_{a}")) + (F.col(b) - F.col(f"_{b}")) * (F.col(b) - F.col(f"_{b}"))))
    scale = rows.groupBy(grp).agg(away("x", "y").alias("_ds"), away("u", "v").alias("_dd"))
    size = lambda d: F.when(F.col(d) > 1e-12, F.sqrt(F.lit(2.0)) / F.col(d)).otherwise(1.0)
    norm = centre.join(scale, grp).withColumns({"_s": size("_ds"), "_t": size("_dd")})
    rows = pairs.join(norm, grp)
    x, y, u, v = ((F.col(c) - F.col(f"_{c}")) * F.col(s) for c, s in zip("xyuv", ("_s", "_s", "_t", "_t"), strict=True))
    one, none = F.lit(1.0), F.lit(0.0)
    first, second = [-x, -y, -one, none, none, none, u * x, u * y, u], [none, none, none, -x, -y, -one, v * x, v * y, v]
    sums = {(i, j): F.sum(first[i] * first[j] + second[i] * second[j]) for i in range(9) for j in range(i, 9)}
    found = rows.groupBy(grp).agg(*[s.alias(f"_{i}{j}") for (i, j), s in sums.items()])
    whole = F.array(*[F.col(f"_{min(i, j)}{max(i, j)}") for i in range(9) for j in range(9)])
    place = lambda s, a, b: F.array(F.col(s), none, -F.col(s) * F.col(a), none, F.col(s), -F.col(s) * F.col(b), none, none, one)
    return found.join(norm, grp).select(grp, "n", place("_s", "_x", "_y").alias("ts"), place("_t", "_u", "_v").alias("td"), whole.alias("sums"))


@F.pandas_udf(ArrayType(DoubleType()))
def solved(sums: pd.Series, ts: pd.Series, td: pd.Series) -> pd.Series:
    """The maps of product_sums(): the eigenvector of the smallest eigenvalue, between the points as they were, its last entry 1 unless that vanishes."""
    if not len(sums):
        return pd.Series([], dtype=object)
    square = lambda x, n: np.stack(x.to_list()).reshape(-1, n, n)
    h = np.linalg.inv(square(td, 3)) @ samples.smallest(square(sums, 9)).reshape(-1, 3, 3) @ square(ts, 3)
    last = h[:, 2, 2][:, None, None]
    return pd.Series(list((h / np.where(np.abs(last) < 1e-12, 1, last)).reshape(-1, 9)))


def fitted(pairs: DataFrame, grp: str) -> DataFrame:
    """(grp, h, n): the least-squares map from (x, y) to (u, v) of every group of four pairs or more."""
    return product_sums(pairs, grp).where("n >= 4").select(grp, solved("sums", "ts", "td").alias("h"), "n")


def _searched(limit: float, rounds: int):
    def run(batches):
        drawn: dict[int, np.ndarray] = {}  # the same for all groups of a size
        for pdf in batches:
            out = []
            for key, *sides in zip(pdf["_key"], *[pdf[c] for c in "xyuv"], strict=True):
                at = np.stack(sides, 1).astype(np.float64)
                if len(at) not in drawn:
                    drawn[len(at)] = samples.fours(len(at), rounds) if len(at) > 4 else np.zeros((0, 4), np.int64)
                found = samples.best(at[:, :2], at[:, 2:], drawn[len(at)], limit, CLOSE, CHUNK)
                if found:
                    out.append((key, found[0].tolist(), found[1], len(at)))
            yield pd.DataFrame(out, columns=["_key", "h", "inliers", "n"])

    return run


def robust(pairs: DataFrame, grp: str, order: str, limit: float = 3.0, rounds: int = ROUNDS) -> DataFrame:
    """(grp, h, inliers, n): the map that puts pairs closest among those of `rounds` samples of four, fitted anew to its pairs within limit.

    Samples are drawn by a fixed rule from a group's pairs in the given order. The least sum of distances counts,
    those beyond the limit as the limit; of equal ones the first. A mean below CLOSE of it ends the search. A sample with three points in line has no map
    of its own and does not count. Groups are sheets of a bounded number of corners, one row each; pairs without a
    number on either side are left out. Fewer than four pairs, or four within the limit, give no row; exactly four
    pairs are fitted as they are.
    """
    kind = pairs.schema[grp].dataType.simpleString()
    whole = pairs.select(F.col(grp).alias("_key"), F.struct(order, *[F.col(c).cast("double").alias(c) for c in "xyuv"]).alias("_p")).where(" and ".join(f"abs(_p.{c}) < double('infinity')" for c in "xyuv"))
    listed = spread(whole, "_key").groupBy("_key").agg(F.array_sort(F.collect_list("_p")).alias("_p")).where(F.size("_p") >= 4)
    found = listed.select("_key", *[F.col(f"_p.{c}").alias(c) for c in "xyuv"]).mapInPandas(_searched(limit, rounds), f"_key {kind}, h array<double>, inliers long, n long")
    return found.withColumnRenamed("_key", grp)

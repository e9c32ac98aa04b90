"""Labels, ranges and pages of numbered frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered_label(base: Column, number: Column, digits: int, mark: str = "_") -> Column:
    """base, mark and the number with leading zeros; a longer number is not cut."""
    text = number.cast("string")
    return F.concat(base, F.lit(mark), F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text))


def sanitized(label: Column) -> Column:
    """Characters that file names can't hold become _; nothing left is `frame`."""
    return F.coalesce(F.nullif(F.trim(F.translate(label, '<>:"/\\|?*', "_" * 9)), F.lit("")), F.lit("frame"))


def stem(name: Column) -> Column:
    """Without the last extension."""
    return F.regexp_replace(name, r"\.[^.]+$", "")


def range_set(text: Column, top: int) -> Column:
    """Numbers 1..top of a list like "1, 3-5; 9": reversed ranges are turned, other tokens ignored."""
    tokens = F.split(F.regexp_replace(text, ";", ","), ",")
    low = lambda t: F.try_to_number(F.regexp_extract(t, r"^\s*(\d+)", 1), F.lit("999999999")).cast("long")
    high = lambda t: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, r"^\s*\d+\s*-\s*(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long"), low(t))
    one = lambda t: F.when(low(t).isNotNull(), F.sequence(F.least(low(t), high(t)), F.least(F.lit(top).cast("long"), F.greatest(low(t), high(t))), F.lit(1).cast("long")))
    kept = F.filter(tokens, lambda t: low(t).isNotNull() & (F.least(low(t), high(t)) <= top))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(kept, one)), lambda n: n.between(1, top))))


def pages(df: DataFrame, grp: str, per_page: int, *order: str) -> DataFrame:
    """Adds number (1-based in the group), page and cell."""
    df = df.withColumn("number", F.row_number().over(W.partitionBy(grp).orderBy(*order)).cast("long"))
    return df.withColumn("page", F.floor((F.col("number") - 1) / per_page)).withColumn("cell", (F.col("number") - 1) % per_page)


def uniquified(df: DataFrame, grp: str, name: str, *order: str) -> DataFrame:
    """Adds label: the first of equal names keeps it, later ones get _2, _3 and so on, past labels already given.

    Names can only meet inside a family, the names that are alike without their trailing _digits. A family of
    one name is numbered by a window; where a family has several, what is free depends on all its labels
    before, and it is gone through in order. Counting from 2 anew for each name gives the same labels, as all lower ones are taken.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    rows = df.withColumn("_family", F.regexp_replace(name, r"(_[0-9]+)+$", ""))
    several = rows.groupBy(grp, "_family").agg((F.min(name) < F.max(name)).alias("_several"))
    rows = rows.join(several, [grp, "_family"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        given, last, out = set(), {}, []
        for base in pdf[name]:
            label, n = base, last.get(base, 1)
            while label in given:
                n += 1
                label = f"{base}_{n}"
            last[base] = n
            given.add(label)
            out.append(label)
        return pdf.drop(columns=["_family"]).assign(label=out)

    place = F.row_number().over(W.partitionBy(grp, name).orderBy(*order))
    alone = rows.where("not _several").withColumn("label", F.when(place > 1, F.concat_ws("_", F.col(name), place)).otherwise(F.col(name)))
    mixed = rows.where("_several").drop("_several").groupBy(grp, "_family").applyInPandas(run, f"{schema}, label string")
    return alone.select(*df.columns, "label").unionByName(mixed)

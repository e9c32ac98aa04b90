"""Identity of sheets: marker ids, damaged codes, payloads, and the best page layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def code_book(spark: SparkSession, size: int) -> DataFrame:
    """(id, code): `size` codes of 16 bits made by rule, each with its three quarter turns as (id, rot, code)."""
    base = spark.range(size).select(F.col("id"), ((F.col("id") * 40_503 + 9_973) * 2_654_435_761 % 65_536).cast("int").alias("c0"))
    # a quarter turn of the 4 x 4 bits: bit (r, c) goes to (c, 3 - r)
    turn = lambda c: sum(((F.shiftright(c, 4 * r + k) % 2) * (1 << (4 * k + 3 - r)) for r in range(4) for k in range(4)), F.lit(0))
    for i in range(1, 4):
        base = base.withColumn(f"c{i}", turn(F.col(f"c{i - 1}")).cast("int"))
    return base.select("id", F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("rot", "code"))


def nearest_code(seen: DataFrame, book: DataFrame, bits: str, allowed: int, width: int = 16) -> DataFrame:
    """Adds marker, rot and errors of the closest code; the earliest turn, then the lowest id of equally close ones.

    Codes of `width` bits that differ in at most `allowed` of them agree in one of allowed + 1 stretches: they meet by
    stretch, so a value seen is held against the codes that share one with it, and the book may have any size.
    """
    edges = [width * i // (allowed + 1) for i in range(allowed + 2)]
    piece = lambda c: F.posexplode(F.array(*[F.shiftright(c, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)])).alias("_band", "_piece")
    values = seen.select(bits).distinct().where(F.col(bits).isNotNull())
    near = values.select(bits, piece(F.col(bits))).join(book.select("id", "rot", "code", piece(F.col("code"))), ["_band", "_piece"])
    errors = F.bit_count(F.col(bits).bitwiseXOR(F.col("code"))).cast("long")
    best = near.select(bits, F.struct(errors.alias("errors"), F.col("rot").cast("long").alias("rot"), F.col("id").alias("marker")).alias("_b")).where(F.col("_b.errors") <= allowed)
    best = best.groupBy(bits).agg(F.min("_b").alias("_b"))
    return seen.join(best, bits).select(*seen.columns, "_b.marker", "_b.rot", "_b.errors")


def sheet_marker_ids(sheet: Column, dictionary: int, count: int) -> Column:
    """The ids of a sheet's `count` markers: places take ids of their own block of dictionary / count,
    even places by the sheet's low digit in that base, odd ones by its high digit."""
    m = dictionary // count
    digit = lambda i: F.when(i % 2 == 0, F.pmod(sheet, F.lit(m))).otherwise(F.pmod(F.floor(sheet / m), F.lit(m)))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (i * m + digit(i)).cast("long"))


def payload(project: Column, *fields: Column) -> Column:
    """The prefix K2 and the fields between bars; bars in text become slashes."""
    return F.concat_ws("|", F.lit("K2"), F.translate(project, "|", "/"), *[F.translate(f.cast("string"), "|", "/") for f in fields])


def parsed_payload(text: Column) -> Column:
    """struct(label, sheet): a K2 payload's last and second fields, null if its number is none; other text is a label."""
    parts = F.split(text, r"\|")
    new = F.startswith(text, F.lit("K2|")) & (F.size(parts) == 5)
    sheet = F.try_to_number(F.get(parts, F.lit(2)), F.lit("999999999")).cast("long")
    return F.struct(F.when(new & sheet.isNull(), F.lit(None)).when(new, F.get(parts, F.lit(4))).otherwise(text).alias("label"), F.when(new, sheet).alias("sheet"))


def best_layout(df: DataFrame, w: str, h: str, page_w: float, page_h: float, cells: list[tuple[int, int]]) -> DataFrame:
    """Adds cols, rows and area: of the candidate grids, upright and turned, the one that shows the frame largest; the earliest of equals."""
    grids = [(c, r, pw, ph, i) for i, (c, r, pw, ph) in enumerate([(c, r, page_w, page_h) for c, r in cells] + [(c, r, page_h, page_w) for c, r in cells])]
    fit = lambda c, r, pw, ph: F.least(F.lit(pw) / c / F.col(w), F.lit(ph) / r / F.col(h))
    options = F.array(*[F.struct(F.round(F.col(w) * F.col(h) * fit(c, r, pw, ph) * fit(c, r, pw, ph), 9).alias("area"), F.lit(-i).alias("ord"), F.lit(c).cast("long").alias("cols"), F.lit(r).cast("long").alias("rows")) for c, r, pw, ph, i in grids])
    return df.withColumn("_b", F.array_max(options)).select(*df.columns, "_b.cols", "_b.rows", F.round("_b.area", 6).alias("area"))


def identified_sheets(texts: DataFrame, sheets: DataFrame, frames: DataFrame) -> DataFrame:
    """(scan, sheet): the sheet that the first telling code of a scan names; no row for a scan without one.

    texts: (scan, project, ord, box, text) as read, null where nothing was; sheets: (project, sheet); frames:
    (project, label, sheet). A box counts once, codes that name another project are passed over (unless either name is
    empty), a number that the project has not falls back to the label, and that to the first sheet that holds it.
    """
    first = texts.groupBy("scan", "project", "box").agg(F.min_by(F.struct("ord", "text"), "ord").alias("t")).select("scan", "project", "t.*")
    rows = first.where("text is not null").withColumn("p", parsed_payload(F.col("text")))
    named = F.trim(F.when(F.col("p.sheet").isNotNull(), F.get(F.split("text", r"\|"), F.lit(1))).otherwise(""))
    own = F.trim(F.coalesce("project", F.lit("")))
    rows = rows.where((named == "") | (own == "") | (named == own)).select("scan", "project", "ord", "p.label", F.col("p.sheet").alias("number"))
    known = sheets.select("project", F.col("sheet").alias("number"), F.col("sheet").alias("_by_number")).distinct()
    held = frames.where("label <> ''").groupBy("project", "label").agg(F.min("sheet").alias("_by_label"))
    hits = rows.join(known, ["project", "number"], "left").join(held, ["project", "label"], "left").withColumn("sheet", F.coalesce("_by_number", "_by_label"))
    return hits.where("sheet is not null").groupBy("scan").agg(F.min_by("sheet", "ord").alias("sheet"))

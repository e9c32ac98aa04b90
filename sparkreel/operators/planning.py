"""What is printed and shown: selections, plans, settings, references and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.operators import labels, sheets


def select_numbers(df: DataFrame, number: str, include: Column, exclude: Column) -> DataFrame:
    """Rows whose number is in include, or any if that is empty, and not in exclude; null sets are empty."""
    none = F.array().cast("array<bigint>")
    inc, exc = F.coalesce(include, none), F.coalesce(exclude, none)
    return df.where(((F.size(inc) == 0) | F.array_contains(inc, F.col(number))) & ~F.array_contains(exc, F.col(number)))


def compute_plan(frames: DataFrame, grp: str, name: str, pos: str, include: Column, exclude: Column, per_page: int, start: int = 1, digits: int = 4, naming: str = "number", numbering: str = "consecutive") -> DataFrame:
    """(grp, pos, k, raw, label, page, cell) of the frames that are printed.

    pos is 1-based. naming `original` labels by the name without extension, else by the prefix in `name` and a number:
    the start plus the place in the selection, or with numbering `original` the place in the group. Equal labels are
    told apart as uniquified() does.
    """
    rows = select_numbers(frames, pos, include, exclude)
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy(grp).orderBy(pos)).cast("long"))
    number = start + (F.col(pos) if numbering == "original" else F.col("k")) - 1
    raw = labels.stem(F.col(name)) if naming == "original" else labels.numbered_label(F.col(name), number, digits)
    rows = rows.select(grp, pos, "k", raw.alias("raw"))
    rows = labels.uniquified(rows, grp, "raw", "k")
    return rows.withColumns({"page": F.floor((F.col("k") - 1) / per_page), "cell": (F.col("k") - 1) % per_page})


def original_pages(plan: DataFrame, grp: str, page: str, pos: str, per_page: int, start: int = 1) -> DataFrame:
    """(grp, page, original_page): the page that a printed page's first frame had before frames were left out."""
    return plan.groupBy(grp, page).agg((start + F.floor((F.min(pos) - 1) / per_page)).alias("original_page"))


def page_label(number: Column, prefix: str, zeros: int) -> Column:
    """The prefix and the number with leading zeros, 16 digits at most."""
    text, n = number.cast("string"), min(16, max(0, zeros))
    return F.concat(F.lit(prefix), F.when(F.length(text) < n, F.lpad(text, n, "0")).otherwise(text))


def available_frames(processed: DataFrame, loose: DataFrame, label: str, content: str) -> DataFrame:
    """(label, content): processed frames under their sanitized label, loose ones under their own, which go first."""
    made = processed.groupBy(labels.sanitized(F.col(label)).alias(label)).agg(F.max(content).alias("_made"))
    own = loose.groupBy(label).agg(F.max(content).alias("_own"))
    return made.join(own, label, "full").select(label, F.coalesce("_own", "_made").alias(content))


def reference_entry(entries: DataFrame, grp: str, chosen: str, sheet: str, seq: str) -> DataFrame:
    """Each group's reference: the chosen entry, else the lowest sheet (null counts as 0), the first of equals."""
    key = F.struct((~F.coalesce(F.col(chosen), F.lit(False))).alias("a"), F.coalesce(F.col(sheet), F.lit(0)).alias("b"), F.col(seq).alias("c"))
    return entries.groupBy(grp).agg(F.min_by(F.struct(seq, sheet), key).alias("r")).select(grp, f"r.{seq}", f"r.{sheet}")


def levels_key(on: Column, strip: Column, measured: Column, cyan: Column, reference: Column) -> Column:
    """Which normalisation an entry takes: raw, unreadable, normal, or cyan: and the reference."""
    return F.when(~(on & strip), "raw").when(measured.isNull(), "unreadable").when(~cyan, "normal").when(reference.isNull(), "raw").otherwise(F.concat(F.lit("cyan:"), reference))


def normalized_settings(settings: Column, tables: dict[str, dict[str, str]], retired: tuple[str, ...]) -> Column:
    """A map of settings with old values of the named keys replaced by their table, and retired keys empty."""
    tables_ = F.create_map(*[F.lit(x) for k, t in tables.items() for old, new in t.items() for x in (f"{k}={old}", new)])
    value = lambda k, v: F.when(k.isin(*retired), F.lit("")).otherwise(F.coalesce(F.try_element_at(tables_, F.concat_ws("=", k, v)), v))
    return F.transform_values(settings, value)


def numeric_settings(settings: Column, whole: tuple[str, ...]) -> Column:
    """A map of settings as numbers, null where they are none; the whole ones rounded half up."""
    return F.transform_values(settings, lambda k, v: F.when(k.isin(*whole), F.floor(v.try_cast("double") + 0.5).cast("double")).otherwise(v.try_cast("double")))


def layout_summary(frames: DataFrame, project: str, sheet: str) -> DataFrame:
    """(project, sheets, frames)."""
    per = frames.groupBy(project, sheet).agg(F.count("*").alias("n"))
    return per.groupBy(project).agg(F.count("*").alias("sheets"), F.sum("n").alias("frames"))


def claimed_labels(results: DataFrame, label: str, content: str, seq: str) -> DataFrame:
    """(label, content): of several results for a label the last one's."""
    return results.groupBy(label).agg(F.max_by(content, seq).alias(content))


def missing_characters(texts: DataFrame, covered: DataFrame, grp: str, text: str, order: str) -> DataFrame:
    """(grp, char, first) of the characters that `covered` (char) has not, with the place where each appears first: text by text, character by character."""
    chars = texts.select(grp, order, F.posexplode(F.split(text, "")).alias("at", "char")).where("char <> ''").join(covered, "char", "left_anti")
    return chars.groupBy(grp, "char").agg(F.min(F.struct(order, "at")).alias("f")).select(grp, "char", F.col(f"f.{order}").alias("first"))


def sheet_warnings(settings: DataFrame) -> DataFrame:
    """Adds warnings to rows of (mode, registration, marker_mm, qr, qr_mm, margin_mm, saving, halo_mm, block)."""
    return settings.withColumn("warnings", sheets.cyanotype_warnings(*[F.col(c) for c in ("mode", "registration", "marker_mm", "qr", "qr_mm", "margin_mm", "saving", "halo_mm", "block")]))

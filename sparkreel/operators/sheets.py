"""Sheets: units, page and marker geometry, print scale, warnings, layout documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: paper sizes in mm, upright.
PAPER = {"A3": (297.0, 420.0), "A4": (210.0, 297.0), "A5": (148.0, 210.0), "A6": (105.0, 148.0), "B4": (250.0, 353.0), "B5": (176.0, 250.0), "Letter": (215.9, 279.4), "Legal": (215.9, 355.6), "Tabloid": (279.4, 431.8)}
#: Fixed: other names of papers, numbers of markers a sheet may have, places of markers as (column, row) of left/middle/right and thirds.
ALIASES = {"Carta (Letter)": "Letter", "Oficio (Legal)": "Legal", "Tabloide (Tabloid)": "Tabloid"}
COUNTS = (4, 8, 12)
PLACES = (("left", "top"), ("right", "top"), ("right", "bottom"), ("left", "bottom"), ("middle", "top"), ("right", "center"), ("middle", "bottom"), ("left", "center"), ("third", "top"), ("two thirds", "top"), ("third", "bottom"), ("two thirds", "bottom"))
#: Fixed: least marker, QR, margin and halo sizes in mm that are not warned of, and the brightness of a blocking colour that is.
LEAST_MARKER, LEAST_QR, LEAST_MARGIN, LEAST_HALO, BRIGHT = 10, 12, 6, 4, 160


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def mm_to_px(mm: Column, dpi) -> Column:
    return F.round(mm / 25.4 * dpi).cast("long")


def pt_to_px(pt: Column, dpi) -> Column:
    """At least 1."""
    return F.greatest(F.round(pt / 72.0 * dpi).cast("long"), F.lit(1).cast("long"))


def paper_mm(name: Column) -> Column:
    """struct(w, h) of a paper by one of its names, null for others."""
    sizes = PAPER | {a: PAPER[n] for a, n in ALIASES.items()}
    out = F.lit(None).cast("struct<w:double,h:double>")
    for n, (w, h) in sizes.items():
        out = F.when(name == n, F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"))).otherwise(out)
    return out


def page_px(name: Column, dpi, landscape: Column, own_w: Column, own_h: Column) -> Column:
    """struct(w, h) in pixels: the named paper or the sheet's own size, turned if landscape."""
    size = F.coalesce(paper_mm(name), F.struct(own_w.cast("double").alias("w"), own_h.cast("double").alias("h")))
    w, h = F.when(landscape, size["h"]).otherwise(size["w"]), F.when(landscape, size["w"]).otherwise(size["h"])
    return F.struct(mm_to_px(w, dpi).alias("w"), mm_to_px(h, dpi).alias("h"))


def marker_count(count: Column) -> Column:
    """The nearest permitted number of markers; of two equally near ones the smaller."""
    return F.array_min(F.array(*[F.struct(F.abs(count - c).alias("d"), F.lit(c).cast("long").alias("n")) for c in COUNTS]))["n"]


def marker_capacity(dictionary: Column, count: Column, registration: Column, qr: Column) -> Column:
    """How many sheets the marker ids tell apart: the square of the ids a place has; null unless markers alone identify sheets."""
    ids = F.greatest(F.lit(1).cast("long"), F.floor(dictionary / marker_count(count)))
    return F.when(registration & ~qr, ids * ids)


def marker_size(mm: Column, dpi, cyan: Column) -> Column:
    """struct(side, quiet, patch) in pixels: the side is 8 at least, the quiet zone a seventh of it (a quarter for cyanotypes), 2 at least."""
    side = F.greatest(mm_to_px(mm, dpi), F.lit(8).cast("long"))
    quiet = F.greatest(F.floor(side / F.when(cyan, 4).otherwise(7)), F.lit(2).cast("long"))
    return F.struct(side.alias("side"), quiet.alias("quiet"), (side + 2 * quiet).alias("patch"))


def margin_px(margin_mm: Column, marker_margin_mm: Column, size: Column, dpi, registration: Column) -> Column:
    """The page margin, with markers at least their own margin, their patch and 2 mm."""
    band = mm_to_px(marker_margin_mm, dpi) + size["patch"] + mm_to_px(F.lit(2.0), dpi)
    return F.when(registration, F.greatest(mm_to_px(margin_mm, dpi), band)).otherwise(mm_to_px(margin_mm, dpi))


def marker_boxes(page_w: Column, page_h: Column, count: Column, side: Column, quiet: Column, margin: Column) -> Column:
    """array<struct(place, x1, y1, x2, y2)> of a sheet's markers: corners, then edge middles, then thirds, clockwise from the top left."""
    div = lambda a, b: F.floor(a / b)
    patch = side + 2 * quiet
    right, bottom = page_w - margin - patch, page_h - margin - patch
    xs = {"left": margin, "right": right, "middle": div(page_w - patch, 2), "third": margin + div(right - margin, 3), "two thirds": margin + div((right - margin) * 2, 3)}
    ys = {"top": margin, "bottom": bottom, "center": div(page_h - patch, 2)}
    box = lambda i, x, y: F.struct(F.lit(i).cast("long").alias("place"), (x + quiet).alias("x1"), (y + quiet).alias("y1"), (x + quiet + side).alias("x2"), (y + quiet + side).alias("y2"))
    return F.slice(F.array(*[box(i, xs[x], ys[y]) for i, (x, y) in enumerate(PLACES)]), F.lit(1), marker_count(count).cast("int"))


def needs_print_scale(scale_x: Column, scale_y: Column) -> Column:
    return (F.abs(scale_x - 1) > 1e-4) | (F.abs(scale_y - 1) > 1e-4)


def scaled_box(box: Column, scale_x: Column, scale_y: Column, page_w: Column, page_h: Column) -> Column:
    """A box (x1, y1, x2, y2) divided by the printer's scale about the page's middle, rounded; as it is where no scale is needed."""
    to = lambda v, size, k: F.round(size / 2 + (v - size / 2) / k).cast("long")
    moved = F.struct(to(box["x1"], page_w, scale_x).alias("x1"), to(box["y1"], page_h, scale_y).alias("y1"), to(box["x2"], page_w, scale_x).alias("x2"), to(box["y2"], page_h, scale_y).alias("y2"))
    return F.when(needs_print_scale(scale_x, scale_y), moved).otherwise(F.struct(*[box[c].cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")]))


def crop_rect(box: Column, scale: Column, bleed: Column, page_w: Column, page_h: Column) -> Column:
    """struct(x, y, w, h) to cut out of a page, null if nothing of it lies on the page.

    Width and height come from the box's size alone, cut by `bleed` of it on every side and truncated; the corner
    is rounded by itself, so boxes of one size give crops of one size.
    """
    w, h = F.round((box["x2"] - box["x1"]) * scale), F.round((box["y2"] - box["y1"]) * scale)
    dx, dy = (w * bleed).cast("long"), (h * bleed).cast("long")
    x, y = F.round(box["x1"] * scale + dx).cast("long"), F.round(box["y1"] * scale + dy).cast("long")
    cw, ch = (w - 2 * dx).cast("long"), (h - 2 * dy).cast("long")
    on = (cw >= 1) & (ch >= 1) & (x < page_w) & (y < page_h) & (x + cw > 0) & (y + ch > 0)
    return F.when(on, F.struct(x.alias("x"), y.alias("y"), cw.alias("w"), ch.alias("h")))


def is_cyan(mode: Column) -> Column:
    return F.lower(F.trim(mode)).rlike("^c[yi]an")


def hex_to_rgb(color: Column) -> Column:
    """array of three 0..255 of a colour of 3 or 6 hexadecimal digits, with or without # before; black for anything else."""
    text = F.regexp_replace(F.trim(color), "^#+", "")
    six = F.when(F.length(text) == 3, F.regexp_replace(text, "(.)", "$1$1")).otherwise(text)
    part = lambda i: F.conv(F.substring(six, i, 2), 16, 10).cast("long")
    return F.when(six.rlike("^[0-9A-Fa-f]{6}$"), F.array(part(1), part(3), part(5))).otherwise(F.array(*[F.lit(0).cast("long")] * 3))


def rgb_to_hex(rgb: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(F.get(rgb, F.lit(i)).cast("long")), 2, "0") for i in range(3)])


def gray_of(r: Column, g: Column, b: Column) -> Column:
    """Whole luma of whole channels."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000)


def cyanotype_warnings(mode: Column, registration: Column, marker_mm: Column, qr: Column, qr_mm: Column, margin_mm: Column, saving: Column, halo_mm: Column, block: Column) -> Column:
    """array of the rules that a cyanotype sheet with markers breaks, in this order: marker, qr, margin, halo, block colour."""
    rgb = hex_to_rgb(block)
    bright = block.isNotNull() & (block != "") & (F.floor((F.get(rgb, F.lit(0)) + F.get(rgb, F.lit(1)) + F.get(rgb, F.lit(2))) / 3) > BRIGHT)
    rules = {"marker": marker_mm < LEAST_MARKER, "qr": qr & (qr_mm < LEAST_QR), "margin": margin_mm < LEAST_MARGIN, "halo": saving & (halo_mm < LEAST_HALO), "block": bright}
    found = F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return F.when(is_cyan(mode) & registration, found).otherwise(F.array().cast("array<string>"))


def recommended_mm(least: Column, factor: float, floor: float, otherwise: float = 12.0) -> Column:
    """A size to recommend from the least one that was read: by a factor, to half millimetres, not below the floor."""
    return F.when(least.isNull(), F.lit(otherwise)).otherwise(F.greatest(F.round(least * factor * 2) / 2, F.lit(floor)))


def compute_layout(settings: DataFrame) -> DataFrame:
    """Adds page_w, page_h, margin, side, quiet and markers to rows of settings.

    settings: (paper, dpi, landscape, own_w, own_h, margin_mm, marker_mm, marker_margin_mm, markers_wanted, cyan,
    registration); markers is null without registration.
    """
    rows = settings.withColumn("_p", page_px(F.col("paper"), F.col("dpi"), F.col("landscape"), F.col("own_w"), F.col("own_h"))).withColumn("_m", marker_size(F.col("marker_mm"), F.col("dpi"), F.col("cyan")))
    rows = rows.withColumns({"page_w": F.col("_p.w"), "page_h": F.col("_p.h"), "side": F.col("_m.side"), "quiet": F.col("_m.quiet"), "margin": margin_px(F.col("margin_mm"), F.col("marker_margin_mm"), F.col("_m"), F.col("dpi"), F.col("registration"))})
    boxes = marker_boxes(F.col("page_w"), F.col("page_h"), F.col("markers_wanted"), F.col("side"), F.col("quiet"), mm_to_px(F.col("marker_margin_mm"), F.col("dpi")))
    return rows.withColumn("markers", F.when(F.col("registration"), boxes)).drop("_p", "_m")


def assemble_layout(frames: DataFrame, project: str, sheet: str, label: str, box: str) -> DataFrame:
    """(project, sheets, frames, document): one JSON document a project, its sheets by number, their frames by label.

    A document holds a project's sheets; projects are assembled apart, sheets first.
    """
    sheets = frames.groupBy(project, sheet).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col(box).alias("bbox")))).alias("frames"))
    docs = sheets.groupBy(project).agg(F.array_sort(F.collect_list(F.struct(F.col(sheet).alias("number"), "frames"))).alias("s"))
    n = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.size(x["frames"]))
    return docs.select(project, F.size("s").cast("long").alias("sheets"), n.alias("frames"), F.to_json(F.struct(F.lit(2).alias("version"), F.col(project).alias("project"), F.col("s").alias("sheets"))).alias("document"))

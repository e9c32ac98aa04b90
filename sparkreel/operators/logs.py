"""Facts about videos from decoders' logs and codec descriptions.

A log's line about a video stream is a list: fields between commas, a field's remarks in brackets after its
name. It is taken apart as such, once, and every fact is a field known by its form or its place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkreel.operators.timeline import js_round

#: Fixed values of the formats: matrices by the name of a colour space; profiles of more than 8 bits by codec; planes
#: of three sheets by the steps of their colours across and down.
MATRICES = {"bt709": "bt709", "bt470bg": "bt601", "smpte170m": "bt601", "bt2020": "bt2020", "bt2020nc": "bt2020", "bt2020c": "bt2020", "bt2020ncl": "bt2020", "bt2020cl": "bt2020"}
DEEP_AVC, DEEP_HEVC = (110, 122, 244), 2
STEPS = {"420": (2, 2), "422": (2, 1), "444": (1, 1)}


def _known(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _whole(text: Column) -> Column:
    """The number that a text of digits says, null for any other text."""
    return F.when(F.translate(text, "0123456789", "") == "", text.try_cast("long"))


def log_line(log: Column, *words: str) -> Column:
    """The first line that has these words in this order, from behind the last one on; null without one."""
    found = F.filter(F.split(log, "\n"), lambda line: line.like("%" + "%".join(words) + "%"))
    rest = F.get(found, F.lit(0))
    for w in words:
        rest = F.substr(rest, F.instr(rest, w) + len(w))
    return F.trim(rest)


def stream_fields(log: Column) -> Column:
    """array of (name, remarks) of the first video stream: commas inside brackets part remarks, not fields."""
    # a comma in brackets is one that a closing bracket follows before any opening one
    fields = F.split(log_line(log, "Stream #", "Video:"), r",(?![^(]*\))")

    def told(field: Column) -> Column:
        name = F.trim(F.substring_index(field, "(", 1))
        inside = F.when(F.contains(field, F.lit("(")), F.substring_index(F.substr(field, F.instr(field, "(") + 1), ")", 1)).otherwise("")
        return F.struct(name.alias("name"), F.transform(F.split(inside, ","), lambda x: F.trim(x)).alias("remarks"))

    return F.transform(fields, told)


def _size(name: Column) -> Column:
    """struct(w, h) of a field like 1920x1080 [SAR 1:1], else null."""
    sides = F.split(F.substring_index(name, " ", 1), "x")
    w, h = (_whole(F.get(sides, F.lit(i))) for i in (0, 1))
    return F.when((F.size(sides) == 2) & w.between(10, 99_999) & h.between(10, 99_999), F.struct(w.alias("w"), h.alias("h")))


def _depth(name: Column) -> Column:
    """Bits of a sample by a pixel format's name: two digits before the order of bytes, 16 at most, else 8."""
    ordered = F.right(name, F.lit(2)).isin("le", "be")
    digits = F.when(ordered & (F.length(name) >= 4), F.substr(name, F.length(name) - 3, F.lit(2)))
    return F.least(F.lit(16).cast("long"), F.coalesce(_whole(digits), F.lit(8).cast("long")))


def pixel_format(fields: Column) -> Column:
    """struct(format, depth, full, known, matrix) of a stream's fields: the pixel format follows the codec; null where a size or nothing does.

    full: the full range of values; known: whether a range is said.
    """
    field = F.get(fields, F.lit(1))
    name, remarks = field["name"], field["remarks"]
    wide = name.startswith("yuvj") | F.array_contains(remarks, "pc")
    matrix = F.get(F.filter(F.transform(remarks, lambda r: _known(MATRICES, F.substring_index(r, "/", 1))), lambda m: m.isNotNull()), F.lit(0))
    is_format = name.isNotNull() & (name != "") & (name != "none") & ~F.contains(name, F.lit(" ")) & _size(name).isNull()
    told = F.struct(name.alias("format"), _depth(name).alias("depth"), wide.alias("full"), (wide | F.array_contains(remarks, "tv")).alias("known"), matrix.alias("matrix"))
    return F.when(is_format, told)


def planar_format(name: Column) -> Column:
    """struct(format, sx, sy) of 10 and 12 bit planes in three sheets, with the steps of their colour planes; null for others."""
    planes = {f"yuv{alpha}{kind}p{bits}le": (f"I{kind}P{bits}", kind) for alpha in ("", "a") for kind in STEPS for bits in (10, 12)}
    told = _known({k: v[0] for k, v in planes.items()}, name)
    steps = [_known({k: STEPS[v[1]][i] for k, v in planes.items()}, name).cast("long") for i in (0, 1)]
    return F.when(told.isNotNull(), F.struct(told.alias("format"), steps[0].alias("sx"), steps[1].alias("sy")))


def clock(log: Column) -> Column:
    """Seconds of the duration that a log tells as hours:minutes:seconds, 0 without one."""
    parts = F.split(F.substring_index(log_line(log, "Duration:"), ",", 1), ":")
    part = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    return F.coalesce(F.when(F.size(parts) == 3, part(0) * 3600 + part(1) * 60 + part(2)), F.lit(0.0))


def display_rotation(log: Column) -> Column:
    """Clockwise quarter turns in degrees, from a display matrix that counts the other way; 0 without one."""
    turn = F.substring_index(log_line(F.replace(F.lower(log), F.lit("display matrix"), F.lit("displaymatrix")), "displaymatrix: rotation of "), " ", 1).try_cast("double")
    return F.coalesce(F.pmod(js_round(-turn / 90) * 90, F.lit(360)), F.lit(0)).cast("long")


def probed(log: Column) -> Column:
    """struct(duration, width, height, fps, rotation, pix) that a decoder's log tells; what it does not tell is 0, pix null."""
    fields = stream_fields(log)
    first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))
    size = first(F.transform(fields, lambda f: _size(f["name"])))
    rate = first(F.transform(fields, lambda f: F.when(f["name"].endswith(" fps"), F.substring_index(f["name"], " ", 1).try_cast("double"))))
    none = F.lit(0).cast("long")
    return F.struct(
        clock(log).alias("duration"), F.coalesce(size["w"], none).alias("width"), F.coalesce(size["h"], none).alias("height"), F.coalesce(rate, F.lit(0.0)).alias("fps"), display_rotation(log).alias("rotation"), pixel_format(fields).alias("pix")
    )


def _byte(box: Column, at: Column) -> Column:
    """The byte at a place from 0, null behind the end."""
    return F.when((at >= 0) & (at < F.octet_length(box)), F.conv(F.hex(F.substring(box, at + 1, F.lit(1))), 16, 10).cast("long"))


def _behind_sets(box: Column, at: Column, n: Column) -> Column:
    """Where n parameter sets end that begin at a place, each behind its length in two bytes."""
    step = lambda place, _: F.when(place + 2 <= F.octet_length(box), place + 2 + _byte(box, place) * 256 + _byte(box, place + 1)).otherwise(place)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), n), at, step)).otherwise(at)


def box_depth(box: Column, kind: Column) -> Column:
    """Bits of a sample by the configuration box of an HEVC or a high AVC stream, null where it does not tell."""
    hevc = F.pmod(_byte(box, F.lit(17).cast("long")), F.lit(8)) + 8
    first = _behind_sets(box, F.lit(6).cast("long"), F.coalesce(F.pmod(_byte(box, F.lit(5).cast("long")), F.lit(32)), F.lit(0)))
    second = _behind_sets(box, first + 1, F.coalesce(_byte(box, first), F.lit(0)))
    # behind the sets: the colour format, then the depth above 8
    avc = F.when(F.octet_length(box) > 6, F.pmod(_byte(box, second + 1), F.lit(8)) + 8)
    return F.when(kind.isin("hev1", "hvc1"), hevc).when(kind.isin("avc1", "avc3"), avc)


def codec_depth(codec: Column, box: Column | None = None) -> Column:
    """Bits of a sample by a codec's dotted name, and its configuration box where that tells more; null if neither tells."""
    parts = F.split(codec, r"\.")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    kind = part(0)
    told = box_depth(box, kind) if box is not None else F.lit(None).cast("long")
    hevc = _whole(F.when(F.substring(part(1), 1, 1).isin("A", "B", "C"), F.substr(part(1), F.lit(2))).otherwise(part(1)))
    avc = F.conv(F.substring(part(1), 1, 2), 16, 10).cast("long")
    eight, ten = F.lit(8).cast("long"), F.lit(10).cast("long")
    return (
        F.when(kind.isin("vp09", "av01"), _whole(F.when(F.length(part(3)) == 2, part(3))))
        .when(kind.isin("hev1", "hvc1") & hevc.isNotNull(), F.coalesce(told, F.when(hevc == DEEP_HEVC, ten).otherwise(eight)))
        .when(kind.isin("avc1", "avc3") & avc.isin(*DEEP_AVC), F.coalesce(told, ten))
        .when(kind.isin("avc1", "avc3"), eight)
    )

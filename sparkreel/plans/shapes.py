"""Queries over parts and contours of rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.operators import components, contours, recovery
from sparkreel.plans.base import GRAY8, gray8, query
from sparkreel.session import spread, table

_ON = "b as (select img, x, y from px where gray >= 110)"


@query(f"""with recursive {GRAY8}, {_ON}, r(img, x, y, lx, ly) as (select img, x, y, x, y from b
  union select n.img, n.x, n.y, r.lx, r.ly from r join b n on n.img = r.img and abs(n.x - r.x) <= 1 and abs(n.y - r.y) <= 1),
l as (select img, x, y, min((ly, lx)) p from r group by all)
select img, cast(count(distinct p) as bigint) parts, cast(max(n) as bigint) largest from (select *, count(*) over (partition by img, p) n from l) group by img""")
def raster_parts(spark, d):
    parts = components.raster_components(gray8(spark, d), F.col("gray") >= 110)
    return parts.groupBy("img").agg(F.count("*").alias("parts"), F.max("pixels").alias("largest"))


#: The first border of each raster: a walk by recursion, its two far places, and the halves cut where they bend.
_WALK = f"""{GRAY8}, {_ON}, g as (select img, list(y * 10 + x) on_ from b group by img),
s as (select img, arg_min((x, y), y * 8 + x) p from b group by img),
nb as (select * from (values (0, -1, 0), (1, -1, -1), (2, 0, -1), (3, 1, -1), (4, 1, 0), (5, 1, 1), (6, 0, 1), (7, -1, 1)) t(dir, dx, dy)),
r(img, i, x, y, back, sx, sy) as (select img, 0, p[1], p[2], 0, p[1], p[2] from s
  union all select img, i + 1, nx, ny, (dir + 4) % 8, sx, sy from (
    select r.img, r.i, r.x + dx nx, r.y + dy ny, nb.dir, sx, sy, row_number() over (partition by r.img order by (nb.dir - r.back + 7) % 8) k
    from r join g on g.img = r.img join nb on r.x + dx between 0 and 7 and r.y + dy between 0 and 7 and list_contains(g.on_, (r.y + dy) * 10 + r.x + dx)) where k = 1 and not (nx = sx and ny = sy and i + 1 > 2) and i + 1 <= 64),
w as (select img, list({{'x': x::double, 'y': y::double}} order by i) p, count(*) n from r group by img having count(*) >= 4)"""


def _first(spark, d):
    """The border that begins at the first place of each raster, if it has four places."""
    rasters = contours.packed_rows(gray8(spark, d), F.col("gray") >= 110, 8, 8)
    found = contours.contours(rasters, 0.9).join(rasters.select("img", F.array_min("bits").alias("at")), "img")
    start = F.col("line")[0]
    return found.where(start["y"] * 8 + start["x"] == F.col("at"))


def _told(points):
    return F.array_join(F.transform(points, lambda q: F.concat_ws(",", q["x"].cast("int"), q["y"].cast("int"))), " ")


@query(f"with recursive {_WALK} select img, cast(n as bigint) length, array_to_string(list_transform(p, lambda q: cast(q.x as int) || ',' || cast(q.y as int)), ' ') line from w")
def first_borders(spark, d):
    return _first(spark, d).select("img", F.size("line").cast("long").alias("length"), _told(F.col("line")).alias("line"))


_FAR = "list_transform({p}, lambda q: (q.x - {p}[{i}].x) * (q.x - {p}[{i}].x) + (q.y - {p}[{i}].y) * (q.y - {p}[{i}].y))"


@query(f"""with recursive {_WALK}, f as (select img, p, list_position({_FAR.format(p='p', i=1)}, list_max({_FAR.format(p='p', i=1)})) a from w),
o as (select img, p, a, list_position({_FAR.format(p='p', i='a')}, list_max({_FAR.format(p='p', i='a')})) b from f),
h as (select img, 1 half, p[least(a, b):greatest(a, b)] q from o union all select img, 2, list_concat(p[greatest(a, b):], p[:least(a, b)]) from o),
t(img, half, q, i, j) as (select img, half, q, 1::bigint, len(q)::bigint from h
  union all select img, half, q, unnest([i, k]), unnest([k, j]) from (select *, i + list_position(d, list_max(d)) k from
    (select *, list_transform(range(i + 1, j), lambda k: abs((q[k].x - q[i].x) * (q[j].y - q[i].y) - (q[k].y - q[i].y) * (q[j].x - q[i].x)) / greatest(sqrt((q[j].x - q[i].x) * (q[j].x - q[i].x) + (q[j].y - q[i].y) * (q[j].y - q[i].y)), 1e-9)) d from t where j - i >= 2) where list_max(d) > 0.9)),
e as (select img, half, i, q[i] c from t group by all),
v as (select img, list(c order by half, i) c from (select img, half, i, c, i = max(i) over (partition by img, half) last from e) group by img),
z as (select img, c, len(c) n from v)
select img, array_to_string(list_transform(c, lambda q: cast(q.x as int) || ',' || cast(q.y as int)), ' ') corners, abs(list_sum(list_transform(range(1, n + 1), lambda i: c[i].x * c[i % n + 1].y - c[i % n + 1].x * c[i].y))) / 2 area from z""")
def first_polygons(spark, d):
    """The corners of those borders and the area inside."""
    return _first(spark, d).select("img", _told(F.col("corners")).alias("corners"), "area")


#: A sheet of four parts as markers of 24 units; a scan sees it 1.5 times as large, 3 and 2 pixels off, and lost the third.
_SIDE = 24


def _expected(spark, d):
    k = F.col("p_partkey")
    place = (k % 4) * 40 + 10
    return table(spark, d, "part").select(F.floor(k / 4).alias("scan"), k.alias("marker"), F.col("p_size").alias("p_size"), place.alias("x1"), F.lit(10).alias("y1"), (place + _SIDE).alias("x2"), F.lit(10 + _SIDE).alias("y2"))


def _code(marker):
    return ((marker * 40_503 + 9_973) % 65_536 * 2_654_435_761 % 65_536).cast("long")


@query("""with p as (select p_partkey // 4 scan, p_partkey marker, p_size, count(*) filter (where p_partkey % 4 <> 2) over (partition by p_partkey // 4) n from part)
select scan, marker, cast(case when p_size % 5 = 1 then 1 else 0 end as bigint) shift, cast(case when p_size % 3 = 0 then 1 else 0 end as bigint) errors from p where marker % 4 = 2 and n >= 3 and p_size % 7 > 0""")
def recovered_markers(spark, d):
    """Lost markers found again: some stand a cell off, some have one wrong cell, some are painted over."""
    marks = _expected(spark, d)
    mine = marks.where("marker % 4 = 2")
    # the pixels around each lost marker, drawn from its code: white paper, black border, white bits
    rows = spread(mine, "marker").withColumn("x", F.explode(F.sequence(F.lit(3 + 90 * 3 // 2 - 12), F.lit(3 + 114 * 3 // 2 + 12)))).withColumn("y", F.explode(F.sequence(F.lit(2 + 15 - 12), F.lit(2 + 51 + 12))))
    off = F.when(F.col("p_size") % 5 == 1, 6.0).otherwise(0.0)
    at = lambda v, o, start: F.floor(((F.col(v) - o - off) / 1.5 - F.col(start)) * 6 / _SIDE)
    rows = rows.withColumn("c", at("x", 3, "x1")).withColumn("r", at("y", 2, "y1"))
    inner = F.col("c").between(1, 4) & F.col("r").between(1, 4)
    bit = F.floor(_code(F.col("marker")) / F.pow(F.lit(2.0), (F.col("r") - 1) * 4 + F.col("c") - 1)) % 2
    bit = F.when((F.col("p_size") % 3 == 0) & (F.col("r") == 2) & (F.col("c") == 3), 1 - bit).otherwise(bit)
    black = F.col("c").between(0, 5) & F.col("r").between(0, 5) & (F.col("p_size") % 7 > 0)
    px = rows.select("scan", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.when(black & ~(inner & (bit == 1)), 30).otherwise(220).alias("gray"))
    found = marks.where("marker % 4 <> 2").select("scan", "marker")
    seen = F.array(*[F.lit(float(v)) for v in (1.5, 0, 3, 0, 1.5, 2, 0, 0, 1)])
    quads = recovery.lost(marks, found, marks.select("scan", seen.alias("h")).distinct())
    cells = recovery.sampled_cells(quads, px, 6, 2, [(0, 0), (6, 6)])
    return recovery.recovered(cells, mine.select("marker", _code(F.col("marker")).alias("code")), 4, 1, 0.2)

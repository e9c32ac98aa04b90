"""Queries over whole scans: their maps, sheets and frames from the markers in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.operators import points, scans
from sparkreel.plans.base import query
from sparkreel.session import spread, table

L = F.lit

#: Ten parts are a scan with a marker in each of ten places of one of three sheets; a sixth are lost, some are taken for another
#: sheet's, some are seen far off. The scan shows the layout 1.5 times as large, 5 and 4 pixels off.
_SEEN = "m as (select p_partkey // 10 scan, p_partkey % 10 place, p_partkey k, (p_partkey // 10) % 3 own, case when p_size % 11 = 1 then (p_partkey // 10 + 1) % 3 else (p_partkey // 10) % 3 end taken, p_size % 13 = 3 off from part where p_size % 6 > 0)"
_VOTES = _SEEN + """, c as (select scan, taken, count(*) n from m group by all), b as (select scan, max(n) n from c group by scan), w as (select scan, any_value(taken) sheet from c join b using (scan, n) group by scan having count(*) = 1),
r as (select scan, count(*) markers, 4 * count(*) filter (where not off) inliers from m group by scan)"""


def _scans(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    seen = table(spark, d, "part").where(s % 6 > 0).select(F.floor(k / 10).alias("scan"), (k % 10).alias("place"), k.alias("k"), s.alias("s"))
    sheet = F.col("scan") % 3
    x, y = F.col("place") * 30.0, (F.col("place") * F.col("place") % 7) * 10.0
    off = F.when(F.col("s") % 13 == 3, 40.0 + F.col("k") % 5 * 13).otherwise(0.0)
    at = lambda v, o: v * 1.5 + o
    corners = points.corners(at(x, 5) + off, at(y, 4), at(x + 8, 5) + off, at(y + 8, 4))
    found = seen.select("scan", (F.col("place") * 3 + F.when(F.col("s") % 11 == 1, (sheet + 1) % 3).otherwise(sheet)).alias("marker"), corners.alias("corners"))
    sheets = spark.range(3).select(F.col("id").alias("sheet"), F.transform(F.sequence(L(0), L(9)), lambda p: (p * 3 + F.col("id")).cast("long")).alias("ids"))
    p = F.col("id")
    boxes = spark.range(10).select(p.alias("place"), (p * 30).alias("x1"), (p * p % 7 * 10).alias("y1"), (p * 30 + 8).alias("x2"), (p * p % 7 * 10 + 8).alias("y2"))
    return found, sheets, boxes


@query(f"with {_VOTES} select r.scan, markers, inliers, sheet, case when sheet is null then 'no sheet has most of the markers' end as error from r left join w using (scan)")
def scan_reports(spark, d):
    found, sheets, boxes = _scans(spark, d)
    return scans.scan_report(found, sheets, scans.scan_maps(found, sheets, boxes))


@query(f"""with {_VOTES}, f as (select w.scan, w.sheet, 'frame' || w.sheet as label, 40 + 10 * w.sheet x1, unnest(range(0, 5)) x from w), g as (select *, unnest(range(0, 3)) y from f),
u as (select scan, label, x, y, (x1 + (x + 0.5::double) * 20 / 5 - 0.5) * 1.5 + 5 u, (40 + (y + 0.5::double) * 12 / 3 - 0.5) * 1.5 + 4 v from g)
select scan, label, cast(x as bigint) x, cast(y as bigint) y, cast(floor(round(u + 2 * v + scan % 40, 4) + 0.5) as bigint) gray from u""")
def scan_frames(spark, d):
    """Frames cut out of every scan by its map, straightened."""
    found, sheets, boxes = _scans(spark, d)
    maps = scans.scan_maps(found, sheets, boxes)
    n = F.col("id")
    frames = spark.range(3).select(n.alias("sheet"), F.concat(L("frame"), n.cast("string")).alias("label"), (n * 10 + 40).alias("x1"), L(40).alias("y1"), (n * 10 + 60).alias("x2"), L(52).alias("y2"), L(5).alias("w"), L(3).alias("h"))
    # the part of each scan that frames lie in: grays rise evenly
    px = spread(found.select("scan").distinct(), "scan").withColumn("x", F.explode(F.sequence(L(60).cast("long"), L(130).cast("long")))).withColumn("y", F.explode(F.sequence(L(60).cast("long"), L(90).cast("long"))))
    px = px.withColumn("gray", F.col("x") + 2 * F.col("y") + F.col("scan") % 40)
    return scans.cut_out(scans.scan_report(found, sheets, maps), maps, frames, px)

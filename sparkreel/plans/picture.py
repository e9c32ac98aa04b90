"""Queries over rasters, tone curves and marker points."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.operators import align, identity, raster, tone
from sparkreel.plans.base import GRAY8, MARKERS, RESPONSE, gray8, markers, query, response
from sparkreel.session import spread, table

HIST = "h as (select a.img, b.gray, count(px.gray) n from (select distinct img from px) a cross join (select unnest(range(0, 256)) gray) b left join px on px.img = a.img and px.gray = b.gray group by a.img, b.gray)"


@query(f"with {GRAY8} select b.gray, count(px.gray) n from (select unnest(range(0, 256)) gray) b left join px on px.gray = b.gray group by b.gray")
def histogram256(spark, d):
    return raster.histogram(gray8(spark, d))


@query(f"""with {GRAY8}, {HIST}, c as (select img, gray, sum(n) over u w0, sum(n * gray) over u s0, sum(n) over a w, sum(n * gray) over a s from h window u as (partition by img order by gray rows between unbounded preceding and current row), a as (partition by img)),
v as (select img, gray, round(cast(w0 as double) * (w - w0) * (s0 / w0::double - (s - s0) / (w - w0)::double) * (s0 / w0::double - (s - s0) / (w - w0)::double), 6) var from c where w0 > 0 and w0 < w),
r as (select img, gray, row_number() over (partition by img order by var desc, gray) k from v) select img, gray threshold from r where k = 1""")
def otsu_threshold(spark, d):
    return raster.otsu(raster.histogram(gray8(spark, d), "img"))


@query(f"with {GRAY8} select img, x, y, gray from px")
def minmax_normalize(spark, d):
    return gray8(spark, d)


MEAN = """m as (select img, x, y, gray, sum(gray) over (partition by img, y order by x rows between 2 preceding and 2 following) inner_sum,
  first_value(gray) over (partition by img, y order by x) f, last_value(gray) over (partition by img, y order by x rows between unbounded preceding and unbounded following) l from px p),
mean as (select img, x, y, gray, (inner_sum + greatest(0, 2 - x) * f + greatest(0, x - 5) * l) / 5.0::double mean from m)"""


@query(f"with {GRAY8}, {MEAN} select img, x, y, gray, round(mean, 6) mean from mean")
def box_blur_rows(spark, d):
    return raster.box_mean(gray8(spark, d), 2).withColumn("mean", F.round("mean", 6))


@query(f"with {GRAY8}, {MEAN} select img, x, y, cast(case when gray < mean - 7 then 255 else 0 end as bigint) gray from mean")
def adaptive_threshold(spark, d):
    return raster.box_mean(gray8(spark, d), 2).select("img", "x", "y", F.when(F.col("gray") < F.col("mean") - 7, 255).otherwise(0).cast("long").alias("gray"))


@query(f"with {GRAY8} select img, x // 2 x, y // 2 y, round(avg(gray), 6) gray from px group by all")
def proxy_area_mean(spark, d):
    return raster.area_mean(gray8(spark, d), 2).withColumn("gray", F.round("gray", 6))


@query(f"with {GRAY8} select img, 7 - x x, y, gray from px")
def flip(spark, d):
    return raster.flipped(gray8(spark, d), 8)


@query(f"with {GRAY8} select img, x - 2 x, y - 1 y, gray from px where x between 2 and 5 and y between 1 and 6")
def crop_fixed(spark, d):
    return raster.cropped(gray8(spark, d), 2, 1, 4, 6)


@query(f"""with {GRAY8}, p as (select img, y, unnest(range(-3, 11)) o from px where x = 0), i as (select img, y, o, ((o % 16) + 16) % 16 m from p)
select i.img, i.o x, i.y, px.gray from i join px on px.img = i.img and px.y = i.y and px.x = case when m < 8 then m else 15 - m end""")
def reflect_pad(spark, d):
    px = gray8(spark, d)
    padded = px.where("x = 0").select("img", "y", F.explode(F.sequence(F.lit(-3), F.lit(10)).cast("array<bigint>")).alias("o"))
    padded = padded.withColumn("x", raster.reflected(F.col("o"), 8))
    return padded.join(px, ["img", "x", "y"]).select("img", F.col("o").alias("x"), "y", "gray")


@query(f"with {GRAY8} select img, cast(list_sort(list(gray))[count(*) // 2 + 1] as bigint) paper from px where x = 0 or x = 7 or y = 0 or y = 7 group by img")
def paper_colour(spark, d):
    return gray8(spark, d).where("x in (0, 7) or y in (0, 7)").groupBy("img").agg(F.expr("percentile_disc(0.5) within group (order by gray desc)").cast("long").alias("paper"))


STOPS = ((0, 255), (20, 210), (35, 120), (50, 20))


@query("with " + RESPONSE + ", s(d0, v0, d1, v1) as (values (0, 255, 20, 210), (20, 210, 35, 120), (35, 120, 50, 20)) select grp, density, round(v0 + (v1 - v0) * (density - d0) / (d1 - d0)::double, 6) ink from resp join s on density > d0 and density <= d1")
def ink_ramp(spark, d):
    ink = F.lit(float(STOPS[0][1]))
    for (d0, v0), (d1, v1) in zip(STOPS[:-1], STOPS[1:], strict=True):
        ink = F.when(F.col("density") > d0, v0 + (v1 - v0) * (F.col("density") - d0) / (d1 - d0)).otherwise(ink)
    return response(spark, d).select("grp", "density", F.round(ink, 6).alias("ink"))


@query("with " + RESPONSE + ", c as (select *, sum(luma) over (partition by grp order by density) c from resp), e as (select *, min(c) over (partition by grp) lo, max(c) over (partition by grp) hi from c) select grp, density, round((c - lo) / (hi - lo), 6) cdf from e")
def content_cdf(spark, d):
    return tone.cdf(response(spark, d), "grp", "density", "luma").select("grp", "density", F.round("cdf", 6).alias("cdf"))


@query("with " + RESPONSE + " select grp, density, round(density * 5.1 * 0.4 + 0.6 * luma, 6) blended from resp")
def lut_blend(spark, d):
    return response(spark, d).select("grp", "density", F.round(F.col("density") * 5.1 * 0.4 + 0.6 * F.col("luma"), 6).alias("blended"))


@query("with " + RESPONSE + ", p as (select *, row_number() over (partition by grp order by density) i, sum(luma) over (partition by grp order by density) s from resp), j as (select a.grp, a.i j, b.i k, (b.s - a.s + a.luma) / (b.i - a.i + 1) m from p a join p b on a.grp = b.grp and b.i >= a.i), l as (select grp, j, k, min(m) over (partition by grp, j order by k desc) m from j), f as (select grp, k i, max(m) fit from l group by grp, k) select grp, density, luma, round(fit, 5) fit from p join f using (grp, i)")
def isotonic(spark, d):
    return tone.isotonic(response(spark, d), "grp", "density", "luma").withColumn("fit", F.round("fit", 5))


@query("with " + RESPONSE + ", p as (select *, row_number() over (partition by grp order by density) i, count(*) over (partition by grp) n from resp), h as (select *, least(3, i - 1, n - i) h from p) select a.grp, a.density, a.luma, round(avg(b.luma), 5) smooth from h a join p b on a.grp = b.grp and b.i between a.i - a.h and a.i + a.h group by all")
def smooth_adaptive(spark, d):
    return tone.moving_mean(response(spark, d), "grp", "density", "luma", 3).withColumn("smooth", F.round("smooth", 5))


@query("with " + RESPONSE + """, p as (select grp, density x, max(luma) over (partition by grp order by density) y from resp), w as (select *, x - lag(x) over (partition by grp order by x) h0, lead(x) over (partition by grp order by x) - x h1, y - lag(y) over (partition by grp order by x) e0, lead(y) over (partition by grp order by x) - y e1 from p),
s as (select *, case when h0 is null then e1 / h1 when h1 is null then e0 / h0 when (e0 / h0) * (e1 / h1) > 0 then 3 * (h0 + h1) / ((2 * h1 + h0) / (e0 / h0) + (h1 + 2 * h0) / (e1 / h1)) else 0 end d from w),
n as (select *, lead(y) over (partition by grp order by x) y1, lead(d) over (partition by grp order by x) d1 from s)
select grp, x, round((y + y1) / 2 + h1 * (d - d1) / 8, 5) mid from n where y1 is not null""")
def pchip_eval(spark, d):
    rows = tone.running_max(response(spark, d), "grp", "density", "luma", "y").select("grp", F.col("density").alias("x"), "y")
    w = W.partitionBy("grp").orderBy("x")
    rows = tone.slopes(rows, "grp", "x", "y").withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "d1": F.lead("d").over(w)}).where("y1 is not null")
    return rows.select("grp", "x", F.round(tone.hermite(F.lit(0.5), F.col("x1") - F.col("x"), F.col("y"), F.col("y1"), F.col("d"), F.col("d1")), 5).alias("mid"))


@query("with " + RESPONSE + """, p as (select grp, density x, max(luma) over (partition by grp order by density) y from resp), t as (select distinct grp, unnest([98.0, 104.0, 108.0])::double want from resp), a as (select t.grp, want, max(x) x0 from t join p on p.grp = t.grp and p.y <= want group by all),
b as (select a.grp, want, x0, min(p.x) x1 from a left join p on p.grp = a.grp and p.x > x0 group by all)
select b.grp, want, round(coalesce(x0 + (x1 - x0) * (want - p0.y) / (p1.y - p0.y), x0), 5) density from b join p p0 on p0.grp = b.grp and p0.x = x0 left join p p1 on p1.grp = b.grp and p1.x = x1""")
def inverse_interp(spark, d):
    rows = tone.running_max(response(spark, d), "grp", "density", "luma", "y")
    return tone.inverse_at(rows, "grp", "density", "y", [98, 104, 108]).withColumn("density", F.round("density", 5))


@query("with " + RESPONSE + ", p as (select *, row_number() over (partition by grp order by density) i, count(*) over (partition by grp) n from resp) select grp, round((max(luma) - min(luma)) / 255, 6) as range, avg(luma) filter (where i * 4 <= n) > avg(luma) filter (where (n - i) * 4 < n) + 8 inverted, (max(luma) - min(luma)) / 255 < 0.1 or count(*) < 3 flat from p group by grp")
def response_flags(spark, d):
    rows = response(spark, d).withColumn("i", F.row_number().over(W.partitionBy("grp").orderBy("density"))).withColumn("n", F.count("*").over(W.partitionBy("grp")))
    span = (F.max("luma") - F.min("luma")) / 255
    head, tail = F.avg(F.when(F.col("i") * 4 <= F.col("n"), F.col("luma"))), F.avg(F.when((F.col("n") - F.col("i")) * 4 < F.col("n"), F.col("luma")))
    return rows.groupBy("grp").agg(F.round(span, 6).alias("range"), (head > tail + 8).alias("inverted"), ((span < 0.1) | (F.count("*") < 3)).alias("flat"))


@query("with m as (select l_returnflag grp, l_linestatus print, l_quantity patch, round(avg(l_tax) * 1000, 4) v from lineitem group by all), a as (select patch, avg(v) mean, max(v) - min(v) spread from m group by patch) select patch, round(mean, 1) mean, spread > 3 uneven from a")
def print_average_spread(spark, d):
    prints = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", F.col("l_quantity").alias("patch")).agg(F.round(F.avg("l_tax") * 1000, 4).alias("v"))
    ordered = F.aggregate(F.array_sort(F.collect_list("v")), F.lit(0.0), lambda a, x: a + x) / F.count("v")  # the same sum for any order of rows
    return prints.groupBy("patch").agg(F.round(ordered, 1).alias("mean"), (F.max("v") - F.min("v") > 3).alias("uneven"))


@query(f"with {MARKERS}, p as (select a.sheet, sqrt((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy)) / sqrt((a.lx - b.lx) * (a.lx - b.lx) + (a.ly - b.ly) * (a.ly - b.ly)) r, sqrt((a.lx - b.lx) * (a.lx - b.lx) + (a.ly - b.ly) * (a.ly - b.ly)) n from mk a join mk b on a.sheet = b.sheet and a.id < b.id), q as (select sheet, round(list_sort(list(r))[count(*) // 2 + 1], 6) scale, count(*) pairs from p where n > 1 group by sheet) select sheet, scale, coalesce(pairs, 0) pairs from (select distinct sheet from mk) left join q using (sheet)")
def scale_theta_median(spark, d):
    return align.scale(markers(spark, d), "sheet").withColumn("scale", F.round("scale", 6))


@query(f"with {MARKERS}, r as (select sheet, id, sx - 1.25::double * lx ax, sy - 1.25::double * ly ay from mk), m as (select sheet, avg(ax) mx, avg(ay) my from r group by sheet) select sheet, round(avg(sqrt((ax - mx) * (ax - mx) + (ay - my) * (ay - my))), 6) mean_error, count(*) n from r join m using (sheet) group by sheet")
def residual_mean(spark, d):
    m = markers(spark, d)
    rows = align.residuals(m, "sheet", m.select("sheet", F.lit(1.25).alias("scale")).distinct())
    return rows.groupBy("sheet").agg(F.round(F.avg("error"), 6).alias("mean_error"), F.count("*").alias("n"))


@query(f"with {MARKERS}, r as (select sheet, lx, ly, sx - 1.25::double * lx - 7 ex, sy - 1.25::double * ly - 3 ey from mk), b as (select distinct sheet, unnest(range(0, 4)) box from mk), w as (select b.sheet, box, ex, ey, 1 / ((lx - box * 50) * (lx - box * 50) + (ly - box * 40) * (ly - box * 40) + 25.0::double) w from b join r using (sheet)) select sheet, box, round(sum(w * ex) / sum(w), 6) dx, round(sum(w * ey) / sum(w), 6) dy from w group by sheet, box")
def local_shift_idw(spark, d):
    m = markers(spark, d)
    points = m.withColumns({"ex": F.col("sx") - 1.25 * F.col("lx") - 7, "ey": F.col("sy") - 1.25 * F.col("ly") - 3})
    boxes = m.select("sheet").distinct().select("sheet", F.explode(F.expr("sequence(0L, 3L)")).alias("box")).withColumns({"bx": F.col("box") * 50, "by": F.col("box") * 40})
    return align.local_shift(boxes, points, "sheet", 25.0).withColumns({"dx": F.round("dx", 6), "dy": F.round("dy", 6)})


@query(f"with {MARKERS}, p as (select a.sheet, case when abs(a.lx - b.lx) > 40 then (a.sx - b.sx) / (a.lx - b.lx) end rx, case when abs(a.ly - b.ly) > 40 then (a.sy - b.sy) / (a.ly - b.ly) end ry from mk a join mk b on a.sheet = b.sheet and a.id < b.id) select sheet, round(list_sort(list(rx) filter (where rx is not null))[count(rx) // 2 + 1], 6) scale_x, round(list_sort(list(ry) filter (where ry is not null))[count(ry) // 2 + 1], 6) scale_y from p group by sheet")
def printer_scale_axes(spark, d):
    return align.axis_scale(markers(spark, d), "sheet", 40).withColumns({"scale_x": F.round("scale_x", 6), "scale_y": F.round("scale_y", 6)})


@query("""with b0 as (select i id, (i * 40503 + 9973) * 2654435761 % 65536 c from (select unnest(range(0, 50)) i)), bits as (select id, k, (c >> k) & 1 b from b0, (select unnest(range(0, 16)) k)),
t as (select id, k, b, k // 4 r, k % 4 q from bits), code as (
  select id, 0 rot, sum(b << (4 * r + q)) c from t group by id union all select id, 1, sum(b << (4 * q + 3 - r)) from t group by id
  union all select id, 2, sum(b << (4 * (3 - r) + 3 - q)) from t group by id union all select id, 3, sum(b << (4 * (3 - q) + r)) from t group by id),
m as (select p_partkey, cast(bit_count(xor(cast(p_partkey * 7919 % 65536 as bigint), cast(c as bigint))) as bigint) errors, rot, id from part, code), k as (select *, row_number() over (partition by p_partkey order by errors, rot, id) n from m)
select p_partkey, id marker, cast(rot as bigint) rot, errors from k where n = 1 and errors <= 3""")
def hamming_match(spark, d):
    seen = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7919 % 65_536).cast("int").alias("bits"))
    return identity.nearest_code(seen, identity.code_book(spark, 50), "bits", 3).drop("bits")


@query("""with p as (select p_partkey p, p_size s from part), g as (select p, (s * 3)::double d, 0 i, 200 r, 180 g, 160 b from p where s % 5 > 0 union all select p, least(255, s + 60.5::double * (s % 4)), 1, 10, 20 + s, 30 from p where s % 5 > 0),
a as (select *, row_number() over (partition by p order by d, i) k, count(*) over (partition by p) n from g),
b as (select p, d, i, r, g, b from a union all select p, 0, -1, 255, 255, 255 from a where k = 1 and d > 0.5 union all select p, 255, 9, r, g, b from a where k = n and d < 254.5 union all select p, 0, 0, 255, 255, 255 from p where s % 5 = 0 union all select p, 255, 1, s, 40, 50 from p where s % 5 = 0),
c as (select *, row_number() over (partition by p order by d, i) - 1 k, count(*) over (partition by p) n from b), x as (select p, n, x, (select count(*) from c where c.p = q.p and c.k > 0 and c.d < x) k from (select distinct p, n from c) q, (select unnest(range(0, 256)) x)),
v as (select x.p, x, lo.r lr, lo.g lg, lo.b lb, hi.r hr, hi.g hg, hi.b hb, case when hi.d > lo.d then greatest(0, least(1, (x - lo.d) / (hi.d - lo.d))) else 0 end t from x join c lo on lo.p = x.p and lo.k = x.k join c hi on hi.p = x.p and hi.k = least(x.k + 1, x.n - 1))
select p p_partkey, cast(sum(floor(round(lr + (hr - lr) * t, 9) + 0.5) * (x + 1)) as bigint) r, cast(sum(floor(round(lg + (hg - lg) * t, 9) + 0.5) * (x + 1)) as bigint) g, cast(sum(floor(round(lb + (hb - lb) * t, 9) + 0.5) * (x + 1)) as bigint) b from v group by p""")
def ink_ramps(spark, d):
    """The 256 colours of ramps with two stops or none, summed by their places."""
    s = F.col("p_size")
    stop = lambda at, r, g, b: F.struct(at.cast("double").alias("d"), F.lit(r).alias("r"), g.cast("int").alias("g"), F.lit(b).alias("b"))
    stops = F.array(stop(s * 3, 200, F.lit(180), 160), stop(F.least(F.lit(255.0), s + 60.5 * (s % 4)), 10, 20 + s, 30))
    parts = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = tone.ink_ramps(parts, F.when(s % 5 > 0, stops), F.struct(s.alias("r"), F.lit(40).alias("g"), F.lit(50).alias("b")))
    return rows.groupBy("p_partkey").agg(*[F.sum(F.col(k) * (F.col("x") + 1)).alias(k) for k in "rgb"])


@query("with p as (select p_partkey, p_size * 3.0::double x, p_partkey % 70 * 1.0::double y from part), q as (select *, (0.9::double * x + 0.1::double * y - 4) / (0.002::double * x + 1) u, (0.05::double * x + 1.1::double * y - 3) / (0.002::double * x + 1) v from p) select p_partkey, u between 0 and 99 and v between 0 and 59 as covered from q")
def covered_points(spark, d):
    """Which points of a sheet a scan of 100 by 60 has."""
    from sparkreel.operators import fill

    seen = (0.9, 0.1, -4.0, 0.05, 1.1, -3.0, 0.002, 0.0, 1.0)
    return table(spark, d, "part").select("p_partkey", fill.covers(F.col("p_size") * 3.0, F.col("p_partkey") % 70 * 1.0, seen, 100, 60).alias("covered"))

"""Queries over tone curves of charts and strips."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.operators import curves
from sparkreel.plans.base import query
from sparkreel.session import table

PRINTS = "prints as (select l_returnflag grp, l_linestatus print, l_quantity patch, ((sum(cast(round(l_extendedprice * 100) as bigint))::bigint * 2 + 3 * count(*)) // (6 * count(*)))::double v from lineitem group by all)"
AVERAGE = PRINTS + ", av0 as (select grp, patch, list_sort(list(v)) vs from prints group by grp, patch), av1 as (select *, list_sum(vs) / len(vs) m from av0), av as (select grp, patch, floor(m / 1000 + 0.5) / 10 mean, case when len(vs) > 1 then list_sum(list_transform(vs, lambda x: abs(x - m))) / len(vs) / 10000 end off, len(vs) prints from av1)"
POINTS = AVERAGE + ", p as (select grp, patch * 5.1::double x, mean y, row_number() over (partition by grp order by patch) - 1 i, count(*) over (partition by grp) n from av)"
SMOOTH = POINTS + """, o as (select *, unnest(range(-(v // 2), v // 2 + 1)) k from (select *, greatest(3, (n // 16) | 1) v from p)),
sm as (select o.grp, o.x, o.i, o.n, case when o.i = 0 or o.i = o.n - 1 then any_value(o.y) else sum(b.y) / any_value(v) end y from o join p b on b.grp = o.grp and b.i = case when o.i + k < 0 then -(o.i + k) when o.i + k >= o.n then 2 * o.n - 2 - (o.i + k) else o.i + k end group by o.grp, o.x, o.i, o.n)"""


def _averages(spark, d):
    # whole ten-thousandths, half up: no engine's rounding of a double decides
    whole = F.expr("(sum(cast(round(l_extendedprice * 100) as bigint)) * 2 + 3 * count(*)) div (6 * count(*))")
    prints = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("print"), F.col("l_quantity").alias("patch")).agg(whole.alias("v"))
    return curves.averaged_prints(prints, "grp", "patch", "v", 10_000)


def _curves(spark, d):
    return curves.curve_rows(_averages(spark, d).select("grp", (F.col("patch") * 5.1).alias("x"), F.col("mean").alias("y")), "grp", "x", "y")


@query(f"with {AVERAGE} select grp, patch, mean, off, cast(prints as bigint) prints from av")
def print_averages(spark, d):
    return _averages(spark, d)


@query(f"with {AVERAGE}, s as (select grp, avg(off) / greatest(max(mean) - min(mean), 1e-9) spread from av group by grp) select grp, round(spread, 4) spread, coalesce(spread > 0.03, false) uneven from s")
def print_spread_note(spark, d):
    return curves.uneven_prints(_averages(spark, d), "grp").withColumn("spread", F.round("spread", 4))


@query(f"with {SMOOTH} select grp, round(x, 6) x, round(y, 6) y from sm")
def smooth_window(spark, d):
    rows = _curves(spark, d).select("grp", F.explode(F.arrays_zip("x", curves.smooth_adaptive(F.col("y")).alias("y"))).alias("p"))
    return rows.select("grp", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"""with {SMOOTH}, c as (select *, sum(y) over (partition by grp order by i) s from sm), j as (select a.grp, a.i j, b.i k, (b.s - a.s + a.y) / (b.i - a.i + 1) m from c a join c b on a.grp = b.grp and b.i >= a.i),
l as (select grp, j, k, min(m) over (partition by grp, j order by k desc) m from j), f as (select grp, k i, max(m) fit from l group by grp, k),
e as (select grp, greatest((max(fit) - min(fit)) * 1e-9, 1e-12) eps from f group by grp),
r as (select sm.grp, sm.x, sm.i, sm.n, f.fit + eps * (row_number() over (partition by sm.grp, round(f.fit, 9) order by sm.i) - 1) y from sm join f using (grp, i) join e using (grp)),
w as (select *, x - lag(x) over u h0, lead(x) over u - x h1, (y - lag(y) over u) / (x - lag(x) over u) d0, (lead(y) over u - y) / (lead(x) over u - x) d1 from r window u as (partition by grp order by i)),
m as (select *, case when d0 is null then d1 when d1 is null then d0 when d0 * d1 <= 0 then 0 else 3 * (h0 + h1) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) end m from w),
g as (select *, lead(x) over u x1, lead(y) over u y1, lead(m) over u m1 from m window u as (partition by grp order by i)),
q as (select g.grp, q.i q, 255.0::double * q.i / 2047 d, (255.0::double * q.i / 2047 - x) / h1 t, h1, y, y1, m, m1 from (select unnest(range(0, 2048)) i) q join g on x1 is not null and (255.0::double * q.i / 2047 >= x or g.i = 0) and (255.0::double * q.i / 2047 < x1 or g.i = n - 2)),
v as (select grp, q, d, max((2 * t * t * t - 3 * t * t + 1) * y + (t * t * t - 2 * t * t + t) * h1 * m + (3 * t * t - 2 * t * t * t) * y1 + (t * t * t - t * t) * h1 * m1) over (partition by grp order by q) y from q),
a as (select grp, arg_min(y, q) y0, arg_max(y, q) yn from v group by grp),
z as (select v.grp, v.q, v.d, unnest(range(v.q - 15, v.q + 16)) k from v),
zz as (select z.grp, z.q, any_value(z.d) d, sum(case when k < 0 then 2 * y0 - b.y when k > 2047 then 2 * yn - b.y else b.y end) / 31 y from z join a using (grp) join v b on b.grp = z.grp and b.q = case when k < 0 then -k when k > 2047 then 4094 - k else k end group by z.grp, z.q),
s as (select grp, q, d, max(y) over (partition by grp order by q) y from zz), b as (select grp, min(y) lo, max(y) hi from s group by grp),
t as (select grp, lo, hi, gray, lo + gray / 255.0::double * (hi - lo) t from b, (select unnest(range(0, 256)) gray)),
k as (select t.grp, gray, t, lo, hi, max(q) q from t join s on s.grp = t.grp and s.y <= t.t group by all)
select k.grp, gray, round(greatest(0, least(255, case when t <= lo then 0 when t >= hi then 255 else a.d + (b.d - a.d) * (t - a.y) / greatest(b.y - a.y, 1e-12) end)) * 100) / 100 value from k join s a on a.grp = k.grp and a.q = least(k.q, 2046) join s b on b.grp = k.grp and b.q = least(k.q, 2046) + 1""")
def chart_lut(spark, d):
    rows = curves.chart_lut(_curves(spark, d)).select("grp", F.posexplode("lut").alias("gray", "value"))
    return rows.withColumn("gray", F.col("gray").cast("long"))


@query(f"with {POINTS}, s as (select grp, max(n) n, (max(y) - min(y)) / 255 range, avg(y) filter (where i < greatest(1, n // 4)) > avg(y) filter (where i >= n - greatest(1, n // 4)) + 8 inverted from p group by grp) select grp, round(range, 6) range, inverted, range < 0.1 flat, case when n < 40 then 'too few patches' when inverted then 'inverted' when range < 0.1 then 'flat' end error from s")
def chart_response(spark, d):
    return curves.check_response(_curves(spark, d), 40).select("grp", F.round("range", 6).alias("range"), "inverted", "flat", "error")


HIST = "hs as (select f.grp, g.g, coalesce(h.n, 0)::double n from (select distinct l_returnflag grp from lineitem) f cross join (select unnest(range(0, 256)) g) g left join (select l_returnflag grp, cast(l_quantity * 5 as bigint) g, count(*) n from lineitem group by all) h on h.grp = f.grp and h.g = g.g)"
CDF = HIST + """, ho as (select *, unnest(range(-10, 11)) k from hs), hm as (select o.grp, o.g, sum(b.n) / 21 n from ho o join hs b on b.grp = o.grp and b.g = greatest(0, least(255, o.g + o.k)) group by o.grp, o.g),
hh as (select grp, g, (n / sum(n) over (partition by grp) + 0.15::double / 256) / 1.15::double h from hm), hc as (select grp, g, sum(h) over (partition by grp order by g) c from hh),
cdf as (select grp, g, (c - min(c) over (partition by grp)) / (max(c) over (partition by grp) - min(c) over (partition by grp)) c from hc)"""


def _histograms(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), (F.col("l_quantity") * 5).cast("int").alias("g")).agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("m"))
    return maps.select("grp", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("h"))


@query(f"with {CDF} select grp, g, round(c, 6) c from cdf")
def content_cdf_curve(spark, d):
    rows = _histograms(spark, d).select("grp", F.posexplode(curves.content_cdf(F.col("h"))).alias("g", "c"))
    return rows.select("grp", F.col("g").cast("long").alias("g"), F.round("c", 6).alias("c"))


@query(f"with {CDF}, b as (select unnest(range(0, 256)) g), l as (select g, g * 0.3::double + 0.7::double * g * g / 255.0::double v from b), x as (select grp, g, 255 * (0.6::double * g / 255 + 0.4::double * c) x from cdf), f as (select *, cast(greatest(0, least(255, floor(x))) as bigint) lo from x) select f.grp, f.g, round(greatest(0, least(255, a.v * (1 - (x - lo)) + b.v * (x - lo))), 5) v from f join l a on a.g = f.lo join l b on b.g = least(255, f.lo + 1)")
def effective_curve(spark, d):
    lut = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: i * i / F.lit(255.0))
    rows = _histograms(spark, d).select("grp", F.posexplode(curves.effective_lut(lut, 70, 40, F.col("h"))).alias("g", "v"))
    return rows.select("grp", F.col("g").cast("long").alias("g"), F.round("v", 5).alias("v"))


LEVELS = (0, 64, 128, 191, 255)
STRIPS = """st as (select vec_id, embedding::double[] e from embeddings), pt as (select vec_id, i, [0, 64, 128, 191, 255][i + 1] lv, round(40 + 40 * i + 60 * e[i + 1], 3) x, [12, 70, 120, 185, 240][i + 1] ref from st, (select unnest(range(0, 5)) i))"""


def _strips(spark, d):
    e = table(spark, d, "embeddings")
    measured = F.array(*[F.round(40 + 40 * i + 60 * F.get("embedding", F.lit(i)).cast("double"), 3) for i in range(5)])
    return e.select("vec_id", measured.alias("m"), F.array(*map(F.lit, LEVELS)).alias("l"))


@query(f"""with recursive {STRIPS}, r(vec_id, i, px, py, pts) as (select vec_id, 0::bigint, x, ref, [x] from pt where i = 0
  union all select p.vec_id, p.i, case when p.x - px < 2.55 or p.ref <= py then px else p.x end, case when p.x - px < 2.55 or p.ref <= py then py else p.ref end, case when p.x - px < 2.55 or p.ref <= py then pts else list_append(pts, p.x) end from r join pt p on p.vec_id = r.vec_id and p.i = r.i + 1)
select vec_id, cast(len(pts) as bigint) points, round(list_sum(pts), 3) total from r where i = 4 and len(pts) > 1""")
def patch_curves(spark, d):
    reference = F.array(*[F.lit(v) for v in (12, 70, 120, 185, 240)])
    rows = _strips(spark, d).select("vec_id", curves.level_curve(F.col("m"), F.col("l"), reference).alias("c")).where("c is not null")
    return rows.select("vec_id", F.size("c").cast("long").alias("points"), F.round(F.aggregate("c", F.lit(0.0), lambda a, p: a + p["x"]), 3).alias("total"))


@query(f"with {STRIPS}, s as (select vec_id, max(x) filter (where i = 0) a, max(x) filter (where i = 4) b from pt group by vec_id) select vec_id, v, cast(greatest(0, least(255, round((v - a) * 255 / (b - a)))) as bigint) as level from s, (select unnest([0, 50, 100, 200, 255]) v) where b - a >= 2.55")
def apply_level_curves(spark, d):
    rows = _strips(spark, d).select("vec_id", curves.level_curve(F.col("m"), F.col("l")).alias("c")).where("c is not null")
    return rows.select("vec_id", "c", F.explode(F.array(*[F.lit(v) for v in (0, 50, 100, 200, 255)])).alias("v")).select("vec_id", "v", curves.on_level_curve(F.col("c"), F.col("v")).alias("level"))


@query("""with px as (select l_suppkey grp, l_linenumber patch, l_quantity * 3 + l_linenumber * 12 r, l_discount * 900 + l_linenumber * 15 g from lineitem), m as (select grp, patch, list_sort(list(r))[count(*) // 2 + 1] r, list_sort(list(g))[count(*) // 2 + 1] g from px group by all),
s as (select grp, count(*) n, arg_min(r, patch) r0, arg_max(r, patch) r1, arg_min(g, patch) g0, arg_max(g, patch) g1 from m group by grp) select grp, n as patches, n > 1 and r1 - r0 >= 12.75 and g1 - g0 >= 12.75 usable, round(case when n > 1 and r1 - r0 >= 12.75 and g1 - g0 >= 12.75 then r1 + g1 end, 6) top from s""")
def measure_patches(spark, d):
    items = table(spark, d, "lineitem")
    px = items.select(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("patch"), (F.col("l_quantity") * 3 + F.col("l_linenumber") * 12).alias("r"), (F.col("l_discount") * 900 + F.col("l_linenumber") * 15).alias("g"))
    out = curves.measured_strip(px.withColumn("level", F.col("patch")), "grp", "patch", ["r", "g"], "level")
    last = F.element_at("measured", -1)
    return out.select("grp", F.size("levels").cast("long").alias("patches"), F.col("measured").isNotNull().alias("usable"), F.round(F.get(last, F.lit(0)) + F.get(last, F.lit(1)), 6).alias("top"))

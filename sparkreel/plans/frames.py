"""Queries over deep video frames, folders in use, conforming of sequences and decoding in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.operators import deep, readers
from sparkreel.operators.placing import little
from sparkreel.plans.base import GRAY8, gray8, query
from sparkreel.session import table

L = F.lit

#: Luma of 7 by 6 and colours of half that or less, made of rasters of 8 by 8; `far` codes pass the largest one.
_PLANES = GRAY8 + """, lu as (select img, x, y, case when gray = 255 then 5000 else gray * {step} + x end v from px where x < 7 and y < 6),
ch as (select img, x, y, (255 - gray) * {step} + y u, gray * {step} v from px where x < {cw} and y < {ch})"""


def _bilinear(sx: int, sy: int, cw: int, ch: int) -> str:
    fy = "greatest((y + 0.5::double) / 2 - 0.5, 0)" if sy == 2 else "y::double"
    return f"""pl as (select img, x, y, least(v, {{top}}) luma, floor(x / {sx}::double) x0, x / {sx}::double - floor(x / {sx}::double) ax, floor({fy}) y0, {fy} - floor({fy}) ay from lu),
nb as (select img, x, y, luma, least(x0 + i, {cw - 1}) cx, least(y0 + j, {ch - 1}) cy, (case when i = 0 then 1 - ax else ax end * case when j = 0 then 1 - ay else ay end)::double w from pl, (select unnest([0, 1]) i), (select unnest([0, 1]) j)),
cc as (select nb.img, nb.x, nb.y, luma, sum(least(ch.u, {{top}}) * w) cu, sum(least(ch.v, {{top}}) * w) cv from nb join ch on ch.img = nb.img and ch.x = cx and ch.y = cy group by all)"""


def _rgb(sx: int, sy: int, bits: int, full: bool, kr: float, kb: float) -> str:
    cw, ch, top, unit = -(-7 // sx), -(-6 // sy), (1 << bits) - 1, 1 << (bits - 8)
    y, c = (f"luma / {top}.0::double", "({} - " + f"{1 << (bits - 1)}) / {top}.0::double") if full else (f"(luma - {16 * unit}) / {219 * unit}.0::double", "({} - " + f"{128 * unit}) / {224 * unit}.0::double")
    cb, cr, kg = c.format("cu"), c.format("cv"), 1 - kr - kb
    red, blue = 2 * (1 - kr), 2 * (1 - kb)
    whole = "cast(floor(round(greatest(0, least(1, {})) * 65535, 6) + 0.5) as bigint)"
    body = _PLANES.format(step=1 << (bits - 8), cw=cw, ch=ch) + ", " + _bilinear(sx, sy, cw, ch).format(top=top)
    return f"""with {body} select img, cast(x as bigint) x, cast(y as bigint) y, {whole.format(f"{y} + {red}::double * {cr}")} r, {whole.format(f"{y} - {blue}::double * {kb}::double / {kg}::double * {cb} - {red}::double * {kr}::double / {kg}::double * {cr}")} g, {whole.format(f"{y} + {blue}::double * {cb}")} b from cc"""


def _planes(spark, d, bits: int, cw: int, ch: int):
    px, step = gray8(spark, d), 1 << (bits - 8)
    luma = px.where("x < 7 and y < 6").select("img", "x", "y", F.when(F.col("gray") == 255, 5000).otherwise(F.col("gray") * step + F.col("x")).alias("luma"))
    return luma, px.where(f"x < {cw} and y < {ch}").select("img", "x", "y", ((255 - F.col("gray")) * step + F.col("y")).alias("u"), (F.col("gray") * step).alias("v"))


@query(_rgb(2, 2, 10, False, *deep.WEIGHTS["bt709"]))
def yuv_420p10(spark, d):
    return deep.rgb16(*_planes(spark, d, 10, 4, 3), 7, 6, "I420", 10, "bt709", False)


@query(_rgb(2, 1, 12, True, *deep.WEIGHTS["bt2020"]))
def yuv_422p12(spark, d):
    return deep.rgb16(*_planes(spark, d, 12, 4, 6), 7, 6, "I422", 12, "bt2020", True)


@query(_rgb(1, 1, 10, True, *deep.WEIGHTS["bt601"]))
def yuv_444p10(spark, d):
    return deep.rgb16(*_planes(spark, d, 10, 7, 6), 7, 6, "I444", 10, "bt601", True)


@query(f"with {GRAY8}, t as (select img, x, y, gray * 257 v, img % 4 k from px where x < 5 and y < 3) select img, cast(case k when 0 then x when 1 then 2 - y when 2 then 4 - x else y end as bigint) x, cast(case k when 0 then y when 1 then x when 2 then 2 - y else 4 - x end as bigint) y, cast(v as bigint) as value from t")
def planes_read_and_turned(spark, d):
    """Planes of 5 by 3 read from bytes with a longer stride behind a head of 6 bytes, and turned by what each frame says."""
    row = gray8(spark, d).where("x < 5 and y < 3").groupBy("img", "y").agg(F.array_sort(F.collect_list(F.struct("x", "gray"))).alias("p"))
    bytes_ = F.aggregate("p", L(b""), lambda a, p: F.concat(a, little(p["gray"] * 257, 2)))
    rows = row.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("y", F.concat(bytes_, L(b"\xee" * 4)).alias("b")))).alias("r"))
    frames = rows.select("img", F.aggregate("r", L(b"\xdd" * 6), lambda a, r: F.concat(a, r["b"])).alias("data"))
    return deep.turned(deep.plane(frames, 5, 3, L(6), L(14), "value"), 5, 3, F.col("img") % 4 * 90)


_HOLDS = """h as (select user_id cache, ts start, case when event_id % 7 > 0 then ts + to_hours(cast(floor(value % 90) as int)) end as "end", case when event_id % 5 = 0 then ts + to_hours(1) end narrowed from events where event_type in ('view', 'click')),
c as (select user_id cache, ts tm, row_number() over (partition by user_id order by ts) - 1 generation from events where event_type = 'purchase'),
g as (select h.*, (select count(*) from c where c.cache = h.cache and c.tm < h.start) gen from h),
p as (select c.cache, c.generation, c.tm, case when gen = c.generation then g."end" when g."end" is null then narrowed when narrowed is null then g."end" else least(g."end", narrowed) end until, g.start from c left join g on g.cache = c.cache and g.start <= c.tm)"""


@query(f"""with {_HOLDS} select cache, cast(generation as bigint) generation, floor(epoch(tm))::bigint cleared, case when count(*) filter (where start is not null and until is null) = 0 then floor(epoch(greatest(tm, coalesce(max(until), tm))))::bigint end deleted from p group by cache, generation, tm""")
def held_folders(spark, d):
    """When each cleared folder of a cache can be deleted, readers holding it, some without an end."""
    e = table(spark, d, "events").select(F.col("user_id").alias("cache"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id", "value")
    later = lambda n: (F.unix_seconds("ts") + n * 3600).cast("timestamp")
    kind = F.col("event_type")
    ends = F.when(F.col("event_id") % 7 > 0, later(F.floor(F.col("value") % 90)))
    holds = e.where(kind.isin("view", "click")).select("cache", F.col("ts").alias("start"), ends.alias("end"), F.when(F.col("event_id") % 5 == 0, later(L(1))).alias("narrowed"))
    out = readers.deletions(e.where(kind == "purchase").select("cache", F.col("ts").alias("at")), holds, "cache")
    return out.select("cache", F.col("generation").cast("long").alias("generation"), F.unix_seconds("cleared").alias("cleared"), F.unix_seconds("deleted").alias("deleted"))


_INFOS = """i as (select distinct p_size content, 320 + case p_size % 4 when 1 then 3 when 2 then 100 else 0 end w, 180 + case p_size % 4 when 3 then 2 else 0 end h, p_size % 3 = 0 sixteen, p_size % 11 = 0 alpha, p_size % 5 > 0 png, case when p_size % 2 = 0 then 2 else 6 end colour from part),
s as (select p_brand grp, p_partkey pos, p_size content from part), u as (select grp, content, count(*) uses, min(pos) first, any_value(i.w) w, any_value(i.h) h, any_value(sixteen) sixteen, any_value(alpha) alpha, any_value(png) png, any_value(colour) colour from s join i using (content) group by all),
z as (select grp, w bw, h bh from (select grp, w, h, row_number() over (partition by grp order by sum(uses) desc, min(first)) k from u group by grp, w, h) where k = 1), k as (select grp, bool_or(sixteen) deep, bool_or(alpha) al from u group by grp),
v as (select u.*, bw, bh, deep, al, case when png and w = bw and h = bh and sixteen = deep and colour = case when al then 6 else 2 end then 'copy' when abs(w - bw) <= greatest(4, bw // 100) and abs(h - bh) <= greatest(4, bh // 100) then 'centre' else 'resize' end verdict from u join z using (grp) join k using (grp))"""


def _sequence(spark, d):
    p, s = table(spark, d, "part"), F.col("p_size")
    infos = p.select(s.alias("content"), (320 + F.when(s % 4 == 1, 3).when(s % 4 == 2, 100).otherwise(0)).alias("w"), (180 + F.when(s % 4 == 3, 2).otherwise(0)).alias("h"), (s % 3 == 0).alias("sixteen"), (s % 11 == 0).alias("alpha"), (s % 5 > 0).alias("png"), F.when(s % 2 == 0, 2).otherwise(6).alias("colour"))
    return readers.conform_plan(p.select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("pos"), s.alias("content")), infos.distinct(), "grp", "content")


@query(f"with {_INFOS} select grp, cast(any_value(bw) as bigint) w, cast(any_value(bh) as bigint) h, any_value(deep) sixteen, any_value(al) alpha, cast(sum(uses) as bigint) frames, count(*) as unique, count(*) filter (where verdict = 'copy') passthrough, count(*) filter (where verdict <> 'copy') conform, count(*) filter (where verdict = 'resize') resized from v group by grp")
def conform_plans(spark, d):
    plan, _ = _sequence(spark, d)
    return plan.withColumns({"w": F.col("w").cast("long"), "h": F.col("h").cast("long")})


@query(f"with {_INFOS} select s.grp, s.pos, s.content, verdict from s join v on v.grp = s.grp and v.content = s.content")
def conform_verdicts(spark, d):
    return _sequence(spark, d)[1]


@query("""with f as (select l_suppkey % 3 file, l_orderkey * 1000 + l_linenumber * 7 + l_suppkey as tm, max(l_quantity) content from lineitem group by all), a as (select o_custkey % 4 file, o_orderkey ordinal, o_orderkey * 1000 + o_custkey % 900 as tm from orders)
select a.file, a.ordinal, a.tm as "at", f.content from a asof left join f on a.file = f.file and a.tm >= f.tm""")
def decoded_in_one_pass(spark, d):
    """Frames asked for out of order from a few large files, served stretch by stretch in time order."""
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    frames = items.groupBy((F.col("l_suppkey") % 3).alias("file"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 7 + F.col("l_suppkey")).alias("at")).agg(F.max("l_quantity").alias("content"))
    asks = orders.select((F.col("o_custkey") % 4).alias("file"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") * 1000 + F.col("o_custkey") % 900).alias("at"))
    return readers.in_one_pass(asks, frames, "file", "at", "content")

"""Queries over decoder logs, memory, stores, file tables and whole-picture filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.operators import fill, identity, logs, media, raster, sinks, state
from sparkreel.plans.base import GRAY8, SLOTS, gray8, query, slots
from sparkreel.session import table

L = F.lit

_FORMATS = ("yuv420p", "yuv420p10le", "yuvj422p", "yuv444p12le", "gbrp16le", "nv12")
_TAGS = ("(tv, bt709)", "(pc)", "", "(tv, bt2020nc/bt2020/arib-std-b67, progressive)", "(smpte170m)")
_TURNS = ("", "displaymatrix: rotation of 90.00 degrees", "Display Matrix: rotation of -180.00 degrees", "displaymatrix: rotation of -90.00 degrees")


@query(f"""with p as (select p_partkey, p_size, ({list(_FORMATS)})[p_partkey % 6 + 1] f, p_partkey % 5 t, p_partkey % 4 r from part)
select p_partkey, 3600.0::double * (p_partkey % 10) + 60 * p_size + 7.25 as duration, cast(p_size * 16 + 100 as bigint) as width, cast(p_size * 9 + 50 as bigint) as height, (20 + p_size % 10 + 0.5)::double as fps, cast([0, 270, 180, 90][r + 1] as bigint) as rotation, f as format,
cast(case f when 'yuv420p10le' then 10 when 'yuv444p12le' then 12 when 'gbrp16le' then 16 else 8 end as bigint) as depth, t = 1 or f = 'yuvj422p' as "full", t in (0, 1, 3) or f = 'yuvj422p' as known, case t when 0 then 'bt709' when 3 then 'bt2020' when 4 then 'bt601' end as matrix,
case f when 'yuv420p10le' then 'I420P10' when 'yuv444p12le' then 'I444P12' end as planes, cast(case f when 'yuv420p10le' then 2 when 'yuv444p12le' then 1 end as bigint) as sx from p""")
def probe_logs(spark, d):
    n, s = F.col("p_partkey"), F.col("p_size")
    pick = lambda xs: F.get(F.array(*map(L, xs)), (n % len(xs)).cast("int"))
    log = F.format_string("Input #0\n  Duration: %02d:%02d:07.25, start: 0.0\n  Stream #0:0: Video: hevc (Main 10), %s%s, %dx%d, %d.5 fps, 24 tbr\n  %s", n % 10, s.cast("long"), pick(_FORMATS), pick(_TAGS), (s * 16 + 100).cast("long"), (s * 9 + 50).cast("long"), (20 + s % 10).cast("long"), pick(_TURNS))
    rows = table(spark, d, "part").select("p_partkey", logs.probed(log).alias("i"))
    planes = logs.planar_format(F.col("i.pix.format"))
    return rows.select("p_partkey", "i.duration", "i.width", "i.height", "i.fps", "i.rotation", "i.pix.*", planes["format"].alias("planes"), planes["sx"].alias("sx"))


@query("""with p as (select p_partkey, p_size / 4.0::double a, (p_size + p_partkey % 5 - 2) / 4.0::double b from part) select p_partkey, case when b > a then null else 'the range from ' || printf('%.2f s', a) || ' to ' || printf('%.2f s', b) || ' is empty; the video lasts 9.50 s' end as problem from p""")
def range_problems(spark, d):
    a, b = F.col("p_size") / 4, (F.col("p_size") + F.col("p_partkey") % 5 - 2) / 4
    return table(spark, d, "part").select("p_partkey", media.range_problem(a, b, L(9.5)).alias("problem"))


@query("""with p as (select p_brand, p_partkey, p_size, ['.JPG', '.tif', '.png'][p_partkey % 3 + 1] k, (p_size % 7 - 4) * 10.0::double b from part), g as (select *, case when greatest(-100, least(20, b)) < 0 then 1 + 0.25 * ((1 - 2 * b / 100) * (1 - 2 * b / 100) - 1) else 1 end g from p),
e as (select *, p_size * 1000000 * case k when '.JPG' then 12 when '.tif' then 2.5 else 5 end * 3.5::double * g peak from g) select p_brand, cast(least(greatest(1, floor(8e9 * 0.3 / greatest(1, max(peak)))), 8, count(*), 3) as bigint) as at_once, round(max(peak) / 1e6, 3) as peak_mb, round(max(p_size * 1000.0::double * 700 * 6 * 2.5 * g) / 1e6, 3) as header_mb from e group by p_brand""")
def scan_memory(spark, d):
    name = F.concat(L("scan"), F.get(F.array(L(".JPG"), L(".tif"), L(".png")), (F.col("p_partkey") % 3).cast("int")))
    bleed, size = (F.col("p_size") % 7 - 4) * 10.0, F.col("p_size").cast("double")
    scans = table(spark, d, "part").select("p_brand", L(False).alias("single"), media.scan_peak(name, size * 1e6, L(False), bleed).alias("peak"), media.header_peak(size * 1000, L(700), L(True), bleed).alias("header"))
    at_once = media.scans_at_once(scans, "p_brand", "peak", 8.0, 8, False, "single")
    return at_once.join(scans.groupBy("p_brand").agg(F.round(F.max("peak") / 1e6, 3).alias("peak_mb"), F.round(F.max("header") / 1e6, 3).alias("header_mb")), "p_brand")


_STORES = "c as (select case when c_mktsegment = 'BUILDING' then 'flags' else c_mktsegment end kind, cast(c_nationkey as varchar) as name, c_custkey as value, coalesce(c_acctbal < 4000, true) old from customer)"


@query(f"with {_STORES}, o as (select kind, name, min(value) v from c where old group by all), n as (select kind, name, min(value) v from c where not old and kind <> 'flags' group by all) select coalesce(o.kind, n.kind) as kind, coalesce(o.name, n.name) as name, coalesce(o.v, n.v) as value from o full join n on o.kind = n.kind and o.name = n.name")
def stores_moved(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "flags").otherwise(F.col("c_mktsegment")).alias("kind"), F.col("c_nationkey").cast("string").alias("name"), F.col("c_custkey").alias("value"), F.coalesce(F.col("c_acctbal") < 4000, L(True)).alias("old"))
    return state.merged_stores(c.where("old").drop("old"), c.where("not old").drop("old"))


@query("""with m as (select c_nationkey, c_mktsegment n, min(c_custkey) v from customer group by all), s as (select * from m where n not in ('BUILDING', 'MACHINERY') union all select distinct c_nationkey, 'MACHINERY', -1 from m) select cast(c_nationkey as bigint) c_nationkey, string_agg(n, '|' order by n) as names, cast(sum(v) as bigint) as total from s group by c_nationkey""")
def profile_edits(spark, d):
    m = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("v"))
    m = m.groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "v"))).alias("m"))
    m = m.withColumn("m", state.deleted(state.saved("m", L("MACHINERY"), L(-1).cast("long")), L("BUILDING")))
    return m.select("c_nationkey", F.array_join(state.listed("m"), "|").alias("names"), F.aggregate(F.map_values("m"), L(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("""with f as (select user_id, max(ts) last, bool_or(event_type = 'error') closed, user_id % 7 = 0 as locked, max(ts) filter (where event_type = 'purchase') as output from events group by user_id), a as (select *, epoch(timestamp '2024-01-30 00:00:00') - epoch(last) age, epoch(timestamp '2024-01-30 00:00:00') - epoch(output) old from f)
select user_id, coalesce(old > 600, true) as emptied from a where (closed or not (age > -300 and age < 3600)) and not locked""")
def storage_sweep(spark, d):
    kind = F.col("event_type")
    folders = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.bool_or(kind == "error").alias("closed"), F.max(F.when(kind == "purchase", F.col("ts"))).alias("output"))
    return state.swept(folders.withColumn("locked", F.col("user_id") % 7 == 0), "user_id", "2024-01-30 00:00:00")


@query("""with r as (select user_id, event_id, ts, event_type = 'error' failed, lead(ts) over (partition by user_id order by ts) after, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts) run from events), f as (select *, count(*) filter (where failed) over (partition by user_id, run order by ts) fails from r)
select event_id, fails, fails < 3 or coalesce(epoch(after) - epoch(ts) >= 60, false) allowed from f where failed""")
def boot_retry_three(spark, d):
    rows = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return state.retry_allowed(rows, "user_id", "ts", "failed", 3, 60.0).where("failed").select("event_id", "fails", "allowed")


@query("select p_brand, count(*) as entries, cast(sum(30 + strlen(p_name) + 20 + p_size * 1000 + 24) as bigint) as directory_at, cast(sum(74 + strlen(p_name)) as bigint) as directory_bytes, cast(sum(30 + strlen(p_name) + 20 + p_size * 1000 + 24 + 74 + strlen(p_name)) + 98 as bigint) as bytes from part group by p_brand")
def zip_tails(spark, d):
    return sinks.archive_tails(table(spark, d, "part").select("p_brand", "p_name", (F.col("p_size") * 1000).cast("long").alias("size")), "p_brand", "p_name", "size")


@query(f"""with {SLOTS}, c as (select grp, pos // 24 as second, 0 kind, pos idx, pos % 7 * 100 + 50 size from slots union all select grp, pos // 24, 1, pos // 24, 88200 from slots group by grp, pos // 24),
o as (select *, cast(8 + coalesce(sum(size) over (partition by grp order by second, kind, idx rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from c)
select grp, cast(kind as bigint) kind, row_number() over (partition by grp, kind order by second) as chunk, min("offset") as "offset", count(*) as samples, cast(sum(size) as bigint) as bytes from o group by grp, kind, second""")
def mov_chunks(spark, d):
    frames = slots(spark, d).select("grp", F.floor(F.col("pos") / 24).alias("second"), F.col("pos").alias("idx"), (F.col("pos") % 7 * 100 + 50).alias("size"))
    sound = frames.select("grp", "second").distinct().select("grp", "second", F.col("second").alias("idx"), L(88_200).cast("long").alias("size"))
    return sinks.chunks(sinks.interleaved(frames, sound, "grp"), "grp").withColumns({"kind": F.col("kind").cast("long"), "offset": F.col("offset").cast("long")})


@query("""with p as (select p_brand, p_partkey, p_size, p_brand || '_' || cast(p_size as varchar) as label from part) select p_brand, count(*) as scans, count(*) filter (where p_size % 5 <> 0) as scans_ok, count(distinct label) filter (where p_size % 3 <> 0) as extracted, count(distinct label) as expected, coalesce(string_agg(distinct label, ',' order by label) filter (where p_size % 3 = 0), '') as missing from p group by p_brand""")
def report_summary(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_size", F.concat_ws("_", "p_brand", "p_size").alias("label"), (F.col("p_size") % 5 != 0).alias("ok"))
    return sinks.report_summary(p, p, p.where("p_size % 3 <> 0"), "p_brand").withColumn("missing", F.array_join("missing", ","))


def _mean(source: str, to: str, radius: int, along: str) -> str:
    """A clamped moving mean as SQL: a join of every pixel with the places around it."""
    x, y = (f"greatest(0, least(7, p.{c} + k))" if c == along else f"p.{c}" for c in "xy")
    return f"{to} as (select p.img, p.x, p.y, avg(q.v) v from {source} p cross join (select unnest(range({-radius}, {radius + 1})) k) join {source} q on q.img = p.img and q.x = {x} and q.y = {y} group by p.img, p.x, p.y)"


_BLUR = ", ".join(_mean(f"b{i}", f"b{i + 1}", 2, "xy"[i % 2]) for i in range(6))


@query(f"with {GRAY8}, b0 as (select img, x, y, gray::double v from px), {_BLUR} select img, cast(x as bigint) x, cast(y as bigint) y, round(v, 4) as mean from b6")
def blur_three_times(spark, d):
    return raster.blurred(gray8(spark, d), 1.0).select("img", "x", "y", F.round("mean", 4).alias("mean"))


@query(f"with {GRAY8}, b0 as (select img, x, y, gray::double v from px), {_mean('b0', 'b1', 1, 'x')}, {_mean('b1', 'b2', 1, 'y')} select img, cast(x as bigint) x, cast(y as bigint) y, cast(case when b0.v < round(b2.v - 7, 9) then 255 else 0 end as bigint) gray from b0 join b2 using (img, x, y)")
def adaptive_threshold_inv(spark, d):
    return raster.darker_than_around(gray8(spark, d), 3, 7.0)


@query(f"""with {GRAY8}, s as (select img, x, y, case when x between 1 and 6 and y between -1 and 5 and (x in (1, 6) or y in (-1, 5)) then 200 else gray end gray from px), t as (select s.img, s.x, s.y, coalesce(o.gray, s.gray) gray from s left join px o on o.img = s.img and s.x - 5 = 7 - o.x and s.y - 6 = o.y)
select img, cast(x as bigint) x, cast(y as bigint) y, cast(255 - gray as bigint) as inverse, cast(gray * 257 as bigint) as wide, cast(gray as bigint) as narrow from t""")
def pixel_basics(spark, d):
    px = gray8(spark, d)
    out = raster.pasted(raster.stroked(px, 1, -1, 7, 6, 1, 200), raster.flipped(px, 8), 5, 6)
    wide = raster.widened(F.col("gray"))
    return out.select("img", "x", "y", raster.inverted(F.col("gray")).alias("inverse"), wide.alias("wide"), raster.narrowed(wide).alias("narrow"))


@query(f"with {GRAY8}, i as (select distinct img from px), a as (select img, x, y from i, (select unnest(range(0, 12)) x), (select unnest(range(0, 13)) y)) select a.img, cast(a.x as bigint) x, cast(a.y as bigint) y, cast(case when a.x - 2 between 0 and 7 and a.y - 3 between 0 and 7 then coalesce(px.gray, 0) else 255 end as bigint) gray from a left join px on px.img = a.img and px.x = a.x - 2 and px.y = a.y - 3 and px.x + px.y < 12")
def crop_legacy(spark, d):
    return fill.crop_filled(gray8(spark, d).where("x + y < 12"), 8, 8, -2, -3, 12, 13, fill.fill_mode("unknown"))


@query("""with u as (select *, row_number() over (partition by p_brand, p_size order by p_partkey) n from part), h as (select p_brand scan, p_partkey ord, case p_partkey % 4 when 0 then case when p_size % 9 <= 4 then p_size % 9 when p_size between 10 and 30 then p_size % 7 end when 2 then case when p_size between 10 and 30 then p_size % 7 end end sheet from u where n = 1)
select scan, cast(arg_min(sheet, ord) as bigint) as sheet from h where sheet is not null group by scan""")
def identified_sheets(spark, d):
    n, s = F.col("p_partkey"), F.col("p_size").cast("long")
    part, label = table(spark, d, "part"), F.concat(L("lab"), s.cast("string"))
    code = lambda project: identity.payload(L(project), s % 9, L(9), label)
    text = F.when(n % 4 == 0, code("proj")).when(n % 4 == 1, code("other")).when(n % 4 == 2, label).when(n % 8 == 3, "K2|proj|x|9|lab12")
    texts = part.select(F.col("p_brand").alias("scan"), L("proj").alias("project"), n.alias("ord"), s.alias("box"), text.alias("text"))
    own = part.select(L("proj").alias("project"), label.alias("label"), s.alias("s")).distinct()
    return identity.identified_sheets(texts, own.select("project", (F.col("s") % 9).alias("sheet")).where("sheet <= 4"), own.where("s between 10 and 30").select("project", "label", (F.col("s") % 7).alias("sheet")))

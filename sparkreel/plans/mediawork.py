"""Queries over sampling times, sound and media facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.operators import logs, media, timeline
from sparkreel.plans.base import KEEP, query, slots
from sparkreel.session import table

L = F.lit


@query("""with s as (select p_partkey, p_size / 8.0::double a, p_size / 8.0::double + (p_size % 5) * 0.5::double b from part), n as (select *, greatest(1, cast(ceil((b - 1e-9 - a) * 4) as bigint)) n from s) select p_partkey, k, a + k / 4.0::double t from (select p_partkey, a, unnest(range(0, n)) k from n)""")
def sample_times(spark, d):
    spans = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 8).alias("a"), (F.col("p_size") / 8 + (F.col("p_size") % 5) * 0.5).alias("b"))
    return media.sample_times(spans, "a", "b", 4.0).select("p_partkey", "k", "t")


@query(f"""with {KEEP}, o as (select *, cast(coalesce(sum("to" - "from") over (partition by grp order by "from" rows between unbounded preceding and 1 preceding), 0) as bigint) before from keep), f as (select grp, "from", before, unnest(range(before, before + "to" - "from")) i from o) select grp, cast(i as bigint) i, round(("from" + i - before) / 24.0::double, 6) t from f""")
def sound_times(spark, d):
    from pyspark.sql import Window as W

    spans = timeline.keep_intervals(slots(spark, d), "grp", "content")
    before = F.coalesce(F.sum(F.col("to") - F.col("from")).over(W.partitionBy("grp").orderBy("from").rowsBetween(W.unboundedPreceding, -1)), L(0))
    spans = spans.withColumn("at", before)
    frames = spans.withColumn("i", F.explode(F.sequence("at", F.col("at") + F.col("to") - F.col("from") - 1)))
    return frames.select("grp", "i", F.round(media.sound_time(F.col("i"), F.col("from"), F.col("at"), 24.0), 6).alias("t"))


@query("""with b as (select user_id grp, event_id block, (epoch(ts) - 1700000000)::double / 1000 stamp, 48000 rate, 24000 * (1 + event_id % 3) count from events), e as (select *, stamp + count / rate::double stop from b),
a as (select grp, 0 ask, min(stamp) + 0.2::double start, 900.75::double duration from b group by grp union all select grp, 1, min(stamp) - 1, 1.1::double from b group by grp), j as (select e.*, ask, start, duration, start + duration astop from e join a using (grp) where stamp < start + duration and stop > start),
f as (select *, case when stamp < start then cast(floor((start - stamp) * rate + 0.5) as bigint) else 0 end f, case when stop > astop then cast(floor((astop - stamp) * rate + 0.5) as bigint) else count end t, greatest(1, cast(floor(duration * rate + 0.5) as bigint)) alls from j),
p as (select *, greatest(0, cast(floor((stamp + f / rate::double - start) * rate + 0.5) as bigint)) place from f) select grp, cast(ask as bigint) ask, block, place as "at", f as "from", least(t - f, alls - place) n from p where least(t - f, alls - place) > 0""")
def pcm_placement(spark, d):
    seconds = (F.col("ts").cast("timestamp").cast("double") - 1_700_000_000) / 1000
    b = table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("block"), seconds.alias("stamp"), L(48_000).cast("long").alias("rate"), (24_000 * (1 + F.col("event_id") % 3)).alias("count"))
    low = b.groupBy("grp").agg(F.min("stamp").alias("m"))
    asks = low.select("grp", F.explode(F.array(F.struct(L(0).cast("long").alias("ask"), (F.col("m") + 0.2).alias("start"), L(900.75).alias("duration")), F.struct(L(1).cast("long").alias("ask"), (F.col("m") - 1).alias("start"), L(1.1).alias("duration")))).alias("a")).select("grp", "a.*")
    return media.placed_blocks(b, asks, "grp")


_CODECS = ("vp09.00.10.08", "vp09.02.10.12", "av01.0.04M.10", "av01.0.04H.08.0", "hvc1.2.4.L153", "hev1.A1.6.L93", "avc1.640028", "avc1.6E0032", "avc3.7A0033", "mp4v.20.9", "")
_DEPTHS = (8, 12, 10, 8, 10, 8, 8, 10, 10, None, None)


@query(f"""with c(codec, depth) as (values {", ".join(f"('{c}', {'null' if x is None else x})" for c, x in zip(_CODECS, _DEPTHS, strict=True))}), p as (select p_partkey, p_size, ({list(_CODECS)})[p_partkey % {len(_CODECS)} + 1] codec, ['bt709', 'smpte170m', 'bt2020-ncl', 'rgb', null][p_size % 5 + 1] m, [0, 480, 576, 1080][p_partkey % 4 + 1] h from part)
select p_partkey, cast(depth as bigint) depth, case m when 'bt709' then 'bt709' when 'smpte170m' then 'bt601' when 'bt2020-ncl' then 'bt2020' when 'rgb' then null else case when h > 576 then 'bt709' when h > 0 then 'bt601' end end matrix, cast((p_size + 3) // 4 * 4 as bigint) w, cast(p_size + p_size % 2 as bigint) h from p join c using (codec)""")
def media_columns(spark, d):
    s, n = F.col("p_size"), F.col("p_partkey")
    codec = F.get(F.array(*map(L, _CODECS)), (n % len(_CODECS)).cast("int"))
    matrix = media.colour_matrix(F.get(F.array(L("bt709"), L("smpte170m"), L("bt2020-ncl"), L("rgb"), L(None)), s % 5), F.get(F.array(*map(L, (0, 480, 576, 1080))), (n % 4).cast("int")))
    return table(spark, d, "part").select("p_partkey", logs.codec_depth(codec).alias("depth"), matrix.alias("matrix"), media.encode_size(s, s).alias("e")).select("p_partkey", "depth", "matrix", "e.w", "e.h")


@query("select event_id, cast(hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2 as bigint) as time, cast((greatest(1980, year(ts)) - 1980) * 512 + month(ts) * 32 + day(ts) as bigint) as date, case when event_id * 70001 > 1000000000 then printf('%.1f GB', event_id * 70001 / 1e9) when event_id * 70001 > 1000000 then printf('%.1f MB', event_id * 70001 / 1e6) else cast(cast(floor(event_id * 70001 / 1000.0::double + 0.5) as bigint) as varchar) || ' KB' end as size from events")
def archive_columns(spark, d):
    n = F.col("event_id") * 70_001
    rows = table(spark, d, "events").select("event_id", media.dos_datetime(F.col("ts")).alias("t"), media.bytes_text(n).alias("size"))
    return rows.select("event_id", "t.time", "t.date", "size")


@query("""with p as (select p_partkey, p_size * 10 w, p_size * 12 + 5 h from part), k as (select *, least(w, h) s from p) select p_partkey, cast(case when s >= 360 then 1 else greatest(1, least(greatest(2, round(400.0::double / s)), floor(sqrt(500000.0::double / (w * h))))) end as bigint) factor from k""")
def upscale_factors(spark, d):
    return table(spark, d, "part").select("p_partkey", media.upscale_factor(F.col("p_size") * 10, F.col("p_size") * 12 + 5, 500_000).alias("factor"))


@query("with p as (select p_brand, max(p_size * 100000) * 12.0::double peak from part group by p_brand) select p_brand, peak, greatest(1, cast(floor(100000000 / peak) as bigint)) pages from p")
def pages_in_flight(spark, d):
    return media.pages_in_flight(table(spark, d, "part").select("p_brand", (F.col("p_size") * 100_000).alias("px")), "p_brand", "px", 12.0, 100_000_000)


@query("""with p as (select p_partkey, ['hvc1.2.4.L153', 'hev1.1.6.L93', 'avc1.6E0032', 'avc1.640028', 'avc3.7A0033'][p_partkey % 5 + 1] codec, p_size % 8 d, p_size % 3 n, p_size % 2 cut from part)
select p_partkey, cast(case when codec like 'h%' then case when cut = 0 then d + 8 when codec like 'hvc1.2%' then 10 else 8 end when codec = 'avc1.640028' then 8 when cut = 0 then d + 8 else 10 end as bigint) depth from p""")
def codec_boxes(spark, d):
    """Depths by configuration boxes, whole and cut short: HEVC at its byte 17, high AVC behind its parameter sets."""
    from sparkreel.operators.placing import big

    n, s = F.col("p_partkey"), F.col("p_size")
    codec = F.get(F.array(*map(L, ("hvc1.2.4.L153", "hev1.1.6.L93", "avc1.6E0032", "avc1.640028", "avc3.7A0033"))), (n % 5).cast("int"))
    depth, sets = big(240 + s % 8, 1), s % 3
    one = F.concat(big(3, 2), L(b"\x01\x02\x03"))
    many = F.when(sets == 0, L(b"")).when(sets == 1, one).otherwise(F.concat(one, one))
    hevc = F.concat(L(bytes(17)), depth, L(bytes(5)))
    avc = F.concat(L(bytes(5)), big(224 + sets, 1), many, big(1, 1), one, L(b"\xfd"), depth, L(b"\xf8\x00"))
    box = F.when(codec.startswith("h"), hevc).otherwise(avc)
    box = F.when(s % 2 == 1, F.substring(box, 1, 6)).otherwise(box)
    return table(spark, d, "part").select("p_partkey", logs.codec_depth(codec, box).alias("depth"))


@query("""with b as (select user_id grp, event_id block, (epoch(ts) - 1700000000)::double / 1000 stamp, 8 rate, 4 * (1 + event_id % 3) count from events), e as (select *, stamp + count / rate::double stop from b),
a as (select grp, 0 ask, min(stamp) + 0.2::double start, 900.75::double duration from b group by grp union all select grp, 1, min(stamp) - 1, 1.1::double from b group by grp), j as (select e.*, ask, start, duration, start + duration astop from e join a using (grp) where stamp < start + duration and stop > start),
f as (select *, case when stamp < start then cast(floor((start - stamp) * rate + 0.5) as bigint) else 0 end f, case when stop > astop then cast(floor((astop - stamp) * rate + 0.5) as bigint) else count end t, greatest(1, cast(floor(duration * rate + 0.5) as bigint)) alls from j),
p as (select *, greatest(0, cast(floor((stamp + f / rate::double - start) * rate + 0.5) as bigint)) place from f), q as (select *, least(t - f, alls - place) n from p where least(t - f, alls - place) > 0),
s as (select grp, ask, place + i pos, arg_max((block * 31 + (f + i) * 17) % 60000 - 30000, block) v from (select *, unnest(range(0, n)) i from q) group by all),
z as (select grp, ask, sec, least(8, alls - sec * 8) n from (select distinct grp, ask, alls, unnest(range(0, (alls - 1) // 8 + 1)) as sec from q))
select z.grp, cast(z.ask as bigint) ask, z.sec as "second", cast(any_value(z.n) as bigint) n, cast(coalesce(sum(v * (pos % 8 + 1)), 0) as bigint) as "sum" from z left join s on s.grp = z.grp and s.ask = z.ask and s.pos // 8 = z.sec group by all""")
def sound_seconds(spark, d):
    """Seconds of asked sound with silence between the blocks: how long each is, and a sum of its samples by their places."""
    from sparkreel.operators import sound

    seconds = (F.col("ts").cast("timestamp").cast("double") - 1_700_000_000) / 1000
    count = (4 * (1 + F.col("event_id") % 3)).cast("int")
    samples = F.transform(F.sequence(L(0), count - 1), lambda i: ((F.col("event_id") * 31 + i * 17) % 60_000 - 30_000).cast("smallint"))
    b = table(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("block"), seconds.alias("stamp"), L(8).cast("long").alias("rate"), L(1).cast("long").alias("channels"), samples.alias("samples"))
    low = b.groupBy("grp").agg(F.min("stamp").alias("m"))
    asks = low.select("grp", F.explode(F.array(F.struct(L(0).cast("long").alias("ask"), (F.col("m") + 0.2).alias("start"), L(900.75).alias("duration")), F.struct(L(1).cast("long").alias("ask"), (F.col("m") - 1).alias("start"), L(1.1).alias("duration")))).alias("a")).select("grp", "a.*")
    out = sound.seconds_of_sound(b, asks, "grp")
    n = (F.octet_length("content") / 2).cast("int")
    byte = lambda k: F.conv(F.hex(F.substring("content", k, L(1))), 16, 10).cast("long")
    value = lambda i: F.when(byte(2 * i + 2) > 127, byte(2 * i + 1) + byte(2 * i + 2) * 256 - 65_536).otherwise(byte(2 * i + 1) + byte(2 * i + 2) * 256)
    total = F.aggregate(F.sequence(L(0), n - 1), L(0).cast("long"), lambda a, i: a + value(i) * (i + 1))
    return out.select("grp", "ask", "second", n.cast("long").alias("n"), total.alias("sum"))

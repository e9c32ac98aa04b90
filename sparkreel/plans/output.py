"""Queries over identities, reports, file layouts, sound and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.operators import identity, sinks, state
from sparkreel.plans.base import query, slots, SLOTS
from sparkreel.session import table


@query("with s as (select o_orderkey, unnest(range(0, 4)) i from orders) select o_orderkey, i, i * 12 + case when i % 2 = 0 then o_orderkey % 12 else (o_orderkey // 12) % 12 end marker from s")
def marker_ids_for_sheet(spark, d):
    ids = table(spark, d, "orders").select("o_orderkey", F.posexplode(identity.sheet_marker_ids(F.col("o_orderkey"), 50, 4)).alias("i", "marker"))
    return ids.withColumn("i", F.col("i").cast("long"))


@query("""with g as (select * from (values (0, 2, 3, 210, 297), (1, 3, 4, 210, 297), (2, 2, 3, 297, 210), (3, 3, 4, 297, 210)) t(ord, c, r, pw, ph)), p as (select p_partkey, p_size * 4 + 40 w, 200 - p_size * 2 h from part),
a as (select p_partkey, c, r, ord, round(w * h * least(pw / c::double / w, ph / r::double / h) * least(pw / c::double / w, ph / r::double / h), 9) area from p, g), k as (select *, row_number() over (partition by p_partkey order by area desc, ord) n from a)
select p_partkey, cast(c as bigint) cols, cast(r as bigint) as rows, round(area, 6) area from k where n = 1""")
def page_layout_best_fit(spark, d):
    frames = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 4 + 40).alias("w"), (200 - F.col("p_size") * 2).alias("h"))
    return identity.best_layout(frames, "w", "h", 210.0, 297.0, [(2, 3), (3, 4)]).drop("w", "h")


@query("select p_partkey, cast(round(p_size * 11.811023622047244::double) as bigint) x, cast(trunc(p_size * 0.985::double) as bigint) bleed from part")
def bbox_scale(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_size") * 11.811023622047244).cast("long").alias("x"), (F.col("p_size") * F.lit(0.985)).cast("long").alias("bleed"))


@query("select page_id, url as label, case when page_id % 2 = 0 then page_id end sheet from (select page_id, case when page_id % 2 = 0 then cast(page_id as varchar) else url end url from pages)")
def qr_payload_roundtrip(spark, d):
    text = F.when(F.col("page_id") % 2 == 0, identity.payload(F.lit("a|b"), F.col("page_id"), F.lit(3), F.col("page_id"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", identity.parsed_payload(text).alias("p")).select("page_id", "p.label", "p.sheet")


#: Every customer is in one of the two stores.
_ALL_MAPS = "a as (select c_nationkey k, c_mktsegment n, min(c_custkey) v from customer where coalesce(c_acctbal < 4000, true) group by all), b as (select c_nationkey k, c_mktsegment n, max(c_custkey) v from customer where not coalesce(c_acctbal < 4000, true) group by all)"


def _merged(spark, d, incoming_wins):
    c = table(spark, d, "customer")
    side = lambda rows, f: rows.groupBy("c_nationkey", "c_mktsegment").agg(f("c_custkey").alias("v")).groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "v"))).alias("m"))
    both = side(c.where("coalesce(c_acctbal < 4000, true)"), F.min).alias("a").join(side(c.where("not coalesce(c_acctbal < 4000, true)"), F.max).withColumnRenamed("m", "m2"), "c_nationkey", "full")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    both = both.select("c_nationkey", F.coalesce("m", none).alias("old"), F.coalesce("m2", none).alias("new"))
    return both.select(F.col("c_nationkey").cast("long").alias("kind"), F.explode(state.merged_maps("old", "new", incoming_wins)).alias("name", "value"))


@query(f"with {_ALL_MAPS} select cast(coalesce(a.k, b.k) as bigint) kind, coalesce(a.n, b.n) as name, coalesce(b.v, a.v) as value from a full join b on a.k = b.k and a.n = b.n")
def profile_merge_all_incoming(spark, d):
    return _merged(spark, d, True)


@query(f"with {_ALL_MAPS} select cast(coalesce(a.k, b.k) as bigint) kind, coalesce(a.n, b.n) as name, coalesce(a.v, b.v) as value from a full join b on a.k = b.k and a.n = b.n")
def profile_merge_all_existing(spark, d):
    return _merged(spark, d, False)


@query("""select p_partkey, '"' || replace(p_name, '"', '""') || '","' || replace(p_brand || '"', '"', '""') || '","' || cast(p_size as varchar) || '"' as line from part""")
def report_csv_rows(spark, d):
    fields = [F.col("p_name"), F.concat("p_brand", F.lit('"')), F.col("p_size")]
    return table(spark, d, "part").select("p_partkey", F.concat_ws(",", *[sinks.csv_field(f) for f in fields]).alias("line"))


@query("select p_brand, p_partkey, cast(coalesce(sum(30 + strlen(p_name) + 20 + p_size * 1000 + 24) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from part")
def zip_offsets(spark, d):
    part = table(spark, d, "part").select("p_brand", "p_partkey", "p_name", (F.col("p_size") * 1000).cast("long").alias("size"))
    return sinks.offsets(part, "p_brand", ["p_partkey"], sinks.zip_entry_size(F.col("p_name"), F.col("size")), 0).select("p_brand", "p_partkey", "offset")


@query("select p_brand, p_partkey, cast(coalesce(sum(p_size * 100 + length(cast(p_partkey as varchar))) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0) + 15 as bigint) as offset, lpad(cast(cast(coalesce(sum(p_size * 100 + length(cast(p_partkey as varchar))) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0) + 15 as bigint) as varchar), 10, '0') || ' 00000 n' as entry from part")
def pdf_xref(spark, d):
    part = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") * 100 + F.length(F.col("p_partkey").cast("string"))).cast("long").alias("size"))
    out = sinks.offsets(part, "p_brand", ["p_partkey"], F.col("size"), 15).withColumn("offset", F.col("offset").cast("long"))
    return out.select("p_brand", "p_partkey", "offset", F.concat(F.lpad(F.col("offset").cast("string"), 10, "0"), F.lit(" 00000 n")).alias("entry"))


@query(f"""with {SLOTS}, c as (select grp, pos // 24 as second, 0 kind, pos idx, pos % 7 * 100 + 50 size from slots union all select grp, pos // 24, 1, pos // 24, 88200 from slots group by grp, pos // 24)
select grp, second, cast(kind as bigint) kind, idx, cast(8 + coalesce(sum(size) over (partition by grp order by second, kind, idx rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from c""")
def mov_interleave(spark, d):
    frames = slots(spark, d).select("grp", F.floor(F.col("pos") / 24).alias("second"), F.col("pos").alias("idx"), (F.col("pos") % 7 * 100 + 50).alias("size"))
    sound = frames.select("grp", "second").distinct().select("grp", "second", F.col("second").alias("idx"), F.lit(88_200).cast("long").alias("size"))
    return sinks.interleaved(frames, sound, "grp").select("grp", "second", F.col("kind").cast("long").alias("kind"), "idx", F.col("offset").cast("long").alias("offset"))


@query("with r as (select p_brand, p_size, row_number() over (partition by p_brand order by p_partkey) i, row_number() over (partition by p_brand, p_size % 3 order by p_partkey) j from part) select p_brand, cast(p_size % 3 as bigint) as value, min(i) first, count(*) n from r group by p_brand, p_size % 3, i - j")
def stsc_runs(spark, d):
    part = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") % 3).cast("long").alias("value"))
    return sinks.runs(part, "p_brand", "p_partkey", "value")


@query("with f as (select distinct p_size from part), k as (select p_size, (p_size / 8.0::double) fps, unnest(range(1, 1001)) k from f) select cast(p_size as bigint) p_size, min(k) factor from k where abs(fps * k - round(fps * k)) < 1e-6 group by p_size")
def frame_timing(spark, d):
    return table(spark, d, "part").select("p_size").distinct().select(F.col("p_size").cast("long").alias("p_size"), sinks.frame_timing(F.col("p_size") / 8).alias("factor"))


@query("with c as (select vec_id, embedding::double[] e from embeddings) select vec_id, round(least(1, greatest(-1, e[1] + sqrt(0.5::double) * e[3] + sqrt(0.5::double) * e[5])), 6) as l, round(least(1, greatest(-1, e[2] + sqrt(0.5::double) * e[3] + sqrt(0.5::double) * e[6])), 6) as r from c")
def downmix_51(spark, d):
    e = table(spark, d, "embeddings")
    left, right = sinks.downmixed([F.get("embedding", F.lit(i)).cast("double") for i in range(6)])
    return e.select("vec_id", F.round(left, 6).alias("l"), F.round(right, 6).alias("r"))


@query("with g as (select user_id, lag(ts) over w stalled_from, epoch(ts) - epoch(lag(ts) over w) gap from events window w as (partition by user_id order by ts)) select user_id, stalled_from, round(gap, 3) gap from g where gap > 43200")
def stall_gaps(spark, d):
    return state.stalls(table(spark, d, "events"), "user_id", "ts", 43_200).withColumn("gap", F.round("gap", 3))


@query("with k as (select user_id, max(ts) last_seen, arg_max(event_type = 'error', ts) closed from events group by user_id) select * from k where closed or epoch(timestamp '2024-01-30 00:00:00') - epoch(last_seen) > 86400")
def ttl_sweep(spark, d):
    events = table(spark, d, "events").withColumn("end", F.col("event_type") == "error")
    return state.expired(events, "user_id", "ts", "end", "2024-01-30 00:00:00", 86_400)


@query("""with r as (select user_id, event_id, ts, event_type = 'error' failed, lead(ts) over (partition by user_id order by ts) after, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts) run from events), f as (select *, count(*) filter (where failed) over (partition by user_id, run order by ts) fails from r)
select event_id, fails, fails < 2 or coalesce(epoch(after) - epoch(ts) >= 3600, false) allowed from f where failed""")
def boot_retry(spark, d):
    rows = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return state.retry_allowed(rows, "user_id", "ts", "failed", 2, 3600.0).where("failed").select("event_id", "fails", "allowed")


@query("select user_id, event_type, min(event_id) event_id from events group by all")
def idempotent_merge(spark, d):
    both = table(spark, d, "events").select("user_id", "event_type", "event_id")
    keyed = both.unionByName(both).withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    return state.merge_once(keyed, "key", "event_id").drop("key")

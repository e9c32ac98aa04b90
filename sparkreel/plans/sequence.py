"""Queries over timelines, labels, votes and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.operators import labels, media, planning, robust, timeline
from sparkreel.plans.base import KEEP, SLOTS, query, slots
from sparkreel.session import table

RATE, FPS = 44_100, 24.0


@query(f"with {SLOTS} select grp, pos, label, coalesce(last_value(content ignore nulls) over (partition by grp order by pos rows between unbounded preceding and current row), first_value(content ignore nulls) over (partition by grp order by pos rows between unbounded preceding and unbounded following)) shown from slots")
def timeline_hold(spark, d):
    return timeline.hold(slots(spark, d), "grp", "content").drop("content")


@query(f'with {KEEP} select grp, "from", "to" from keep')
def timeline_keep_intervals(spark, d):
    return timeline.keep_intervals(slots(spark, d), "grp", "content")


@query(f'with {KEEP}, k as (select *, coalesce(lag("to") over (partition by grp order by "from") <= "from", true) ok from keep) select grp, bool_and(ok) ordered, cast(sum("to" - "from") as bigint) frames from k group by grp')
def timeline_keep_check(spark, d):
    return timeline.check_keep(timeline.keep_intervals(slots(spark, d), "grp", "content"), "grp")


@query(f"""with {KEEP}, s as (select *, coalesce(sum("to" - "from") over (partition by grp order by "from" rows between unbounded preceding and 1 preceding), 0) before from keep)
select grp, "from", "to", cast(floor("from" * 44100 / 24.0::double + 0.5) as bigint) src_from, cast(floor("to" * 44100 / 24.0::double + 0.5) as bigint) src_to, cast(floor(before * 44100 / 24.0::double + 0.5) as bigint) out_from from s""")
def splice_sample_bounds(spark, d):
    return timeline.splice_bounds(timeline.keep_intervals(slots(spark, d), "grp", "content"), "grp", RATE, FPS)


@query(f"""with {KEEP}, h as (select grp, cast(floor(count(*) * 44100 / 24.0::double + 0.5) as bigint) have from slots group by grp),
o as (select *, coalesce(sum("to" - "from") over (partition by grp order by "from" rows between unbounded preceding and 1 preceding), 0) before from keep),
b as (select *, cast(floor("from" * 44100 / 24.0::double + 0.5) as bigint) src, cast(floor((before + "to" - "from") * 44100 / 24.0::double + 0.5) - floor(before * 44100 / 24.0::double + 0.5) as bigint) len from o),
g as (select *, "from" - lag("to") over (partition by grp order by "from") gap, lag(src + len) over (partition by grp order by "from") last from b),
m as (select grp, "from", least(221, greatest(0, least(len, have - src)), greatest(0, have - last)) m from g join h using (grp) where gap > 0)
select grp, "from", i, round((i + 0.5::double) / m, 6) weight from (select grp, "from", m, unnest(range(0, m)) i from m)""")
def crossfade_samples(spark, d):
    s = slots(spark, d)
    have = s.groupBy("grp").agg(timeline.js_round(F.count("*") * RATE / FPS).alias("have"))
    out = timeline.crossfade_samples(timeline.keep_intervals(s, "grp", "content").join(have, "grp"), "grp", RATE, FPS, 0.005)
    return out.withColumn("weight", F.round("weight", 6))


@query("""with e as (select user_id grp, ts, value from events), r as (select grp, min(ts) lo, max(ts) hi from e group by grp),
a as (select grp, unnest(generate_series(date_trunc('hour', lo), hi, interval 6 hour)) ts from r)
select a.grp, a.ts, arg_max(e.value, e.ts) value from a left join e on e.grp = a.grp and e.ts <= a.ts group by a.grp, a.ts""")
def sample_times_asof(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("grp"), "ts", "value")
    asks = rows.groupBy("grp").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    step = F.sequence(F.date_trunc("hour", F.col("lo").cast("timestamp")), F.col("hi").cast("timestamp"), F.expr("interval 6 hours"))
    asks = asks.select("grp", F.explode(step).alias("ts")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return timeline.as_of(asks, rows, "grp", "ts", "value")


@query(f"""with {KEEP}, n as (select grp, count(*) n from slots group by grp), a as (select grp, unnest(range(0, n, 5)) pos from n)
select a.grp, a.pos, max(k."from") span from a left join keep k on k.grp = a.grp and k."from" <= a.pos group by a.grp, a.pos""")
def span_asof(spark, d):
    s = slots(spark, d)
    spans = timeline.keep_intervals(s, "grp", "content").select("grp", F.col("from").alias("pos"), F.col("from").alias("span"))
    asks = s.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.explode(F.expr("sequence(0L, n - 1, 5L)")).alias("pos"))
    return timeline.as_of(asks, spans, "grp", "pos", "span")


@query("""with f as (select p_brand || '/' || cast(p_size as varchar) as name, min(p_partkey) frame from part group by all),
s as (select p_partkey slot, p_brand || '/' || cast(p_size * 3 as varchar) k1, p_brand || '/' || cast(p_size + 1 as varchar) k2, 'Brand#11/' || cast(p_size as varchar) k3 from part)
select slot, coalesce(a.frame, b.frame, c.frame) frame, cast(case when a.frame is not null then 1 when b.frame is not null then 2 when c.frame is not null then 3 end as bigint) via
from s left join f a on a.name = k1 left join f b on b.name = k2 left join f c on c.name = k3""")
def timeline_priority_lookup(spark, d):
    part = table(spark, d, "part")
    frames = part.groupBy(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("name")).agg(F.min("p_partkey").alias("frame"))
    key = lambda b, n: F.concat_ws("/", b, n.cast("string"))
    asks = part.select(F.col("p_partkey").alias("slot"), key("p_brand", F.col("p_size") * 3).alias("k1"), key("p_brand", F.col("p_size") + 1).alias("k2"), key(F.lit("Brand#11"), F.col("p_size")).alias("k3"))
    return timeline.prioritised(asks, frames, ["k1", "k2", "k3"], "name").select("slot", "frame", "via")


@query(f"with {SLOTS} select grp, pos, label, lead(pos) over (partition by grp, label order by pos) next_pos from slots")
def next_use_lead(spark, d):
    return timeline.next_use(slots(spark, d), "grp", "label").drop("content")


@query(f"with {SLOTS} select grp, label, min(pos) first_pos, count(*) uses from slots group by grp, label")
def dedupe_first_seen(spark, d):
    return timeline.first_seen(slots(spark, d), "grp", "label")


@query("select p_partkey, p_name || '_' || case when length(cast(p_partkey as varchar)) < 4 then lpad(cast(p_partkey as varchar), 4, '0') else cast(p_partkey as varchar) end as label from part")
def label_format(spark, d):
    return table(spark, d, "part").select("p_partkey", labels.numbered_label(F.col("p_name"), F.col("p_partkey"), 4).alias("label"))


@query("""select page_id, coalesce(nullif(trim(translate(url, '<>:"/\\|?*', '_________')), ''), 'frame') as label from pages""")
def label_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", labels.sanitized(F.col("url")).alias("label"))


@query(r"select page_id, regexp_replace(url, '\.[^.]+$', '') as stem from pages")
def url_stem(spark, d):
    return table(spark, d, "pages").select("page_id", labels.stem(F.col("url")).alias("stem"))


@query("""with r as (select p_brand grp, p_partkey, p_name, row_number() over (partition by p_brand, p_name order by p_partkey) n from part)
select grp, p_partkey, p_name, p_name || case when n > 1 then '_' || cast(n as varchar) else '' end as label from r""")
def label_uniquify(spark, d):
    return labels.uniquified(table(spark, d, "part").select(F.col("p_brand").alias("grp"), "p_partkey", "p_name"), "grp", "p_name", "p_partkey")


@query("""with t as (select p_partkey, p_size, unnest([cast(p_size as bigint), cast(p_size + 4 as bigint)]) a, unnest([cast(p_size as bigint), cast(p_size + 2 as bigint)]) b from part),
n as (select p_partkey, unnest(range(least(a, b), greatest(a, b) + 1)) x from t)
select p_partkey, cast(count(distinct x) as bigint) n, cast(sum(distinct x) as bigint) total from n where x between 1 and 40 group by p_partkey""")
def range_select(spark, d):
    text = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(", "), (F.col("p_size") + 4).cast("string"), F.lit("-"), (F.col("p_size") + 2).cast("string"), F.lit("; x"))
    rows = table(spark, d, "part").select("p_partkey", labels.range_set(text, 40).alias("s")).where("size(s) > 0")
    return rows.select("p_partkey", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) number from part) select p_brand, p_partkey, number, (number - 1) // 12 page, (number - 1) % 12 cell from r")
def page_assign(spark, d):
    return labels.pages(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", 12, "p_partkey")


@query("""with r as (select p_brand, p_size, row_number() over (partition by p_brand order by p_partkey) number from part), s as (select p_brand, number, row_number() over (partition by p_brand order by number) - 1 k from r where p_size % 3 <> 0)
select p_brand, k // 12 page, (min(number) - 1) // 12 + 1 original_page from s group by p_brand, k // 12""")
def original_page_numbers(spark, d):
    rows = labels.pages(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", 12, "p_partkey").where("p_size % 3 <> 0").drop("page", "cell").withColumnRenamed("number", "was")
    return planning.original_pages(labels.pages(rows, "p_brand", 12, "was"), "p_brand", "page", "was", 12)


@query("select l_returnflag, l_linestatus, list_sort(list(l_extendedprice))[count(*) // 2 + 1] as m from lineitem group by all")
def upper_median_by_group(spark, d):
    items = table(spark, d, "lineitem").select(F.struct("l_returnflag", "l_linestatus").alias("g"), "l_extendedprice")
    return robust.upper_medians(items, "g", "l_extendedprice").select("g.*", F.col("median").alias("m"))


_ITEM = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"


@query(f"""with m as (select l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] m from lineitem group by l_suppkey),
r as (select {_ITEM}, l_suppkey, l_quantity, greatest(2.5::double, 1.5::double * m) "limit" from lineitem join m using (l_suppkey))
select l_suppkey, {_ITEM}, round("limit", 6) "limit" from (select *, count(*) filter (where l_quantity <= "limit") over (partition by l_suppkey) inside from r) where l_quantity > "limit" and inside >= 4""")
def residual_outliers(spark, d):
    rows = robust.residual_outliers(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", 2.5, 1.5, 4).where("outlier")
    return rows.select("l_suppkey", *_ITEM.split(", "), F.round("limit", 6).alias("limit"))


@query("with c as (select p_brand, p_size, count(*) n, min(p_partkey) f from part group by all), r as (select *, row_number() over (partition by p_brand order by n desc, f) k from c) select p_brand, p_size, n as count from r where k = 1")
def plan_sequence_mode(spark, d):
    return robust.first_seen_mode(table(spark, d, "part"), "p_brand", "p_size", "p_partkey")


_VOTES = "select l_orderkey, l_suppkey % 7 as sheet from lineitem"


@query(f"with v as ({_VOTES}), c as (select l_orderkey, sheet, count(*) votes from v group by all), r as (select *, rank() over (partition by l_orderkey order by votes desc) k from c), u as (select *, count(*) over (partition by l_orderkey) n from r where k = 1) select l_orderkey, sheet, votes from u where n = 1")
def vote_unique_max(spark, d):
    votes = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 7).alias("sheet"))
    return robust.unique_winner(votes, "l_orderkey", "sheet")


@query("select l_orderkey, count(distinct l_suppkey) scans from lineitem group by l_orderkey having count(distinct l_suppkey) > 1")
def sheet_conflicts(spark, d):
    return robust.conflicts(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def missing_labels(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return robust.missing(table(spark, d, "orders").select("o_orderkey"), found, "o_orderkey")


@query("select l_returnflag, round(sum(l_quantity * case l_linestatus when 'O' then 0.26 else 0.41 end), 4) size, bool_or(l_discount > 0.09) as any_deep, cast(count(*) filter (where l_tax = 0) as bigint) passthrough from lineitem group by l_returnflag")
def size_estimate(spark, d):
    ratio = F.when(F.col("l_linestatus") == "O", 0.26).otherwise(0.41)
    return media.size_estimate(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", ratio, F.col("l_discount") > 0.09, F.col("l_tax") == 0).withColumn("size", F.round("size", 4))

"""Queries over claims of sheets, as a stream and as a table."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sparkreel.plans.base import query
from sparkreel.session import scratch_dir, table
from sparkreel.streaming import claims

L = F.lit
WAIT = timedelta(hours=30)

_SCANS = "s as (select user_id project, event_id scan, ts, case when event_type = 'purchase' then 1 end sheet, case when user_id % 3 > 0 then 1 end lone from events)"
_SETTLED = f"""with {_SCANS}, t as (select project, min(ts) filter (where sheet is not null) claim, min((ts, scan)) filter (where sheet is null and lone is not null) f from s group by project),
g as (select s.*, sheet is null and lone is not null and (ts, scan) = f and coalesce(claim > ts + interval 30 hour, true) gets from s join t using (project))
select project, scan, cast(case when sheet is not null then sheet when gets then lone end as bigint) sheet, case when sheet is not null then 'code' when gets then 'only sheet' else 'unidentified' end via from g"""


def _scans(spark, d):
    kind = F.col("event_type")
    one = L(1).cast("long")
    return table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("scan"), F.col("ts").cast("timestamp").alias("ts"), F.when(kind == "purchase", one).alias("sheet"), F.when(F.col("user_id") % 3 > 0, one).alias("only"))


@query(_SETTLED)
def claims_table(spark, d):
    return claims.settled_batch(_scans(spark, d), WAIT)


@query(_SETTLED)
def claims_stream(spark, d):
    """The same from files that arrive day by day; a last one of another project moves the watermark past all timers."""
    folder = scratch_dir(spark)
    scans = _scans(spark, d)
    day = F.dayofmonth("ts")
    # files are taken in order of their times of change
    for part in (scans.where(day <= 10), scans.where((day > 10) & (day <= 20)), scans.where(day > 20)):
        part.coalesce(1).write.mode("append").parquet(folder)
    beat = spark.sql("select -1L project, -1L scan, timestamp '2030-01-01' ts, 1L sheet, 1L only").select([F.col(f.name).cast(f.dataType) for f in scans.schema])
    beat.coalesce(1).write.mode("append").parquet(folder)
    return claims.settled_files(spark, folder, scans.schema, WAIT, "1 hour").where("project >= 0")

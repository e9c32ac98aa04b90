"""Registration of queries with their SQL counterparts, and the views of the driver's tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.operators import raster, timeline
from sparkreel.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name; sql is its DuckDB counterpart, none where SQL can't express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, pos, label, content): a user's events in order; errors and signups are holes."""
    events = timeline.positions(table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), "ts", "event_id", "event_type", "value"), "grp", "ts", "event_id")
    return events.select("grp", "pos", F.col("event_type").alias("label"), F.when(F.col("event_type").isin("view", "click", "purchase"), F.col("value")).alias("content"))


SLOTS = """slots as (select user_id grp, row_number() over (partition by user_id order by ts, event_id) - 1 pos, event_type label,
  case when event_type in ('view', 'click', 'purchase') then value end content from events)"""
KEEP = SLOTS + """, filled as (select *, pos - row_number() over (partition by grp order by pos) island from (select *, count(*) filter (where content is null) over (partition by grp) holes from slots) where content is not null and holes > 0),
keep as (select grp, cast(min(pos) as bigint) "from", cast(max(pos) + 1 as bigint) "to" from filled group by grp, island)"""


def gray8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, x, y, gray): embeddings as rasters of 8 by 8."""
    return raster.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


GRAY8 = """px0 as (select vec_id img, unnest(range(0, 64)) i, unnest(embedding)::double v from embeddings),
px1 as (select *, min(v) over (partition by img) lo, max(v) over (partition by img) hi from px0),
px as (select img, i % 8 x, i // 8 y, case when hi > lo then cast(floor((v - lo) * 255 / (hi - lo) + 0.5) as bigint) else 0 end gray from px1)"""


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, density, luma): mean price by quantity for each return flag, as 0..255 by price / 500."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("density")).agg(F.round(F.avg("l_extendedprice") / 500, 4).alias("luma"))
    return items


RESPONSE = "resp as (select l_returnflag grp, l_quantity density, round(avg(l_extendedprice) / 500, 4) luma from lineitem group by all)"


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet, id, lx, ly, sx, sy): suppliers as markers on their nation's sheet, measured at 1.25 times the layout with small whole errors."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("sheet"), F.col("s_suppkey").alias("id"))
    s = s.withColumns({"lx": F.col("id") * 37 % 211 * 1.0, "ly": F.col("id") * 53 % 197 * 1.0})
    return s.withColumns({"sx": F.col("lx") * 1.25 + 7 + F.col("id") % 5 * 0.1, "sy": F.col("ly") * 1.25 + 3 + F.col("id") % 7 * 0.1})


MARKERS = """mk0 as (select cast(s_nationkey as bigint) sheet, s_suppkey id, s_suppkey * 37 % 211 * 1.0::double lx, s_suppkey * 53 % 197 * 1.0::double ly from supplier),
mk as (select *, lx * 1.25::double + 7 + id % 5 * 0.1::double sx, ly * 1.25::double + 3 + id % 7 * 0.1::double sy from mk0)"""

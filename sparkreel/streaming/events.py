"""Stateful rules over the event table read as a stream: every trigger takes what is there, then stops."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.session import scratch_dir, table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as a file stream, its times with a zone so that a watermark can follow them."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame) -> DataFrame:
    """What the stream appends until its input is used up, from files in the shared folder."""
    spark, path = stream.sparkSession, scratch_dir(stream.sparkSession)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def held(stream: DataFrame, key: str, content: str) -> DataFrame:
    """(key, event_id, shown): each row with the last content of its key up to it, kept as state between triggers."""

    def run(k, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        for _, _, event, value in sorted((r.ts, r.event_id, r.event_id, r.content) for f in frames for r in f.itertuples()):
            last = value if value == value and value is not None else last
            out.append((k[0], event, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "event_id", "shown"])

    rows = stream.select(F.col(key).alias("key"), "ts", "event_id", F.col(content).alias("content"))
    return rows.groupBy("key").applyInPandasWithState(run, "key long, event_id long, shown double", "last double", "append", "NoTimeout")


def closed_sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """(key, from, to, n) of the runs of a key's events without a longer gap, once the watermark has passed them."""
    sessions = stream.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return sessions.select(key, F.col("s.start").alias("from"), F.col("s.end").alias("to"), "n")


def all_sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """closed_sessions() of a stream that ends, and the sessions that are still open then.

    The watermark stands still once the input is used up, so what lies behind the last closed sessions is
    read from the source again and put together there.
    """
    closed = drained(closed_sessions(stream, key, gap, late))
    rows = drained(stream.select(key, "ts"))
    ends = closed.groupBy(key).agg(F.max("to").alias("_to"))
    rest = rows.join(ends, key, "left").where(F.col("_to").isNull() | (F.col("ts") >= F.col("_to")))
    open_ = rest.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("from"), F.col("s.end").alias("to"), "n")
    return closed.unionByName(open_)


def once(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark's reach."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)

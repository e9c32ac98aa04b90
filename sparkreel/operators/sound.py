"""Sound of any length: blocks placed in an asked interval, silence between them, mixed down, written second by second."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.operators import media
from sparkreel.operators.archives import file_name
from sparkreel.operators.placing import little
from sparkreel.sources import segments

#: Channels behind the centre that go to the left and to the right, by the number of channels; a low one is left out.
BEHIND = {3: ((), ()), 4: ((3,), (3,)), 5: ((3,), (4,)), 6: ((4,), (5,))}
_HALF = 0.5**0.5


def mixed_down(sound: np.ndarray) -> np.ndarray:
    """16-bit samples (n, channels) as at most two channels: the centre and those behind at half power, rounded half up and clipped; one or two stay."""
    channels = sound.shape[1]
    if channels < 3:
        return sound
    wide = sound.astype(np.float64)
    out = wide[:, :2] + wide[:, 2:3] * _HALF
    for side, behind in enumerate(BEHIND[min(channels, 6)]):
        for c in behind:
            out[:, side] += wide[:, c] * _HALF
    return np.clip(np.floor(out + 0.5), -32_768, 32_767).astype(np.int16)


def seconds_of_sound(blocks: DataFrame, asks: DataFrame, grp: str) -> DataFrame:
    """(grp, ask, second, rate, channels, content) of each asked interval: 16-bit samples in little-endian bytes, interleaved, two channels at most.

    blocks: (grp, block, stamp, rate, channels, samples), samples interleaved, rate and channels alike within a group;
    asks: (grp, ask, start, duration). Where no block is, there is silence; of blocks that overlap the later one
    counts. The last second is as long as the interval; an interval without any block has no rows. A second is a row
    and a task's largest piece, however long the interval.
    """
    sized = blocks.withColumn("count", F.expr("cast(size(samples) div channels as bigint)"))
    placed = media.placed_blocks(sized.select(grp, "block", "stamp", "rate", "count"), asks, grp)
    told = blocks.groupBy(grp).agg(F.first("rate").alias("rate"), F.first("channels").alias("channels"))
    rows = placed.join(sized.select(grp, "block", "rate", "channels", "samples"), [grp, "block"])
    first, last = F.floor(F.col("at") / F.col("rate")), F.floor((F.col("at") + F.col("n") - 1) / F.col("rate"))
    rows = rows.withColumn("second", F.explode(F.sequence(first, last)))
    low, high = F.greatest("at", F.col("second") * F.col("rate")), F.least(F.col("at") + F.col("n"), (F.col("second") + 1) * F.col("rate"))
    rows = rows.withColumns({"_low": low, "_n": high - low})
    start = (F.col("from") + F.col("_low") - F.col("at")) * F.col("channels")
    piece = F.struct("block", (F.col("_low") - F.col("second") * F.col("rate")).alias("at"), F.slice("samples", (start + 1).cast("int"), (F.col("_n") * F.col("channels")).cast("int")).alias("samples"))
    pieces = rows.groupBy(grp, "ask", "second").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    asked = asks.join(told, grp).join(placed.select(grp, "ask").distinct(), [grp, "ask"], "left_semi")
    all_ = asked.withColumn("_all", F.greatest(F.lit(1), F.floor(F.col("duration") * F.col("rate") + 0.5)))
    all_ = all_.withColumn("second", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_all") - 1) / F.col("rate")))))
    all_ = all_.select(grp, "ask", "second", "rate", "channels", F.least(F.col("rate"), F.col("_all") - F.col("second") * F.col("rate")).alias("_n"))
    full = all_.join(pieces, [grp, "ask", "second"], "left")
    kind = full.schema[grp].dataType.simpleString()
    fields = [grp, "ask", "second", "rate", "channels", "content"]

    def run(batches):
        for pdf in batches:
            content = []
            for n, channels, own in zip(pdf["_n"], pdf["channels"], pdf["pieces"], strict=True):
                out = np.zeros((int(n), int(channels)), np.int16)
                for p in own if own is not None else ():
                    part = np.asarray(p["samples"], np.int16).reshape(-1, int(channels))
                    out[p["at"] : p["at"] + len(part)] = part
                content.append(mixed_down(out).astype("<i2").tobytes())
            yield pd.DataFrame({grp: pdf[grp], "ask": pdf["ask"], "second": pdf["second"], "rate": pdf["rate"], "channels": np.minimum(pdf["channels"], 2), "content": content})[fields]

    ask = full.schema["ask"].dataType.simpleString()
    return full.mapInPandas(run, f"{grp} {kind}, ask {ask}, second long, rate long, channels long, content binary")


def wav_header(rate: Column, channels: Column, size: Column) -> Column:
    """The 44 bytes before `size` bytes of 16-bit samples."""
    return F.concat(F.lit(b"RIFF"), little(size + 36, 4), F.lit(b"WAVEfmt "), little(16, 4), little(1, 2), little(channels, 2), little(rate, 4), little(rate * channels * 2, 4), little(channels * 2, 2), little(16, 2), F.lit(b"data"), little(size, 4))


def write_wavs(seconds: DataFrame, name: str, path: str) -> None:
    """Writes path/<name>.wav for every name from rows (name, second, rate, channels, content), each second to its own place."""
    file = file_name(name, ".wav").alias("file")
    at = 44 + F.col("second") * F.col("rate") * F.col("channels") * 2
    heads = seconds.groupBy(name).agg(F.first("rate").alias("rate"), F.first("channels").alias("channels"), F.sum(F.octet_length("content")).alias("_n"))
    segments.written(seconds.select(file, at.alias("at"), F.col("content").alias("data")), heads.select(file, F.lit(0).alias("at"), wav_header(F.col("rate"), F.col("channels"), F.col("_n")).alias("data")), path)

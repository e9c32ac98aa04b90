"""Helpers of the text operators: byte-level words, 64-bit hashes, shared scratch tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = _BYTE[_FOLD]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(text, UPPER, LOWER)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends, lost executors cost nothing."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored() frame that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_BASE, _BACK)]
    return _powers


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words between white space, and each row's offsets into them.

    A polynomial hash over random byte codes by one running sum: (sum up to the end - sum up to the
    start) / base**start, all modulo 2**64.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    left, right = word.copy(), word.copy()
    left[1:] &= ~word[:-1] | cut[1:-1]
    right[:-1] &= ~word[1:] | cut[1:-1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(start, at)


def slices(at: np.ndarray, most: int):
    """Ranges of rows of at most so many bytes, or of one row."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end
        row = end


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive hashes."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + hashes[j : j + len(out)])
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (src, dst), component being the smallest id reachable.

    Alternating large-star and small-star steps; every step is two shuffles of the edges, which
    shrink towards one star a component. Steps end when a round changes nothing. Null ids are left out.
    """
    pairs = edges.where("src <> dst").selectExpr("greatest(src, dst) u", "least(src, dst) v").distinct()
    pairs, last = stored(pairs), None
    while True:
        both = pairs.unionByName(pairs.selectExpr("v u", "u v"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v u", "m v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v u", "m v").unionByName(least.selectExpr("u", "m v")).where("u <> v").distinct()
        new = stored(small)
        forget(pairs)
        pairs = new
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last = now
    return pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(pairs.selectExpr("v id", "v component").distinct())

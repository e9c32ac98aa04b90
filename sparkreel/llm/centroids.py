"""Centroid clustering of vectors of whole numbers, exact to the last unit.

Distances come from |x|^2 - 2 x.c + |c|^2, the middle term by one float64 matrix product for a block of
vectors. Every number in it is whole, so the product is exact in any order of summation as long as
nothing reaches 2**53; a bound from the largest components decides that row by row, and the other rows
go through Python's whole numbers. A round is one pass over the vectors where they lie: tasks sum
their members, and treeAggregate adds the sums up on the executors. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a block's matrix of distances; cells of the blocks in whole numbers.
CELLS, WIDE_CELLS = 1 << 21, 1 << 16
#: Below this every float64 in the expansion is exact; below the other int64 sums are.
EXACT, LONG = 2.0**52, 1 << 62
_INT = np.frompyfunc(int, 1, 1)
_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class Total:
    """An array of whole numbers, none beyond `most`: int64 while that allows it, Python's numbers from there on."""

    def __init__(self, values: np.ndarray, most: int):
        self.values, self.most = (values if most < LONG else values.astype(object)), most

    def __add__(self, other: "Total") -> "Total":
        most = self.most + other.most
        kind = np.int64 if most < LONG else object
        return Total(self.values.astype(kind) + other.values.astype(kind), most)


def nearest(x: np.ndarray, centroids: np.ndarray):
    """Parts (rows, labels, distances) of a matrix of whole float64: the number of the nearest centroid, the smaller of equals, and its squared distance.

    centroids: whole numbers of any size (dtype object). Distances are int64 where the float64 path is exact, Python numbers elsewhere.
    """
    k, width = centroids.shape
    far = int(abs(centroids).max(initial=0))
    most = np.abs(x).max(1, initial=0)
    safe = width * (most + float(far)) ** 2 < EXACT
    rows = np.flatnonzero(safe)
    if len(rows):
        c = centroids.astype(np.float64)
        square = (c * c).sum(1)
        for a in range(0, len(rows), step := max(1, CELLS // max(k, width))):
            at = rows[a : a + step]
            v = x[at]
            d = (v * v).sum(1)[:, None] - v @ (2 * c.T) + square[None]
            label = d.argmin(1)
            yield at, label, d[np.arange(len(at)), label].astype(np.int64)
    rows = np.flatnonzero(~safe)
    for a in range(0, len(rows), step := max(1, WIDE_CELLS // (k * width))):
        at = rows[a : a + step]
        d = ((_INT(x[at])[:, None, :] - centroids[None]) ** 2).sum(2)
        label = np.array([min(range(k), key=r.__getitem__) for r in d])
        yield at, label, d[np.arange(len(at)), label]


def gathered(x: np.ndarray, centroids: np.ndarray) -> Total:
    """(centroid, components, number and summed distance of its members) of a block of vectors."""
    k, width = centroids.shape
    total = Total(np.zeros((k, width + 2), np.int64), 0)
    for at, label, distance in nearest(x, centroids):
        most = max(int(np.abs(x[at]).max()), int(distance.max())) * len(at)
        wide = distance.dtype == object or most >= LONG
        part = np.zeros((k, width + 2), object if wide else np.int64)
        v = _INT(x[at]) if wide else x[at].astype(np.int64)
        order = np.argsort(label, kind="stable")
        used, first = np.unique(label[order], return_index=True)
        part[used, :width] = np.add.reduceat(v[order], first, axis=0)
        part[used, width] = np.diff(np.append(first, len(at)))
        part[used, width + 1] = np.add.reduceat(distance[order].astype(part.dtype), first)
        total = total + Total(part, most)
    return total


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has exactly so many components, none null or not finite."""
    return (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(column: pa.Array, scale: int, width: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * float(scale))


def _long(n: int) -> int | None:
    return int(n) if n < 1 << 63 else None


def clusters(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `width` finite components.

    A component x counts as floor(scale * x), x as double. The k rows with the smallest sha256 of
    `seed:vec_id` start as centroids (equal ids by their vectors, null ids last; fewer rows, fewer
    centroids). A round gives every vector to its nearest centroid, the first of equals, and moves every
    centroid to the floor of its members' mean; one without members stays. Repeated rows and ids take
    part each, an empty table gives no rows, other columns are not read. All numbers are exact; a
    distance or inertia past the range of a long is null.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v"), width))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], _OUT)
    centroids = _INT(np.floor(np.array([r["v"] for r in first]) * float(scale)))

    def totals(centroids: np.ndarray) -> np.ndarray:
        def run(batches):
            total = None
            for batch in batches:
                part = gathered(_matrix(batch.column(0), scale, width), centroids)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

        parts = rows.select("v").mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r[0]))
        add = lambda a, b: b if a is None else a if b is None else a + b
        return parts.treeAggregate(None, add, add, 2).values

    for _ in range(rounds):
        found = totals(centroids).astype(object)
        some = found[:, width] > 0
        centroids[some] = found[some, :width] // found[some, width : width + 1]
    inertia = [int(n) for n in totals(centroids)[:, width + 1]]
    own, whole = pa.array([_long(n) for n in inertia], pa.int64()), _long(sum(inertia))
    names = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids], pa.string())

    def label(batches):
        for batch in batches:
            x = _matrix(batch.column(1), scale, width)
            number, distance = np.zeros(len(x), np.int32), np.zeros(len(x), object)
            for at, one, d in nearest(x, centroids):
                number[at], distance[at] = one, d
            cluster = pa.array(number)
            columns = [batch.column(0), cluster, pa.array([_long(n) for n in distance], pa.int64()), own.take(cluster), pa.array([whole] * len(x), pa.int64()), names.take(cluster)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _OUT.split(", ")])

    return rows.mapInArrow(label, _OUT)


def _oracle(rounds: int = 3) -> str:
    steps = []
    for i in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
        steps.append(f"a{i} as materialized (select r, arg_min(j, (d, j)) j, min(d) d from (select v.r, c.j, {d} d from v cross join c{i} c) group by r)")
        if i < rounds:
            steps.append(f"""m{i} as (select a.j, u.i, sum(u.e)::hugeint s, count(*) n from a{i} a join (select r, unnest(x) e, unnest(range(64)) i from v) u using (r) group by all),
c{i + 1} as materialized (select c.j, coalesce(any_value(f.x), any_value(c.x)) x from c{i} c left join (select j, list((((s - ((s % n) + n) % n) // n)::bigint) order by i) x from m{i} group by j) f using (j) group by c.j)""")
    return f"""with v as materialized (select row_number() over (order by sha256('1:' || vec_id) nulls last, e) - 1 r, vec_id, list_transform(e, lambda z: floor(64 * z)::bigint) x
  from (select vec_id, embedding::double[] e from embeddings) where len(e) = 64 and len(list_filter(e, lambda z: z is not null and isfinite(z))) = 64),
c0 as materialized (select r j, x from v where r < 16),
{", ".join(steps)}
select v.vec_id, a.j::int as cluster, a.d distance, (sum(a.d) over (partition by a.j))::bigint cluster_inertia, (sum(a.d) over ())::bigint inertia, sha256(array_to_string(c.x, ',')) centroid_sha256
from v join a{rounds} a using (r) join c{rounds} c using (j)"""


ORACLE = _oracle()

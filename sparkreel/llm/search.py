"""Exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors are indexed in blocks, longest vectors first. In a block a component's impact is its size on a
scale of LEVELS steps. A posting segment holds the rows that have a component of one impact, with those
components; segments are walked from the largest impact down, for all queries of a slab at once, and each adds
its impacts times the queries' weights to its rows. After a segment, a score can still be off by
|query| * |what of the vector its walked impacts do not tell|. A query leaves a block before the first segment
if the block's bounds prove that nothing in it can be among its k best, and after a segment once few vectors
may still be; those are rescored from their whole vectors.

The proofs start from scores that are known already: before the search every query meets a small block
of long vectors, and its k-th best score there travels with it; inside a task it rises from block to
block. Vectors are never shuffled, queries are broadcast in slabs of bounded size, and a task gives back
k rows a query at most. Where one slab does not hold all queries the blocks are written once, with their
impacts and bounds, and every slab reads them.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.llm.common import forget, stored

#: Vectors of a block and bytes of its matrix at most, bytes of the vectors sorted together, queries walked at once, share of pairs that is left to rescoring, pairs rescored at once.
BLOCK, BLOCK_BYTES, CHUNK_BYTES, QUERIES, REST, PAIRS = 4096, 4 << 20, 32 << 20, 256, 0.01, 65_536
#: Steps of the scale of impacts.
LEVELS = 7
#: Bytes of the queries that are broadcast together, and of the vectors that every query meets first.
SLAB_BYTES, SEED_BYTES = 32 << 20, 2 << 20
_FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a whole double, null for a null vector or a null or non-finite component."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    # from 2**53 on every double is whole
    whole = lambda y: F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)
    return F.when(ok, F.transform(vector, lambda x: whole(x.cast("double") * scale)))


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column's rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(at)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _length(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(1))


class Block:
    """The posting segments of up to BLOCK vectors by descending impact, and what each leaves untold of every vector."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, impact: np.ndarray | None = None, step: float = 0.0):
        self.ids, self.whole = ids, vectors.astype(np.int64)
        self.high, self.low, self.length = vectors.max(0, initial=-np.inf), vectors.min(0, initial=np.inf), _length(vectors)
        if impact is None:
            step = float(np.abs(vectors).max(initial=0) / (LEVELS + 0.5) or 1.0)
            impact = np.clip(np.rint(vectors / step), -LEVELS, LEVELS).astype(np.int8)
        self.impact, self.step = impact, step
        self.segments: list[tuple] = []
        # the sums are single precision: so much of |query| * |vector| may be lost
        self.lost = ((vectors.shape[1] + 8) * 2.0**-23 * self.length).astype(np.float32)

    def posting_segments(self):
        """(rows, their components of one impact, what is untold of every vector after it); made when a query first walks the block."""
        if not self.segments:
            size, told = np.abs(self.impact), np.zeros(self.impact.shape)
            for level in range(LEVELS, 0, -1):
                here = size == level
                rows = np.flatnonzero(here.any(1))
                if len(rows):
                    part = np.where(here[rows], self.impact[rows] * self.step, 0)
                    told[rows] += part
                    self.segments.append((rows, part.astype(np.float32).T, (_length(self.whole - told) * (1 + 1e-6)).astype(np.float32)))
        return self.segments

    def row(self) -> list:
        """The block as bytes: ids, vectors, impacts, step."""
        return [self.whole.shape[1], self.ids.tobytes(), self.whole.tobytes(), self.impact.tobytes(), self.step]

    @classmethod
    def of_row(cls, width: int, ids: bytes, vectors: bytes, impact: bytes, step: float) -> "Block":
        ids = np.frombuffer(ids, np.int64)
        shape = len(ids), width
        return cls(ids, np.frombuffer(vectors, np.int64).reshape(shape).astype(np.float64), np.frombuffer(impact, np.int8).reshape(shape), step)

    def members(self, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, counts: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs that may be among the query's k best; least: scores that its k-th best is known to reach."""
        counts = Counter() if counts is None else counts
        length = _length(queries)
        most = np.minimum(np.maximum(queries * self.high, queries * self.low).sum(1), length * self.length.max())
        live = np.flatnonzero(most + 1e-9 * np.abs(most) + 1 >= least)
        counts["skipped"] += len(queries) - len(live)
        if not len(live):
            return live, live
        weights, length, least = queries[live].astype(np.float32), length[live].astype(np.float32)[:, None] * np.float32(1 + 1e-6), least[live]
        other = own[live][:, None] != self.ids[None, :]
        score = np.zeros(other.shape, np.float32)
        unproven = np.flatnonzero(np.isneginf(least))
        possible = other
        for rows, part, untold in self.posting_segments():
            counts["walked"] += 1
            if len(rows) == len(self.ids):
                score += weights @ part
            else:
                score[:, rows] += weights @ part
            slack = length * (untold + self.lost)[None, :]
            if len(unproven) and len(self.ids) >= k:
                low = np.where(other[unproven], score[unproven] - slack[unproven], -np.inf)
                least = least.copy()
                least[unproven] = np.maximum(least[unproven], np.partition(low, len(self.ids) - k, axis=1)[:, len(self.ids) - k])
            floor = np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
            possible = (score + slack >= floor) & other
            if possible.sum() <= REST * possible.size:
                break
        counts["segments"] += len(self.posting_segments())
        q, row = np.nonzero(possible)
        return live[q], row


class Best:
    """The k best (id, score) of every query so far, ties to the smaller id."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.query, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.counts: Counter = Counter()

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        known = scores[last].astype(np.float64)
        self.least[query[last]] = np.maximum(self.least[query[last]], np.where(np.abs(known) < 2.0**53, known, np.nextafter(known, -np.inf)))
        keep = rank < self.k
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]


def walk_block(block: Block, queries: np.ndarray, own: np.ndarray, best: Best) -> None:
    """Lets every query meet a block; components that only one of the two has add nothing."""
    width = block.whole.shape[1]
    if width != queries.shape[1]:
        queries = np.pad(queries, ((0, 0), (0, max(0, width - queries.shape[1]))))[:, :width]
    whole = queries.astype(np.int64)
    for a in range(0, len(queries), QUERIES):
        some = slice(a, a + QUERIES)
        query, row = block.members(queries[some], own[some], best.least[some], best.k, best.counts)
        for i in range(0, len(query), PAIRS):
            q, r = query[i : i + PAIRS] + a, row[i : i + PAIRS]
            best.add(q, block.ids[r], np.einsum("ij,ij->i", block.whole[r], whole[q]))


def rarely_equal(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The rows without those that equal vectors of k + 1 smaller ids come before: they are in nobody's k best."""
    odd = np.random.default_rng(5).integers(0, 2**63, vectors.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    key = (vectors.astype(np.int64).view(np.uint64) * odd).sum(1)
    order = np.lexsort((ids, key))
    first = np.searchsorted(key[order], key[order])
    # an id counts once: for a query of that id its rows are no candidates
    new = np.ones(len(order), np.int64)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (key[order][1:] != key[order][:-1])
    place = np.cumsum(new)
    place -= place[first]
    if (place <= k).all():
        return np.arange(len(ids))
    unlike = first[(vectors[order] != vectors[order[first]]).any(1)]  # equal keys of different vectors: all stay
    return np.setdiff1d(np.arange(len(ids)), order[(place > k) & ~np.isin(first, unlike)])


def exact_pairs(own: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query_id, vec_id, score) of k best rows a query in whole numbers of any size, for components that 64 bits can't add up."""
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    rows = whole(vectors)
    for q, weights in zip(own.tolist(), whole(queries), strict=True):
        scores = (rows * weights).sum(1).tolist() if vectors.shape[1] else [0] * len(ids)
        found = sorted((-s, i) for i, s in zip(ids.tolist(), scores, strict=True) if i != q)[:k]
        if any(not -(2**63) <= -s < 2**63 for s, _ in found):
            raise ArithmeticError(f"a score of query {q} exceeds 64 bits")
        yield from ((q, i, -s) for s, i in found)


def _chunks(batches):
    """(ids, vectors) of about CHUNK_BYTES from batches of (id, v): vectors of like lengths together, so that a long one widens no others."""
    held: dict[int, list] = {}
    for batch in batches:
        ids, sizes = batch.column(0).to_numpy(zero_copy_only=False), np.diff(batch.column(1).offsets.to_numpy())
        kinds = np.array([int(n - 1).bit_length() if n else 0 for n in sizes.tolist()])
        for kind in np.unique(kinds).tolist():
            at = np.flatnonzero(kinds == kind)
            step = max(1, CHUNK_BYTES >> (kind + 3))
            for a in range(0, len(at), step):
                rows = at[a : a + step]
                part = batch.column(1).take(pa.array(rows))
                held.setdefault(kind, []).append((ids[rows], as_matrix(part, int(sizes[rows].max(initial=0)))))
                if sum(m.nbytes + 1 for _, m in held[kind]) >= CHUNK_BYTES:
                    yield _joined(held.pop(kind))
    for parts in held.values():
        yield _joined(parts)


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
    width = max(m.shape[1] for _, m in parts)
    return np.concatenate([i for i, _ in parts]), np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in parts])


def _blocks(ids: np.ndarray, vectors: np.ndarray, k: int):
    """Blocks of a chunk without components that are too large, longest vectors first."""
    keep = rarely_equal(ids, vectors, k)
    keep = keep[np.argsort(-_length(vectors[keep]), kind="stable")]
    step = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, vectors.shape[1]))))
    for a in range(0, len(keep), step):
        yield Block(ids[keep[a : a + step]], vectors[keep[a : a + step]])


_BLOCKS = "width int, ids binary, vectors binary, impact binary, step double"


def _indexed(large: float, k: int):
    """Rows (id, v) to rows of _BLOCKS; vectors with too large components are rows of one vector without impacts."""
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def run(batches):
        for ids, vectors in _chunks(batches):
            huge = np.abs(vectors).max(1, initial=0) >= large
            rows = [b.row() for b in _blocks(ids[~huge], vectors[~huge], k)]
            rows += [[vectors.shape[1], ids[i : i + 1].tobytes(), vectors[i].tobytes(), b"", 0.0] for i in np.flatnonzero(huge)]
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), *[pa.binary()] * 3, pa.float64()), strict=True)], names)

    return run


def _search(slab, large: float, k: int, stored_blocks: bool):
    """slab: broadcast (ids, vectors, least) of the queries. Reads rows (id, v), or rows of _BLOCKS."""

    def run(batches):
        own, queries, least = slab.value
        big = np.abs(queries).max(1, initial=0) >= large
        usual = np.flatnonzero(~big)
        best, found = Best(least[usual], k), []

        def exact(ids, vectors, which):
            width = max(vectors.shape[1], queries.shape[1])
            wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
            return exact_pairs(own[which], wide(queries[which]), ids, wide(vectors), k)

        def meet(block):
            walk_block(block, queries[usual], own[usual], best)
            if big.any():
                found.extend(exact(block.ids, block.whole.astype(np.float64), big))

        if stored_blocks:
            for batch in batches:
                for width, ids, vectors, impact, step in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if step:
                        meet(Block.of_row(width, ids, vectors, impact, step))
                    else:
                        found += exact(np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(1, width), slice(None))
        else:
            for ids, vectors in _chunks(batches):
                huge = np.abs(vectors).max(1, initial=0) >= large
                found += exact(ids[huge], vectors[huge], slice(None)) if huge.any() else []
                for block in _blocks(ids[~huge], vectors[~huge], k):
                    meet(block)
        more = np.array(found, np.int64).reshape(-1, 3)
        out = (own[usual][best.query], more[:, 0]), (best.ids, more[:, 1]), (best.scores, more[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return run


def _proven(seeds, width: int, large: float, k: int):
    """Adds to queries (id, v) the k-th best score that they reach among the seeds, -inf where that is not known."""

    def run(batches):
        ids, vectors = seeds.value
        small = np.abs(vectors).max(1, initial=0) < large
        ids, vectors = ids[small], vectors[small]
        blocks = list(_blocks(ids, vectors, k)) if len(ids) else []
        for batch in batches:
            own, queries = batch.column(0).to_numpy(zero_copy_only=False), as_matrix(batch.column(1), width)
            usual = np.flatnonzero(np.abs(queries).max(1, initial=0) < large)
            best, least = Best(np.full(len(usual), -np.inf), k), np.full(len(own), -np.inf)
            for block in blocks:
                walk_block(block, queries[usual], own[usual], best)
            least[usual] = best.least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least)], ["id", "v", "least"])

    return run


def top_k(vectors: DataFrame, every: int, k: int, vec_id: str = "vec_id", embedding: str = "embedding", slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` its k best other rows.

    Ties go to the smaller id. Vectors that are null or hold a null or non-finite component, and rows
    without id, take no part; a shorter vector counts as filled up with zeros, an empty one as all zeros.
    Rows that repeat an id are candidates each, never for their own id; a repeated query id is asked once,
    by its smallest vector. Columns besides the two named are not read; an empty table has no rows.
    Components may have any size: where sums could pass 64 bits they are added in whole numbers without
    bound, and a score of a result that does is an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(embedding)).alias("v")).where("id is not null and v is not null")
    width, asked = (int(x or 0) for x in rows.agg(F.max(F.size("v")), F.count_if(F.col("id") % every == 0)).first())
    large = 2.0 ** ((62 - max(1, width).bit_length()) // 2)
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    held = max(1, width) * 8
    seeds = rows.orderBy(length.desc(), F.xxhash64("id", "v")).limit(max(k + 1, SEED_BYTES // held)).toArrow()
    seeds = spark.sparkContext.broadcast((seeds.column(0).to_numpy(), as_matrix(seeds.column(1), width)))
    slabs = max(1, math.ceil(asked / max(1, slab_bytes // held)))
    asks = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_proven(seeds, width, large, k), "id long, v array<double>, least double")
    asks = asks.withColumn("slab", F.pmod(F.xxhash64("id"), F.lit(slabs)).cast("int"))
    asks = stored(asks) if slabs > 1 else asks
    index = stored(rows.mapInArrow(_indexed(large, k), _BLOCKS)) if slabs > 1 else rows
    found = []
    for s in range(slabs):
        part = asks.where(F.col("slab") == s).toArrow()  # about slab_bytes
        slab = spark.sparkContext.broadcast((part.column(0).to_numpy(), as_matrix(part.column(1), width), part.column(2).to_numpy()))
        of = index.mapInArrow(_search(slab, large, k, slabs > 1), _FOUND)
        found.append(stored(of) if slabs > 1 else of)
    if slabs > 1:
        forget(index)
        forget(asks)
    found = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select vec_id, min(v) v from v where vec_id % 50 = 0 group by vec_id),
s as (select q.vec_id query_id, c.vec_id vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), 0) as bigint) score from a q, v c where q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score from s)
select * from r where rank <= 5
"""

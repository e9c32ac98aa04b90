"""N-gram Jaccard join over count vectors: shingles are hashed into groups, a set becomes a point of
group counts, and the sum of coordinate minima bounds how many shingles two sets can share.

Spark does the partitioning. Of any two sets that link, the rarest shingles (a prefix as long as the
threshold demands) share one; sets that share such a shingle meet in a cell. Rarity is that of the shingle's
bucket in a table of fixed size that all texts are counted into, so that passages of very many documents
come last in the order and open cells only for sets of little else. In a cell an R-tree over
the count vectors finds the pairs whose bound reaches the threshold. Cells give a spanning forest of
those pairs only, whose components ("neighbourhoods") hold every link; inside a neighbourhood the
whole sets are built once more from the texts, searched by the R-tree again, and each surviving pair
is decided by the shingles themselves, as 64-bit hashes of their words. Equal sets are one point
throughout. Cells and neighbourhoods of more than `most` points or of many bytes are split into blocks,
every two blocks a group of their own: exact, and bounded in memory.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.common import chained, connected_components, forget, mix, slices, stored, utf8_buffers, word_hashes

#: Least groups of a count vector (doubled until a group holds four shingles at most on average), points of a leaf, nodes
#: of a node, points of a block, bytes hashed at once, shingles of two leaves that are compared as one matrix.
GROUPS, LEAF, FAN, MOST, SLICE, MATRIX = 64, 32, 8, 1024, 1 << 20, 200_000
#: Bytes of a block, coordinates of node pairs compared at once, rows of whole cells and of whole neighbourhoods that go together.
BLOCK_BYTES, COORDINATES, CELL_ROWS, TEXT_ROWS = 8 << 20, 4_000_000, 10_000, 500
#: Bits of a shingle's bucket; sets in a bucket that count as rare, if the mean bucket has not a quarter of that; sums of tables that the driver gets.
BUCKET_BITS, RARE, SUMS = 20, 64, 12
_SKETCH = "doc_id long, n long, fp1 long, fp2 long, prefix array<long>, counts binary, bytes long"


def shingle_sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of each row: `size` words, or all words of a shorter text."""
    data, at = utf8_buffers(column)
    for row, end in slices(at, SLICE):
        hashes, words = word_hashes(data[at[row] : at[end]], at[row : end + 1] - at[row])
        whole = chained(hashes, size)
        for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
            yield np.unique(whole[a : b - size + 1]) if b - a >= size else chained(hashes[a:b], b - a) if b > a else whole[:0]


def frequency_levels(texts: DataFrame, size: int) -> np.ndarray:
    """For each bucket of shingles how often its count doubles what counts as rare, as bytes: the same 2**BUCKET_BITS numbers for any input.

    Tasks count the sets of all texts; the tables are added up on the executors, by the workers that counted
    (an RDD would have workers of its own beside those), and the driver adds SUMS of them.
    """
    packed = lambda x: pa.compress(x.astype("<i8").tobytes(), codec="zstd", asbytes=True)
    read = lambda b: np.frombuffer(pa.decompress(b, 8 << BUCKET_BITS, codec="zstd", asbytes=True), "<i8")

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            held, n = [], 0
            for u in shingle_sets(batch.column(0), size):
                held.append((u >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
                n += len(u)
                if n >= SLICE:
                    total += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
        yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], ["b"])

    def added(batches):
        total = None
        for batch in batches:
            for b in batch.column(0):
                total = read(b.as_buffer()) if total is None else total + read(b.as_buffer())
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], ["b"])

    tables = texts.select("text").mapInArrow(run, "b binary").repartition(SUMS).mapInArrow(added, "b binary")
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in tables.collect():
        counts += read(row["b"])
    rare = max(RARE, 4 * counts.mean())
    return np.maximum(0, np.ceil(np.log2(np.maximum(counts, 1) / rare))).astype(np.uint8)


def by_rarity(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Sorted hashes by the level of their bucket, then by value: one order for all sets."""
    level = frequent[hashes >> np.uint64(64 - BUCKET_BITS)]
    return hashes[np.argsort(level, kind="stable")] if level.any() else hashes


def levels(sizes: np.ndarray) -> np.ndarray:
    """How often GROUPS is doubled for sets of these sizes; sizes of two sets that link are a level apart at most."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / (4 * GROUPS)))).astype(np.int64)


def group_counts(hashes: np.ndarray) -> np.ndarray:
    groups = GROUPS << int(levels(np.array([len(hashes)]))[0])
    return np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


def as_bytes(counts: np.ndarray) -> bytes:
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


class Points:
    """Count vectors of sets; a vector is brought down a level by adding its halves."""

    def __init__(self, sizes: np.ndarray, vectors: list[np.ndarray]):
        self.sizes, self.vectors, self.levels = sizes, vectors, levels(sizes)

    @classmethod
    def read(cls, sizes: np.ndarray, blobs: list[bytes]) -> "Points":
        groups = (GROUPS << levels(sizes)).tolist()
        return cls(sizes, [np.frombuffer(b, "u1" if len(b) == g else "<u4") for b, g in zip(blobs, groups, strict=True)])

    def at(self, rows: np.ndarray, level: int) -> np.ndarray:
        width, own = GROUPS << level, [self.vectors[r] for r in rows.tolist()]
        if (self.levels[rows] == level).all():
            return np.stack(own).astype(np.int32)
        return np.stack([v.astype(np.int32).reshape(-1, width).sum(0) for v in own])


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    m = mix(hashes)
    return np.array([np.bitwise_xor.reduce(m), np.sum(m)], np.uint64).view(np.int64)


def _sketcher(size: int, num: int, den: int, table):
    """table: broadcast frequency_levels()."""

    def run(batches):
        frequent = table.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            for doc, u in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                n = len(u)
                keep = n - -(-num * n // den) + 1 if n else 0
                fp = fingerprint(u)
                for to, x in zip(out, (doc, n, fp[0], fp[1], by_rarity(u, frequent)[:keep].view(np.int64), as_bytes(group_counts(u))), strict=True):
                    to.append(x)
            at = np.concatenate([[0], np.cumsum([len(x) for x in out[4]])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *out[4]])))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), prefix, pa.array(out[5], pa.binary()), sizes], ["doc_id", "n", "fp1", "fp2", "prefix", "counts", "bytes"])

    return run


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self, which: np.ndarray) -> np.ndarray:
        return np.array([self.root(x) for x in which.tolist()])


def rtree_leaves(points: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Positions packed into leaves: tiles by set size, within a tile by the place of the largest count."""
    order = np.argsort(sizes, kind="stable")
    tile = LEAF * max(1, int(np.sqrt(len(order) / LEAF)))
    out = []
    for i in range(0, len(order), tile):
        part = order[i : i + tile]
        part = part[np.argsort(points[part].argmax(1), kind="stable")]
        out += [part[j : j + LEAF] for j in range(0, len(part), LEAF)]
    return out


class Tree:
    """An R-tree over count vectors: FAN nodes to a node above them, down to leaves. A node's box keeps the largest count of each group and the smallest set size."""

    def __init__(self, tops: np.ndarray, sizes: np.ndarray):
        self.leaves = rtree_leaves(tops, sizes)
        self.levels = [(np.array([tops[x].max(0) for x in self.leaves]), np.array([sizes[x].min() for x in self.leaves]))]
        while len(self.levels[-1][0]) > 1:
            top, low = self.levels[-1]
            at = np.arange(0, len(top), FAN)
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at)))


def _below(nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in `nodes`, child) of all children, a level of n nodes lying below."""
    child = nodes[:, None] * FAN + np.arange(FAN)
    place, at = np.nonzero(child < n)
    return place, child[place, at]


def meeting_leaves(a: Tree, b: Tree, num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of two trees (same: of one with itself, each pair once) whose boxes leave room for a link, going down both trees together."""
    up, to = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        (top_a, low_a), (top_b, low_b) = a.levels[up], b.levels[to]
        step, keep = max(1, COORDINATES // top_a.shape[1]), []
        for x in range(0, len(i), step):
            p, q = i[x : x + step], j[x : x + step]
            keep.append((num + den) * np.minimum(top_a[p], top_b[q]).sum(1) >= num * (low_a[p] + low_b[q]))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        if not up and not to:
            return i, j
        down_a, down_b = up >= to, to >= up
        if down_a:
            up -= 1
            place, i = _below(i, len(a.levels[up][0]))
            j = j[place]
        if down_b:
            to -= 1
            place, j = _below(j, len(b.levels[to][0]))
            i = i[place]
        if same:
            i, j = i[i <= j], j[i <= j]


def _tree_against_tree(points: Points, left: np.ndarray, right: np.ndarray | None, level: int, num: int, den: int, forest: Forest):
    """(rows, cols, which pairs) of leaves of left and right (None: of left with itself) at one level."""
    if not len(left) or right is not None and not len(right):
        return
    tops_left = points.at(left, level)
    tops_right, cols_all = (tops_left, left) if right is None else (points.at(right, level), right)
    ours = Tree(tops_left, points.sizes[left])
    theirs = ours if right is None else Tree(tops_right, points.sizes[right])
    for a, b in zip(*(x.tolist() for x in meeting_leaves(ours, theirs, num, den, right is None)), strict=True):
        x, y = ours.leaves[a], theirs.leaves[b]
        rows, cols = left[x], cols_all[y]
        apart = forest.roots(rows)[:, None] != forest.roots(cols)[None, :]
        if right is None and a == b:
            apart &= np.triu(np.ones_like(apart), 1)
        apart &= den * np.minimum(points.sizes[rows][:, None], points.sizes[cols]) >= num * np.maximum(points.sizes[rows][:, None], points.sizes[cols])
        some = np.flatnonzero(apart.any(1))
        if len(some):
            shared = np.minimum(tops_left[x[some]][:, None, :], tops_right[y][None, :, :]).sum(2)
            apart[some] &= (num + den) * shared >= num * (points.sizes[rows[some]][:, None] + points.sizes[cols][None, :])
            if apart.any():
                yield rows, cols, apart


def rtree_pairs(points: Points, left: np.ndarray, right: np.ndarray | None, num: int, den: int, forest: Forest):
    """Pairs whose bound reaches the threshold, as (rows, cols, matrix of pairs), leaf by leaf; those already joined are left out.

    Two sets of a and b shingles link if (num + den) * shared >= num * (a + b). A box keeps the largest
    count of each group and the smallest size; box against box prunes, then point against point. Vectors
    are compared at the lower of their two levels. right None: pairs within left.
    """
    at = lambda rows, k: rows[points.levels[rows] == k]
    for k in np.unique(points.levels[left if right is None else np.concatenate([left, right])]).tolist():
        sides = [(at(left, k), None), (at(left, k), at(left, k + 1))] if right is None else [(at(left, k), at(right, k)), (at(left, k), at(right, k + 1)), (at(right, k), at(left, k + 1))]
        for a, b in sides:
            yield from _tree_against_tree(points, a, b, k, num, den, forest)


def shared_shingles(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, which: np.ndarray):
    """(i, j, shared shingles) of the pairs asked for: of two leaves at once, or one by one if they are long."""
    rows, which = rows[some := which.any(1)], which[some]
    cols, which = cols[some := which.any(0)], which[:, some]
    own = [sets[i] for i in [*rows.tolist(), *cols.tolist()]]
    lengths = np.array([len(x) for x in own])
    if which.sum() > 8 and lengths.sum() <= MATRIX:
        ids, at = np.unique(np.concatenate(own), return_inverse=True)
        has = np.zeros((len(own), len(ids)), np.float32)
        has[np.repeat(np.arange(len(own)), lengths), at] = 1
        counts = has[: len(rows)] @ has[len(rows) :].T
        for i, j in zip(*(x.tolist() for x in np.nonzero(which)), strict=True):
            yield int(rows[i]), int(cols[j]), int(counts[i, j])
        return
    for i, j in zip(*(x.tolist() for x in np.nonzero(which)), strict=True):
        a, b = sorted((own[i], own[len(rows) + j]), key=len)
        at = np.searchsorted(b, a)
        yield int(rows[i]), int(cols[j]), int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _cells(cell: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Rows of cells with (lo, hi, side): cells (sizes: key, members, bytes) over `most` rows or BLOCK_BYTES are cut into blocks, a group for every two."""
    blocks = F.ceil(F.greatest(F.col("members") / most, F.col("bytes") / BLOCK_BYTES, F.lit(1.0))).cast("int")
    cell = cell.join(sizes.select("key", blocks.alias("blocks")), "key")
    cell = cell.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cell = cell.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return cell.select("*", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi")).drop("other")


def _sides(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    lo, hi, side = (part[c].to_numpy() for c in ("lo", "hi", "side"))
    rows = np.arange(len(part))
    return (rows, None) if lo[0] == hi[0] else (rows[side == lo[0]], rows[side == hi[0]])


def _forest_of_cells(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "lo", "hi", "id"], kind="stable", ignore_index=True)
        ids, points = pdf["id"].to_numpy(), Points.read(pdf["n"].to_numpy(), pdf["counts"].tolist())
        new = (pdf[["key", "lo", "hi"]].to_numpy()[1:] != pdf[["key", "lo", "hi"]].to_numpy()[:-1]).any(1)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(pdf)]])
        edges, width = [], np.diff(starts)
        two = starts[:-1][width == 2]  # most cells: decided at once
        two = two[(pdf["lo"].to_numpy()[two] == pdf["hi"].to_numpy()[two]) | (pdf["side"].to_numpy()[two] != pdf["side"].to_numpy()[two + 1])]
        low = np.minimum(points.levels[two], points.levels[two + 1])
        two, low = two[keep := np.abs(points.levels[two] - points.levels[two + 1]) < 2], low[keep]
        for k in np.unique(low).tolist():
            for at in np.array_split(two[low == k], -(-int((low == k).sum()) // MOST)):
                ok = (num + den) * np.minimum(points.at(at, k), points.at(at + 1, k)).sum(1) >= num * (points.sizes[at] + points.sizes[at + 1])
                edges.append(np.stack([ids[at[ok]], ids[at[ok] + 1]], 1))
        for a, b in zip(starts[:-1][width > 2].tolist(), starts[1:][width > 2].tolist(), strict=True):
            left, right = _sides(pdf.iloc[a:b])
            forest, found = Forest(b - a), []
            part = Points(points.sizes[a:b], points.vectors[a:b])
            for rows, cols, which in rtree_pairs(part, left, right, num, den, forest):
                found += [(x, y) for i, j in zip(*np.nonzero(which), strict=True) if forest.join(x := int(rows[i]), y := int(cols[j]))]
            if found:
                edges.append(ids[np.array(found) + a])
        return pd.DataFrame(np.concatenate([np.zeros((0, 2), np.int64), *edges]), columns=["src", "dst"])

    return run


def _links(size: int, num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, part in pdf.groupby(["key", "lo", "hi"], sort=False):
            sets = list(shingle_sets(pa.array(part["text"], pa.large_string()), size))
            # of the texts of a repeated doc_id the one that has the set
            own = np.array([fingerprint(x)[0] for x in sets]) == part["fp1"].to_numpy()
            own &= ~part["id"].where(own, part.index.to_series()).duplicated().to_numpy()
            part, sets = part[own].reset_index(drop=True), [x for x, o in zip(sets, own.tolist(), strict=True) if o]
            points, ids = Points(np.array([len(x) for x in sets]), [group_counts(x) for x in sets]), part["id"].to_numpy()
            forest = Forest(len(part))
            for rows, cols, which in rtree_pairs(points, *_sides(part), num, den, forest):
                for i, j, shared in shared_shingles(sets, rows, cols, which):
                    if den * shared >= num * (len(sets[i]) + len(sets[j]) - shared) and forest.join(i, j):
                        edges.append((ids[i], ids[j]))
        return pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["src", "dst"])

    return run


def _packed(sizes: DataFrame, most: int, a_task: int) -> Column:
    """A grouping column that puts about `a_task` rows, or BLOCK_BYTES, of whole cells together."""
    blocks = F.greatest(F.col("members") / most, F.col("bytes") / BLOCK_BYTES, F.lit(1.0))
    rows, size = sizes.agg(F.sum(F.col("members") * F.ceil(blocks)), F.sum(F.col("bytes") * F.ceil(blocks))).first()
    return F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(max(12, -(-int(rows or 0) // a_task), -(-int(size or 0) // BLOCK_BYTES))))


def jaccard_components(docs: DataFrame, size: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: texts link if den * shared >= num * union.

    Words are runs of non-space characters with A-Z lower-cased, shingles `size` of them in a row; a
    shorter text is one shingle, a text without words or null has none and links with nothing, nor
    does a row without doc_id (component null). component_id is the smallest doc_id reachable by links.
    Rows that repeat a doc_id are one node, with a set for each of their texts: what links with any of
    these is in its component, and every row keeps the size of its own set. Columns besides the two named
    are not read, so clashing names do no harm; an empty table gives no rows. Shingles are compared by
    hashes of 64 bits.
    """
    of_set = ["fp1", "fp2", "n"]
    set_id = F.xxhash64(*of_set)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequency_levels(texts, size))
    sketch = stored(texts.mapInArrow(_sketcher(size, num, den, table), _SKETCH))
    known = sketch.where("n > 0 and doc_id is not null")
    same = stored(known.groupBy(*of_set).agg(F.min("doc_id").alias("rep")).withColumn("id", set_id))
    reps = known.join(same.withColumnRenamed("rep", "doc_id"), [*of_set, "doc_id"]).dropDuplicates([*of_set, "doc_id"])
    reps = stored(reps.select("id", "n", "prefix", "counts", "bytes"))
    met = reps.select("id", F.explode("prefix").alias("key"))
    # counted before the shuffle: a key that very many sets hold is one row a task here, and is split in the join
    shared = met.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    hit = stored(met.join(shared, "key").select("key", "members", "id"))
    told = hit.groupBy("key").agg(F.max("members").alias("members"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("least"))
    # keys held by the same sets tell the same: one of them is enough
    told = told.groupBy("members", "x", "least").agg(F.min("key").alias("key"))
    cells = stored(hit.join(told.select("key"), "key", "left_semi").select("key", "id"))
    forget(hit)
    weights = cells.join(reps.select("id", F.octet_length("counts").alias("w")), "id")
    sizes = stored(weights.groupBy("key").agg(F.count("*").alias("members"), F.sum("w").alias("bytes")))
    split = _cells(cells, sizes, most).join(reps.select("id", "n", "counts"), "id")
    pack = _packed(sizes, most, CELL_ROWS)
    near = connected_components(split.groupBy(pack).applyInPandas(_forest_of_cells(num, den), "src long, dst long"))
    near = stored(near.withColumnRenamed("component", "key").join(same.select("id", "fp1", F.col("rep").alias("doc_id")), "id"))
    crowd = stored(near.join(reps.select("id", "bytes"), "id").groupBy("key").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes")))
    members_text = _cells(near, crowd, most).join(texts, "doc_id").drop("doc_id")
    pack = _packed(crowd, most, TEXT_ROWS)
    links = members_text.groupBy(pack).applyInPandas(_links(size, num, den), "src long, dst long")
    several = known.groupBy("doc_id").agg(F.min(set_id).alias("dst"), F.max(set_id).alias("_m")).where("dst < _m")
    ties = known.select("doc_id", set_id.alias("src")).join(several.select("doc_id", "dst"), "doc_id").select("src", "dst")
    linked = stored(connected_components(links.unionByName(ties)))
    least = linked.join(same.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("component_id"))
    found = linked.join(least, "component").select("id", "component_id")
    named = stored(same.join(found, "id", "left").select(*of_set, F.coalesce("component_id", "rep").alias("component_id")))
    for x in (reps, cells, sizes, near, crowd, linked, same):
        forget(x)
    # rows without words belong to their doc_id's other texts, where there are any
    blank = sketch.where("n = 0 and doc_id is not null").select("doc_id")
    nodes = known.join(blank.distinct(), "doc_id", "left_semi").select("doc_id", *of_set).join(named, of_set).groupBy("doc_id").agg(F.min("component_id").alias("node"))
    out = known.select("doc_id", *of_set).join(named, of_set).select("doc_id", "n", "component_id")
    out = out.unionByName(blank.join(nodes, "doc_id", "left").select("doc_id", F.lit(0).cast("long").alias("n"), F.coalesce("node", "doc_id").alias("component_id")))
    none = F.lit(None).cast(out.schema["component_id"].dataType)
    out = out.unionByName(sketch.where("doc_id is null").select("doc_id", "n", none.alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


#: DuckDB for small tables; every pair of rows that shares a shingle is counted.
ORACLE = """
with recursive w as (select row_number() over () id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct id, doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') g from (select id, doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) i from w where len(w) > 0)),
n as (select id, count(*) n from s group by id),
p as (select a.id a, b.id b, any_value(a.doc_id) x, any_value(b.doc_id) y, count(*) c from s a join s b on a.g = b.g and a.id < b.id where a.doc_id is not null and b.doc_id is not null group by all),
l as (select distinct x, y from p join n a on p.a = a.id join n b on p.b = b.id where x <> y and 100 * c >= 85 * (a.n + b.n - c)),
e as (select x a, y b from l union select y, x from l),
r as (select distinct doc_id x, doc_id y from w where doc_id is not null union select r.x, e.b from r join e on r.y = e.a)
select w.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) n_shingles, min(r.y) component_id
from w left join n using (id) left join r on w.doc_id = r.x group by w.id, w.doc_id
"""

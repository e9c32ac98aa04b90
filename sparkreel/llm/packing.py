"""Best-fit packing of texts into sequences of several permitted lengths.

Pieces go, longest first, into the open bin that they leave with the least room. Where none has room, a
new bin is opened, of the permitted length that costs least for a token that may get into it: its cost over
what the piece and the pieces after it that still fit could fill. At the end every bin is cut down to the
shortest permitted length that holds its contents. The lengths are optimised jointly: each group of pieces
is also packed with a least length for new bins, and the packing of least total cost stays.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreel.llm import tokens
from sparkreel.llm.common import stored

#: Permitted sequence lengths in tokens, and about how many pieces are packed together.
LENGTHS, TOGETHER = (512, 1024, 2048, 4096, 8192), 8192
#: Equal rows that are numbered together.
COPIES = 65_536
#: A sequence's cost: its length, by so much more as attention over it costs, and a fixed part for handling it.
ATTENTION, FIXED = 1 / 65_536, 16.0
_OUT = "doc_id long, n_tokens long, piece long, start long, length long, bin long, bin_size int, bin_offset int"


def cost(length: int) -> float:
    return FIXED + length * (1 + ATTENTION * length)


def best_fit(sizes: list[int], lengths: tuple[int, ...], least: int = 0) -> tuple[list[int], list[int], list[int]]:
    """Packs descending sizes: each one's bin and offset, and every bin's contents.

    least: no bin is opened shorter than this permitted length, and of the others the one of least cost is;
    0: the one of least cost a token. Ties in cost go to the shorter length, ties in room to the bin that
    got there last.
    """
    room: list[int] = []  # the distinct rooms of open bins, ascending
    having: dict[int, list[int]] = {}
    bins, offsets, filled = [], [], []
    ascending, sums = sizes[::-1], [0, *accumulate(sizes[::-1])]

    def opened(at: int, size: int) -> int:
        if least:
            return min((c for c in lengths if c >= max(size, least)), key=cost)
        # the pieces after this one are the first of `ascending`; those that fit beside it could fill the bin up
        after = len(sizes) - at - 1
        fill = lambda c: min(c, size + sums[min(after, bisect_right(ascending, c - size))])
        return min((c for c in lengths if c >= size), key=lambda c: cost(c) / fill(c))

    for at, size in enumerate(sizes):
        i = bisect_left(room, size)
        if i < len(room):
            left = room[i]
            bin_ = having[left].pop()
            if not having[left]:
                del having[left], room[i]
        else:
            bin_ = len(filled)
            filled.append(0)
            left = opened(at, size)
        bins.append(bin_)
        offsets.append(filled[bin_])
        filled[bin_] += size
        if left := left - size:
            if left not in having:
                having[left] = []
                insort(room, left)
            having[left].append(bin_)
    return bins, offsets, filled


def packed_sizes(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the packings by opening policy: each size's bin and offset, and each bin's final length; ties go to the first policy."""
    final = lambda n: lengths[bisect_left(lengths, n)]
    best = None
    for least in (0, *lengths):
        bins, offsets, filled = best_fit(sizes, lengths, least)
        ends = [final(n) for n in filled]
        total = sum(map(cost, ends))
        if best is None or total < best[0]:
            best = total, bins, offsets, ends
    return best[1:]


def _pack(lengths: tuple[int, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, ends = packed_sizes(pdf["length"].tolist(), lengths)
        pdf = pdf.assign(bin=pdf["group"] * (1 << 24) + np.array(bins), bin_size=[ends[b] for b in bins], bin_offset=offsets, doc_id=pdf["doc_id"].astype("Int64"))
        return pdf[[c.split()[0] for c in _OUT.split(", ")]]

    return run


def pack(docs: DataFrame, length: str, lengths: tuple[int, ...] = LENGTHS, doc_id: str = "doc_id", together: int = TOGETHER) -> DataFrame:
    """(doc_id, n_tokens, piece, start, length, bin, bin_size, bin_offset): a row for every piece of every row.

    `length` names the column with a row's tokens. A row longer than the longest permitted length is
    cut into pieces of that length and a rest; piece and start say which it is and where in the row it begins. A row of
    length null or below 1 takes no room: piece 0, length 0, bin null. Rows that repeat an id are packed each. Pieces are
    dealt to groups of about `together` by hashes of row and piece, so that no row, length or id can fill
    a group; each is packed on its own, and bin numbers are unique over all. Other columns are not read.
    """
    lengths = tuple(sorted(set(lengths)))
    most = lengths[-1]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    copies = stored(rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies")))  # lengths may be costly: they are read once
    count = int(copies.agg(F.sum(F.col("copies") * F.ceil(F.col("n_tokens") / most))).first()[0] or 0)
    # equal rows are told apart by number only: any of them may take any of their places
    parts = copies.select("*", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")).alias("part")).repartition("doc_id", "n_tokens", "part")
    numbered = parts.select("doc_id", "n_tokens", F.explode(F.expr(f"sequence(part * {COPIES} + 1, least(copies, (part + 1) * {COPIES}))")).alias("copy"))
    numbered = numbered.withColumn("row", F.xxhash64("doc_id", "n_tokens", "copy"))
    pieces = numbered.select("*", F.explode(F.expr(f"sequence(0L, greatest(0L, (n_tokens - 1) div {most}))")).alias("piece"))
    pieces = pieces.select("*", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n_tokens") - F.col("piece") * most).alias("length"))
    groups = max(1, -(-count // together))
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    out = grouped.where("length > 0").groupBy("group").applyInPandas(_pack(lengths), _OUT)
    none = grouped.where("length = 0").selectExpr("doc_id", "n_tokens", "piece", "start", "length", "cast(null as long) bin", "cast(null as int) bin_size", "cast(null as int) bin_offset")
    return out.unionByName(none)


def pack_texts(docs: DataFrame, tokenizer: str, lengths: tuple[int, ...] = LENGTHS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """pack() of texts by their tokens under the tokenizer in that file, and one end token each; a null or empty text is that end alone."""
    counted = tokens.token_counts(docs, tokenizer, doc_id=doc_id, text=text)
    return pack(counted.select("doc_id", (F.col("n_tokens") + 1).alias("n")), "n", lengths)

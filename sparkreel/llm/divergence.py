"""How much the sources of a language differ: inclusion-exclusion over the supports of their counts.

A divergence of two groups sums a function of two term probabilities over every kept term, most of which
neither group has. With F(a, b) for counts a and b, the sum over V terms is

    V F(0, 0) + sum over g's terms of F(a, 0) - F(0, 0) + sum over h's terms of F(0, b) - F(0, 0)
    + sum over the terms of both of F(a, b) - F(a, 0) - F(0, b) + F(0, 0)

so a constant covers the terms of neither, histograms of each group's counts price the one-sided sums
without its terms, and only terms that two groups share meet, in a join of sparse postings. No group's
row of all kept terms is ever made.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.llm.common import LOWER, UPPER, slices, stored, utf8_buffers

#: Bytes of texts counted at once; shares in which a language's groups meet one another.
SLICE, SHARES = 2 << 20, 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.arange(256) >= 0x80
_INSIDE[97:123] = True
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms(column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(row, number, dictionary) of all terms of a column of texts: runs of letters and of what is not ASCII, A-Z lower-cased."""
    data, at = utf8_buffers(column)
    data = _FOLD[data]
    inside = _INSIDE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    start = np.flatnonzero(first)
    offsets = np.append(np.cumsum(inside)[start] - 1, inside.sum()).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
    return np.searchsorted(at, start, "right") - 1, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.cast(pa.string())


def counted(batches):
    """Rows (lang, source, term, n, docs): occurrences and texts with the term, a slice of texts at a time; one without a term for each group."""
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    for batch in batches:
        codes = [batch.column(i).dictionary_encode() for i in (0, 1)]
        pairs = np.stack([c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in codes], 1)
        groups, of = np.unique(pairs, axis=0, return_inverse=True)
        of = of.reshape(-1)
        label = [c.dictionary.take(pa.array(groups[:, i])) for i, c in enumerate(codes)]
        yield pa.RecordBatch.from_arrays([*label, pa.nulls(len(groups), pa.string()), pa.array(np.zeros(len(groups), np.int64)), pa.array(np.bincount(of, minlength=len(groups)))], names)
        _, at = utf8_buffers(batch.column(2))
        for a, b in slices(at, SLICE):
            row, word, words = terms(batch.column(2).slice(a, b - a))
            if not len(row):
                continue
            key, n = np.unique(row * len(words) + word, return_counts=True)
            key, place = np.unique(of[a + key // len(words)] * len(words) + key % len(words), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, place, n)
            group = pa.array(key // len(words))
            yield pa.RecordBatch.from_arrays([label[0].take(group), label[1].take(group), words.take(pa.array(key % len(words))), pa.array(total), pa.array(np.bincount(place))], names)


def probability(n: Column, size: Column, kept: Column, scale: int, extra: int) -> Column:
    """1 + floor(scale * (n + 1) / (size + extra * kept)), in decimals: a count times the scale may not fit a long. Null without kept terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    top, bottom = F.lit(scale).cast("decimal(10,0)") * wide(n + 1), wide(size + extra * kept)
    return F.when(kept > 0, F.call_function("div", top, bottom) + 1)


def gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 3, scale: int = 1_000_000_000, extra: int = 1, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and the terms that it has too often.

    A language keeps the terms that `least` of its documents have. Part `pair` has a row for each other
    source of the language with the divergence from it, part `term` the `top` terms with the largest
    share in the divergence from the whole language among those that are likelier in the source. Ranks
    go by value, largest first, then by item. A source without terms is a group too; without kept terms
    every pair has value 0. Null texts, languages and sources are empty texts, repeated rows count each,
    an empty table gives no rows, other columns are not read. Whole numbers throughout; sums fit a long
    while a language keeps fewer than 500 million terms, and beyond that Spark raises an error (ANSI mode).

    Counts are summed inside the tasks before they move, so a hot source moves no more rows than it has
    terms. The pairs of a language's sources are the answer's own rows; they are made in SHARES parts.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = stored(rows.mapInArrow(counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    known = found.where("term is not null")
    whole = known.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    kept = stored(known.select("lang", "source", "term", "n").join(whole, ["lang", "term"]))
    # every kept term's total once: the shares of its groups sum to it
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = whole.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    groups = found.where("term is null").select("lang", "source").join(size, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "kept", "lang_size")])
    p = lambda n, of: probability(n, F.col(of), F.col("kept"), scale, extra)
    groups = stored(groups.withColumn("none", p(F.lit(0), "size")))
    priced = kept.join(groups, ["lang", "source"]).withColumn("p", p(F.col("n"), "size"))

    # each group of a language beside each other one, in shares by the first's name
    share = F.pmod(F.hash("source"), F.lit(SHARES))
    others = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    beside = lambda df: df.withColumn("share", share).join(others, ["lang", "share"]).where("source <> other")
    neither = beside(groups.select("lang", "source", "kept", "none")).select("lang", "source", "other", F.expr(f"coalesce(kept * ({gap('none', 'other_none')}), 0)").alias("value"))

    both_ways = lambda df: df.select("lang", F.expr("stack(2, source, other, there, other, source, back) as (source, other, value)"))
    histogram = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups, ["lang", "source"]).withColumn("p", p(F.col("n"), "size"))
    one = beside(histogram.select("lang", "source", "times", "p", "none")).groupBy("lang", "source", "other").agg(
        F.expr(f"sum(times * ({gap('p', 'other_none')} - {gap('none', 'other_none')}))").alias("there"), F.expr(f"sum(times * ({gap('other_none', 'p')} - {gap('other_none', 'none')}))").alias("back")
    )
    left = priced.select("lang", "term", "source", "p", F.col("none").alias("p0"))
    right = priced.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("none").alias("q0"))
    excess = lambda p, q: f"sum({gap(p, q)} - {gap(p, q + '0')} - {gap(p + '0', q)} + {gap(p + '0', q + '0')})"
    shared = left.join(right, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(F.expr(excess("p", "q")).alias("there"), F.expr(excess("q", "p")).alias("back"))
    pairs = reduce(DataFrame.unionByName, [neither, both_ways(one), both_ways(shared)]).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    special = priced.withColumn("q", p(F.col("total"), "lang_size")).where("n > 0 and p > q")
    special = special.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    special = special.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(special)


ORACLE = f"""with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
k as (select lang, term, count(*) total from w group by all having count(distinct r) >= 3),
c as (select lang, source, term, count(*) n from w semi join k using (lang, term) group by all),
l as (select lang, count(*) v, sum(total)::hugeint s from k group by all),
g as (select d.lang, d.source, coalesce(any_value(v), 0) v, coalesce(any_value(l.s), 0) ls, coalesce(any_value(z.s), 0)::hugeint s from (select distinct lang, source from d) d left join l using (lang) left join (select lang, source, sum(n) s from c group by all) z on z.lang = d.lang and z.source = d.source group by all),
p as (select g.lang, g.source, k.term, coalesce(n, 0) n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 1)) // (g.s + g.v) p, 1 + (1000000000::hugeint * (k.total + 1)) // (g.ls + g.v) q from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
x as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(x.f, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
special as (select lang, source, 'term' part, term item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q)
select lang, source, part, item, value, rank::int rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) rank from (select * from pairs union all select * from special))
where part = 'pair' or rank <= 200"""

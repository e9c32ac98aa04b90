"""Benchmark decontamination by winnowing, in DataFrame functions only.

A document and a benchmark item that share `window` words share a fingerprint: of every
`window - gram + 1` consecutive hashes of `gram` words the smallest is kept, the leftmost of equal
ones, and that choice depends on nothing outside the shared words. Fingerprints are joined, and each
meeting (document, item, offset between them) is extended along that offset word by word, so every
reported window is an exact match. A window that both share holds a fingerprint of its own, so a meeting
needs no more of either text than the words that a window around its place can have: a shared passage
of any length is put together from the windows of its own meetings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.common import lower_ascii, stored

#: Fixed by the contract: a word, once A-Z is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM, WINDOW = 8, 13
#: Words on either side of a fingerprint's place that a window with it can reach.
REACH = WINDOW - 1
#: Fingerprints of the benchmark up to this number go into the plan as a set of literals; more are joined by shuffle.
INLINE = 20_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _doubled(column: str, step: int, combine) -> Column:
    """Each element combined with the one `step` further on; past the end it stays as it is."""
    return F.transform(column, lambda x, i: combine(x, F.get(F.col(column), i + step)))


def with_fingerprints(df: DataFrame, words: str, to: str) -> DataFrame:
    """Adds the distinct fingerprints of a column of words: 32 bits of hash above 32 bits of position.

    GRAM = 8 and WINDOW - GRAM + 1 = 6 are reached by doubling: hashes of 1, 2, 4, 8 words, minima of
    2, 4, 6 hashes. At the end of a text shorter grams and windows stay in; they only add meetings,
    which the extension then refuses.
    """
    pair = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        df = df.withColumn("_h", _doubled("_h", step, pair))
    df = df.withColumn("_h", F.transform("_h", lambda x, i: F.shiftleft(x, 32).bitwiseOR(i.cast("long"))))
    for step in (1, 2, 2):
        df = df.withColumn("_h", _doubled("_h", step, lambda a, b: F.least(a, b)))
    return df.withColumn(to, F.array_distinct("_h")).drop("_h")


def _print(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def _around(words: str, at: Column) -> Column:
    """The words within REACH of a place."""
    return F.slice(words, F.greatest(F.lit(1), at + 1 - REACH), REACH + 1 + F.least(at, F.lit(REACH)))


def _short_grams(words: str, n: int) -> Column:
    """Every n consecutive words as (hash, position), for items of fewer words than a window."""
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.shiftleft(F.xxhash64(F.lit(n), F.array_join(F.slice(words, i + 1, n), " ")), 32).bitwiseOR(i.cast("long"))),
    ).otherwise(F.array().cast("array<bigint>"))


def benchmark_prints(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, unit, print, place, item_n, item_near) of every fingerprint of every item: unit is the window's length, item_near the words within REACH of the place."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("item_words")).where("size(item_words) > 0 and item_id is not null")
    items = with_fingerprints(items, "item_words", "_long").withColumn("unit", F.least(F.size("item_words"), F.lit(WINDOW)))
    short = F.array(F.shiftleft(F.xxhash64(F.col("unit"), F.array_join("item_words", " ")), 32))
    items = items.select("item_id", "item_words", "unit", F.explode(F.when(F.size("item_words") >= WINDOW, F.col("_long")).otherwise(short)).alias("_x"))
    items = items.select("item_id", "item_words", "unit", _print(F.col("_x")).alias("print"), _place(F.col("_x")).alias("place"))
    return items.select("item_id", "unit", "print", "place", F.size("item_words").alias("item_n"), _around("item_words", F.col("place")).alias("item_near"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", inline: int = INLINE) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, item_ids) of every row; item_ids is an ascending array of the items found in it.

    Null or empty texts have no words. A null item id or text takes no part; rows that repeat an item id
    are windows of that one item. Rows that repeat a doc_id, null ids too, have a result each;
    text_hash (64 bits) tells their texts apart. Columns besides the named ones are not read.

    Few benchmark fingerprints are known inside every row, so only words around a meeting leave it. Many are
    joined by a shuffle: then (row, fingerprint, place) alone travels, and the meetings go back to the texts
    of the rows that have one.
    """
    prints = benchmark_prints(benchmark)
    known = prints.select("unit", "print").distinct()
    sizes = benchmark.select(F.size(words_of(F.col("text"))).alias("n")).where("n > 0").agg(F.max("n"), F.array_sort(F.collect_set(F.when(F.col("n") < WINDOW, F.col("n"))))).first()
    longest, lengths = int(sizes[0] or 0), list(sizes[1] or [])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    if not longest:
        return rows.select("doc_id", "text_hash", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<bigint>").alias("item_ids"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    units = [WINDOW, *lengths]

    def printed(df: DataFrame) -> DataFrame:
        df = with_fingerprints(df.withColumn("words", words_of(F.col("text"))).drop("text"), "words", "_p13")
        for n in lengths:
            df = df.withColumn(f"_p{n}", _short_grams("words", n))
        return df

    met = lambda u, xs: F.transform(xs, lambda x: F.struct(F.lit(u).alias("unit"), _print(x).alias("print"), _place(x).alias("at")))
    taken = known.limit(inline + 1).collect()
    if len(taken) <= inline:
        held = {u: [r["print"] for r in taken if r["unit"] == u] for u in units}
        rows = printed(rows).withColumn("meets", F.concat(*[met(u, F.filter(f"_p{u}", lambda x: _print(x).isin(held[u]))) for u in units]))
    else:
        rows = stored(rows)  # the number of a row must be the same in both uses
        all_prints = printed(rows).select("_row", F.explode(F.concat(*[met(u, F.col(f"_p{u}")) for u in units])).alias("m")).select("_row", "m.*")
        some = all_prints.join(known, ["unit", "print"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("unit", "print", "at")).alias("meets"))
        rows = rows.join(some, "_row", "left").withColumn("words", words_of(F.col("text")))
        rows = rows.withColumn("meets", F.coalesce("meets", F.array().cast("array<struct<unit:int,print:int,at:int>>")))
    near = lambda m: F.struct(m["unit"].alias("unit"), m["print"].alias("print"), m["at"].alias("at"), _around("words", m["at"]).alias("near"))
    count = F.struct(F.lit(None).cast("int").alias("unit"), F.lit(None).cast("int").alias("print"), F.size("words").alias("at"), F.array().cast("array<string>").alias("near"))
    met = rows.select("_row", "doc_id", "text_hash", F.explode(F.concat(F.array(count), F.transform("meets", near))).alias("m")).select("_row", "doc_id", "text_hash", "m.*")
    met = met.join(prints, ["unit", "print"], "left").where("unit is null or item_id is not null")
    # along one offset: word j of the item lies at word at - place + j of the document
    first = lambda at: F.greatest(F.lit(0), F.col(at) - REACH)
    met = met.withColumn("off", F.col("at") - F.col("place")).withColumn("base", first("at")).withColumn("item_base", first("place"))
    begins = F.filter(
        F.sequence("item_base", F.least(F.col("place"), F.col("item_n") - F.col("unit"))),
        lambda j: (F.col("off") + j >= F.col("base")) & (F.slice("near", F.greatest(F.lit(1), F.col("off") + j - F.col("base") + 1), F.col("unit")) == F.slice("item_near", j - F.col("item_base") + 1, F.col("unit"))),
    )
    spans = F.transform(begins, lambda j: F.struct((F.col("off") + j).alias("b"), (F.col("off") + j + F.col("unit")).alias("e")))
    found = met.withColumn("spans", F.when(F.col("unit").isNotNull(), spans)).where("unit is null or size(spans) > 0")
    # meetings close to one another find the same windows
    found = found.select("_row", "doc_id", "text_hash", F.col("item_id").alias("item"), F.when(F.col("unit").isNull(), F.col("at")).alias("n_words"), "spans").distinct()
    joined = F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans"))))
    by_row = found.groupBy("_row", "doc_id", "text_hash").agg(F.max("n_words").cast("long").alias("n_words"), joined.alias("spans"), F.array_sort(F.collect_set("item")).alias("item_ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["b"], a["to"]))).alias("n"), F.greatest(a["to"], s["e"]).alias("to")),
        lambda a: a["n"],
    )
    return by_row.select("doc_id", "text_hash", "n_words", F.when(F.size("spans") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_hit"), "item_ids")


def report(found: DataFrame, *also: str) -> DataFrame:
    """The contract's columns from contamination(), and those of its own that are asked for."""
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), *also,
    )


ORACLE = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
bw as (select item_id, least(13, len(w)) u, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') g from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from b where len(w) > 0)),
units as (select distinct u from bw),
dw as (select r, u, i, array_to_string(w[i:i + u - 1], ' ') g from (select r, w, u, unnest(range(1, len(w) - u + 2)) i from d, units where len(w) >= u)),
hit as (select distinct r, i, dw.u u, item_id from dw join bw on dw.g = bw.g and dw.u = bw.u),
pos as (select r, count(distinct p) n_hit from (select r, unnest(range(i, i + u)) p from hit) group by r),
items as (select r, count(*) n_items, string_agg(s, ',' order by s) ids from (select distinct r, cast(item_id as varchar) s from hit) group by r)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join pos using (r) left join items using (r)
"""

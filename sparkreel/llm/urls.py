"""URL filter in DataFrame functions: host and path rules, then a ratio of two character models.

Both models are variable-order Markov models over the characters of a URL, one counted on accepted and
one on rejected URLs. A context is kept while it was seen often enough, up to `ORDER` characters;
the probability of a character after a context mixes its frequency there with its probability after the
context one character shorter. A URL's score is the mean, over its characters, of the log-likelihood
difference; the cut between allow and block is where the balanced accuracy on labelled URLs that the
models have not seen is highest. Labels come from the rules alone: on hosts that no rule names the verdict
carries over what their URLs have in common with those of the rules' hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkreel.llm.common import forget, lower_ascii, stored

#: (verdict, rule) of the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Longest context; occurrences that keep a context; weight of the shorter context; grams that are broadcast, more are shuffled.
ORDER, KEEP, WEIGHT, SMALL = 4, 8, 2.0, 100_000
#: The characters modelled: printable ASCII, and one mark for all others. EDGE stands before a URL's first one.
ALPHABET = [chr(c) for c in range(0x21, 0x7F)] + ["�"]
EDGE = "\u0002"
#: Width of a score's bin in the calibration, and the score at which bins end.
BIN, END = 0.002, 8.0
#: One in so many labelled URLs, by crc32, is kept from the models and calibrates the cut.
HELD = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Contract: between the first :// and /, ?, # or the end, A-Z lower-cased; then up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does; the earlier of two equally long ones."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _characters(df: DataFrame, url: str, keep: list[str]) -> DataFrame:
    """A row per character of a lower-cased URL: itself and the ORDER characters before it.

    Query strings of numbers say nothing that generalises: every digit is 0.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(url), F.lit(""))), "[0-9]", "0"), "[^\\x21-\\x7e]", "�")
    df = df.withColumn("_u", F.concat(F.lit(EDGE * ORDER), plain))
    at = F.explode_outer(F.when(F.length("_u") > ORDER, F.sequence(F.lit(1), F.length("_u") - ORDER)))
    return df.select(*keep, "_u", at.alias("_i")).select(*keep, F.expr(f"substring(_u, _i, {ORDER})").alias("before"), F.expr(f"substring(_u, _i + {ORDER}, 1)").alias("char"))


def _tail(n: int) -> Column:
    return F.expr(f"substring(before, {ORDER - n + 1}, {n})") if n else F.lit("")


def fit(rows: DataFrame) -> DataFrame:
    """(before, char, value) of every gram in the rows (url, good), good being null where a row has no label.

    The value is the log-likelihood difference in the longest kept context. Every context with KEEP
    labelled occurrences is kept. Counts cover all rows: they are summed before the shuffle, and only
    sums move; later joins are by gram.
    """
    counts = stored(_characters(rows, "url", ["good"]).where("char is not null").groupBy("before", "char").agg(F.count_if("good").alias("yes"), F.count_if(~F.col("good")).alias("no")))
    labelled = counts.where("yes + no > 0")
    out = counts.select("before", "char", F.lit(1 / len(ALPHABET)).alias("p_yes"), F.lit(1 / len(ALPHABET)).alias("p_no"))
    for n in range(ORDER + 1):
        grams = labelled.groupBy(_tail(n).alias("ctx"), "char").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        kept = grams.groupBy("ctx").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no"))
        if n:
            kept = kept.where(F.col("all_yes") + F.col("all_no") >= KEEP)
        # the few contexts of low orders would each be one task's; the alphabet bounds their number
        out = out.withColumn("ctx", _tail(n)).join(F.broadcast(kept) if n <= 2 else kept, "ctx", "left").join(F.broadcast(grams) if n <= 1 else grams, ["ctx", "char"], "left")
        share = lambda of: F.when(F.col(f"all_{of}").isNull(), F.col(f"p_{of}")).otherwise((F.coalesce(of, F.lit(0)) + WEIGHT * F.col(f"p_{of}")) / (F.col(f"all_{of}") + WEIGHT)).alias(f"p_{of}")
        out = out.select("before", "char", share("yes"), share("no"))
    out = stored(out.select("before", "char", (F.log("p_yes") - F.log("p_no")).alias("value")))
    forget(counts)
    return out


def score(rows: DataFrame, values: DataFrame, keep: list[str], small: int = SMALL) -> DataFrame:
    """Each row's `keep` columns with score, its characters' mean value.

    Up to `small` values are broadcast: a row's characters are then summed in the task that made them, so
    the shuffle carries one row for each URL. More are joined by a shuffle of each URL's different grams.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    if values.limit(small + 1).count() <= small:
        found = _characters(rows, "url", ["_row", *keep]).join(F.broadcast(values), ["before", "char"], "left")
        return found.groupBy("_row").agg(*[F.first(c).alias(c) for c in keep], F.avg(F.coalesce("value", F.lit(0.0))).alias("score")).drop("_row")
    rows = stored(rows)
    grams = _characters(rows, "url", ["_row"]).groupBy("_row", "before", "char").count().join(values.hint("merge"), ["before", "char"])
    sums = grams.groupBy("_row").agg((F.sum(F.col("value") * F.col("count")) / F.sum("count")).alias("score"))
    return rows.join(sums, "_row", "left").select(*keep, F.coalesce("score", F.lit(0.0)).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The cut with the highest balanced accuracy over (good, score), half-way to the next score; scores are counted in at most 8,001 bins."""
    bins = scored.groupBy(F.round(F.greatest(F.lit(-END), F.least(F.lit(END), "score")) / BIN).cast("int").alias("bin")).agg(F.count_if("good").alias("yes"), F.count_if(~F.col("good")).alias("no"))
    up, alls = W.orderBy("bin"), W.partitionBy()
    gain = F.coalesce(F.try_divide(F.sum("no").over(up), F.sum("no").over(alls)), F.lit(0.0)) - F.coalesce(F.try_divide(F.sum("yes").over(up), F.sum("yes").over(alls)), F.lit(0.0))
    best = bins.select("bin", gain.alias("gain"), F.lead("bin").over(up).alias("next")).orderBy(F.desc("gain"), "bin").first()
    return (best["bin"] + (best["next"] if best["next"] is not None else best["bin"] + 1)) / 2 * BIN if best else 0.0


def url_verdicts(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, small: int = SMALL) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    Rules decide where one fits; their URLs are the labelled rows, an allowed one accepted and a blocked one
    rejected: one in HELD calibrates the cut, the models learn from the others. Elsewhere the score
    decides: allow from the cut on; the lowest of equally good cuts holds. Without labelled rows of either
    kind the models are alike, every score is 0 and the cut too: allow. A null or empty URL has score 0. Rows that
    repeat an id keep a verdict each; columns besides the two named are not read.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"))
    held = F.crc32(F.col("url").cast("binary")) % HELD == 0
    values = fit(rows.select("url", F.when(~held, F.col("said") == "allow").alias("good")))
    scored = stored(score(rows.withColumn("held", held), values, ["page_id", "host", "path", "rule", "said", "held"], small))
    cut = calibrate(scored.where("rule is not null and held").select((F.col("said") == "allow").alias("good"), "score"))
    verdict = F.coalesce("said", F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

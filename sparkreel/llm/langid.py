"""Language identification by a linear-chain conditional random field over words.

Words get affix, n-gram and lexicon features; moves between languages are learned from rows that change
language, made of stretches of the labelled texts; forward-backward labels every word, and a text's
language is the one most of its words carry, its score that language's mean probability.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreel.llm.crf import Field, padded

#: Bounds of the labelled sample: texts of each language, of each where there are many, of all of those, characters of each, words of a language in the lexicon.
TEXTS, FEWEST, ALL_TEXTS, CHARACTERS, LEXICON = 80, 10, 2_560, 3_000, 400
#: Words of a training chain; words of a text from which on it is labelled in parts of PART words that hand messages on.
CHAIN, WHOLE, PART = 128, 1024, 256
#: Words of a stretch of one language in a training row that changes language, and such rows for each labelled text.
STRETCH, SWITCHED = (3, 24), 0.5
#: Words that a worker keeps, words labelled at once, new words whose features are looked up at once.
CACHE, AT_ONCE, AT_TIME = 200_000, 300_000, 10_000
#: Places of the padded matrices; with more languages than USUAL, fewer of them, and fewer words kept.
PLACES, USUAL = 262_144, 16
WORD = re.compile(r"[^\W\d_]+")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def word_features(word: str, lexicon: frozenset) -> list[str]:
    """Names of a word's features: a bias, prefixes, affixes at the end, n-grams with its edges, its place in the lexicon."""
    w, some = f"<{word}>", range(1, min(3, len(word)) + 1)
    out = ["", *("<" + word[:n] for n in some), *("-" + word[-n:] for n in some), *("~" + w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1))]
    return [*out, "=" + word] if word in lexicon else out


def _code(chars: list[np.ndarray]) -> np.ndarray:
    """Up to three code points as one number."""
    return sum((c.astype(np.int64) << (21 * i) for i, c in enumerate(chars)), np.int64(0))


class Emissions:
    """The summed weights of word_features, for many words at once: tables of code points instead of names."""

    def __init__(self, field: Field):
        self.labels = len(field.labels)
        self.bias = field.weights[field.features[""]] if "" in field.features else np.zeros(self.labels)
        self.known = {f[1:]: i for f, i in field.features.items() if f[:1] == "="}
        self.known_weights = np.concatenate([field.weights, np.zeros((1, self.labels))])
        self.tables = {}
        for kind in "<-~":
            for n in (1, 2, 3):
                own = [(f[1:], i) for f, i in field.features.items() if f[:1] == kind and len(f) == n + 1]
                codes = _code([np.array([ord(f[j]) for f, _ in own], np.int64) for j in range(n)])
                order = np.argsort(codes)
                self.tables[kind, n] = codes[order], np.concatenate([field.weights[[i for _, i in own]][order].reshape(-1, self.labels), np.zeros((1, self.labels))])

    def _weights(self, kind: str, n: int, codes: np.ndarray) -> np.ndarray:
        own, weights = self.tables[kind, n]
        at = np.searchsorted(own, codes)
        at[at < len(own)] = np.where(own[at[at < len(own)]] == codes[at < len(own)], at[at < len(own)], len(own))
        return weights[at]

    def __call__(self, words: list[str]) -> np.ndarray:
        chars = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
        none = len(self.known_weights) - 1
        out = self.bias + self.known_weights[[self.known.get(w, none) for w in words]]
        for n in (1, 2, 3):
            long = np.flatnonzero(size >= n)
            first, last = start[long] + 1, start[long] + 1 + size[long] - n
            out[long] += self._weights("<", n, _code([chars[first + j] for j in range(n)]))
            out[long] += self._weights("-", n, _code([chars[last + j] for j in range(n)]))
            grams = self._weights("~", n, _code([chars[j : len(chars) - n + 1 + j] for j in range(n)]))
            for j in range(1, n):  # those that reach into the next word
                grams[(start[1:] - j)] = 0
            out += np.add.reduceat(grams, np.minimum(start, len(grams) - 1)) if len(grams) > start[-1] else np.concatenate([np.add.reduceat(grams, start[:-1]), np.zeros((1, self.labels))])
        return out


def labelled_sample(docs: DataFrame, doc_id: str, text: str, lang: str, where: Column) -> list:
    """TEXTS rows of every language (fewer of each, but FEWEST, where that is more than ALL_TEXTS), by a hash of text and id; rows over CHARACTERS come last, and give so many from a place that the hash names."""
    rows = docs.where(where & F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.col(doc_id)).alias("h"))
    start = 1 + F.pmod("h", F.greatest(F.lit(1), F.length("text") - CHARACTERS + 1))
    rows = rows.select("lang", "h", F.substring("text", start.cast("int"), F.lit(CHARACTERS)).alias("text"), (F.length("text") > CHARACTERS).alias("long"))
    each = max(FEWEST, min(TEXTS, ALL_TEXTS // max(1, rows.select("lang").distinct().count())))
    top = rows.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("long", "h", "text"))).where(F.col("n") <= each)
    return top.select("lang", "text", "h").orderBy("lang", "h", "text").collect()


def switched(texts: list[tuple[int, list[str]]], rows: int, seed: int = 11):
    """(labels, words) of rows that change language: stretches of two texts of different languages by turns."""
    r = np.random.default_rng(seed)
    labels = np.array([i for i, _ in texts])
    if len(set(labels.tolist())) < 2:
        return
    for _ in range(rows):
        one = int(r.integers(len(texts)))
        two = int(r.choice(np.flatnonzero(labels != labels[one])))
        out: tuple[list, list] = ([], [])
        for turn in range(int(r.integers(2, 5))):
            label, words = texts[(one, two)[turn % 2]]
            n = int(r.integers(*STRETCH))
            at = int(r.integers(max(1, len(words) - n + 1)))
            out[0].extend([label] * len(words[at : at + n]))
            out[1].extend(words[at : at + n])
        yield out


def fit(sample: list) -> tuple[Field, frozenset] | None:
    """The field and its lexicon from rows of (lang, text): every word of a row carries its language, and rows that change language are made of them."""
    labels = sorted({r["lang"] for r in sample})
    if not labels:
        return None
    texts = [(labels.index(r["lang"]), WORD.findall(r["text"].lower())) for r in sample]
    counts: dict[int, Counter] = {i: Counter() for i in range(len(labels))}
    for i, words in texts:
        counts[i].update(words)
    lexicon = frozenset(w for c in counts.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])
    number: dict[str, int] = {}
    sequences, answers = [], []
    rows = [([i] * len(words), words) for i, words in texts]
    for said, words in [*rows, *switched(texts, int(SWITCHED * len(texts)))]:
        ids = [number.setdefault(w, len(number)) for w in words]
        for a in range(0, len(ids), CHAIN):
            sequences.append(np.array(ids[a : a + CHAIN], np.int64))
            answers.append(np.array(said[a : a + CHAIN], np.int64))
    events = [word_features(w, lexicon) for w in number]
    return Field(labels).fit(events, sequences, answers, rounds=40, least=3), lexicon


class Labeller:
    """Word probabilities in batches; a worker's words keep their emissions until CACHE of them are known."""

    def __init__(self, field: Field, lexicon: frozenset):
        self.field, self.emissions = field, Emissions(field)
        self.number: dict[str, int] = {}
        self.table = np.zeros((0, len(field.labels)))

    def numbers(self, words: list[str]) -> np.ndarray:
        number = self.number
        new = [w for w in dict.fromkeys(words) if w not in number]
        if len(number) + len(new) > CACHE * USUAL // max(USUAL, len(self.field.labels)):
            number.clear()
            self.table = self.table[:0]
            new = list(dict.fromkeys(words))
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            self.table = np.concatenate([self.table, *(self.emissions(new[i : i + AT_TIME]) for i in range(0, len(new), AT_TIME))])
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def _blocks(self, chains: list[np.ndarray]):
        """(which, padded numbers, lengths) of chains of like length, so many that the matrix has about PLACES places."""
        sizes = np.array([len(c) for c in chains], np.int64)
        order, a = np.argsort(sizes, kind="stable"), 0
        most = PLACES * USUAL // max(USUAL, len(self.field.labels))
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * sizes[order[b]] <= most:
                b += 1
            yield order[a:b], *padded([chains[i] for i in order[a:b]])
            a = b

    def _parts(self, long: list[np.ndarray]):
        """Long texts in parts: (owner of each part, parts, messages that enter them at either end)."""
        parts = [t[a : a + PART] for t in long for a in range(0, len(t), PART)]
        owner = np.repeat(np.arange(len(long)), [-(-len(t) // PART) for t in long])
        k = len(self.field.labels)
        if k > USUAL:  # transfers cost a square of labels a word
            return owner, parts, *self._handed_on(owner, parts)
        transfers, before, after = np.zeros((len(parts), k, k)), *np.zeros((2, len(parts), k))
        for which, x, lengths in self._blocks(parts):
            transfers[which] = self.field.transfers(self.table[x], lengths)
        for i in range(len(long)):
            own = owner == i
            before[own], after[own] = self.field.messages(transfers[own])
        return owner, parts, before, after

    def _handed_on(self, owner: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The messages of _parts() by going through the texts part by part, forth and back; only those at the parts' ends are kept."""
        k, place = len(self.field.labels), np.arange(len(parts)) - np.searchsorted(owner, owner)
        before, after = np.ones((2, len(parts), k))
        first = self.field.first
        before[place == 0] = np.exp(first - first.max())
        last = int(place.max(initial=0))
        for step in range(last):
            here = np.flatnonzero(place == step)
            here = here[np.isin(here + 1, np.flatnonzero(place == step + 1))]
            for which, x, lengths in self._blocks([parts[i] for i in here]):
                before[here[which] + 1] = self.field.carried(self.table[x], lengths, before[here[which]])
        for step in range(last, 0, -1):
            here = np.flatnonzero(place == step)
            for which, x, lengths in self._blocks([parts[i] for i in here]):
                after[here[which] - 1] = self.field.brought(self.table[x], lengths, after[here[which]])
        return before, after

    def probabilities(self, texts: list[list[str]]):
        """(text, place of its first word, lengths, label probabilities) of blocks of texts or parts of texts."""
        ids = self.numbers([w for t in texts for w in t])
        own = np.split(ids, np.cumsum([len(t) for t in texts])[:-1]) if texts else []
        short = [i for i, t in enumerate(own) if len(t) <= WHOLE]
        for which, x, lengths in self._blocks([own[i] for i in short]):
            yield np.array(short)[which], np.zeros(len(which), np.int64), lengths, self.field.marginals(self.table[x], lengths)
        long = [i for i, t in enumerate(own) if len(t) > WHOLE]
        if long:
            owner, parts, before, after = self._parts([own[i] for i in long])
            place = np.concatenate([np.arange(0, len(own[i]), PART) for i in long])
            for which, x, lengths in self._blocks(parts):
                yield np.array(long)[owner[which]], place[which], lengths, self.field.marginals(self.table[x], lengths, before=before[which], after=after[which])

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """For each text the sum of its words' label probabilities."""
        out = np.zeros((len(texts), len(self.field.labels)))
        for which, _, lengths, p in self.probabilities(texts):
            p[np.arange(p.shape[1])[None, :] >= lengths[:, None]] = 0
            np.add.at(out, which, p.sum(1))
        return out

    def words(self, texts: list[list[str]]) -> list[list[str]]:
        """The likeliest language of every word."""
        out = [[""] * len(t) for t in texts]
        for which, place, lengths, p in self.probabilities(texts):
            for i, a, n, best in zip(which, place, lengths, p.argmax(2), strict=True):
                out[i][a : a + n] = [self.field.labels[x] for x in best[:n]]
        return out


def predict(docs: DataFrame, parts: int = 5, held: int = 0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, with the input's `keep` columns after them.

    Learns from rows whose fold is not `held` and whose lang is not null, within the bounds above;
    predictions see the text alone. A null text, one without a letter, and every text if nothing could
    be learned, is `und` with score 0. Ties go to the language first by name. Texts are whole, however
    long: the messages of forward-backward pass through all of a text. Rows repeat as in the input, null
    ids too; an empty table gives no rows; columns not named are not read, so their names may clash.
    """
    held_out = fold(F.col(doc_id), parts) == held
    model = fit(labelled_sample(docs, doc_id, text, lang, ~held_out))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(held_out.alias("held_out"), F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])

    def run(batches):
        labeller = Labeller(*shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            said, scores = ["und"] * len(texts), np.zeros(len(texts))
            held, which, n = [], [], 0

            def label():
                for i, sums, words in zip(which, labeller.sums(held), held, strict=True):
                    best = int(sums.argmax())
                    said[i], scores[i] = labeller.field.labels[best], min(1.0, sums[best] / len(words))

            for i, t in enumerate(texts if labeller else []):
                words = WORD.findall(t.lower()) if t else []
                if any(c.isalpha() for w in words for c in w):
                    held.append(words)
                    which.append(i)
                    n += len(words)
                if n >= AT_ONCE:
                    label()
                    held, which, n = [], [], 0
            if held:
                label()
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(said, pa.string()), pa.array(scores, pa.float64()), *[batch.column(3 + i) for i in range(len(names))]], ["doc_id", "held_out", "lang_pred", "score", *names])

    kinds = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    out = rows.mapInArrow(run, f"doc_id long, held_out boolean, lang_pred string, score double{kinds}")
    return out.select("doc_id", "held_out", "lang_pred", "score", *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)])

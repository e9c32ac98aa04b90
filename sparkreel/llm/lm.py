"""Scores of whole texts under an n-gram model smoothed by deleted interpolation.

The probability of a token mixes four estimates: its frequency after the two tokens before it, after the
one before it, anywhere, and one over the number of types. The first is mixed with the mixture of the
others, each mixture with weights that depend on how often its context was seen. They are learned by
expectation-maximisation on the counts of a deleted part of the training documents, with frequencies
taken from the rest; the final frequencies take in both.

Spark moves n-grams in bulk. Tokens become 64-bit hashes in blocks of documents, stored once. A block
sends each of its distinct n-grams with its count to the shard that owns that range of hashes; shards add up
and answer every block with the totals in the same order; blocks look up the answers and add up their
documents' scores. So an n-gram travels once for each block that has it, at five to eight bytes, however
frequent it is, and no shard, block or driver holds more than its share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.common import mix, slices, stored, utf8_buffers, word_hashes

#: The hash of the token that ends a text and is the context of its first word.
END = np.uint64(0x5D1E7A9C3B804F26)
#: Tokens of a block, hashes of a shard (rough), bytes hashed at once, bits of the hash of a token, a bigram, a trigram.
BLOCK, SHARD, SLICE, BITS = 1 << 20, 2_000_000, 1 << 20, (64, 56, 52)
#: Tokens whose probabilities are worked out at once.
PART = 1 << 18
#: Steps of an octave in which held-out events are told apart, context-frequency buckets, rounds of expectation-maximisation.
STEPS, BUCKETS, ROUNDS = 4, 40, 60
_BLOCKS = "block long, deleted boolean, tokens long, types long, doc_ids array<bigint>, held array<boolean>, lengths array<int>, keys binary, seq binary"
_PIECES = "kind int, shard int, block long, deleted boolean, n long, keys binary, counts binary"
_ANSWERS = "block long, kind int, shard int, deleted boolean, n long, total binary, apart binary, types long, tokens long, tokens_apart long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def packed(x: np.ndarray) -> bytes:
    """Non-negative whole numbers as bytes, split by place value and compressed."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max(1, int(np.flatnonzero(planes.any(1)).max(initial=0)) + 1)
    return bytes([used]) + pa.compress(np.ascontiguousarray(planes[:used]).tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, n: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : b[0]] = np.frombuffer(pa.decompress(b[1:], n * b[0], codec="zstd", asbytes=True), np.uint8).reshape(b[0], n).T
    return planes.view("<u8").reshape(n)


def _ascending(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def _from_ascending(b: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(b, n), dtype=np.uint64)


def ended_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, END after each row's words, and each row's number of tokens."""
    data, at = utf8_buffers(column)
    out, lengths = [], []
    for row, end in slices(at, SLICE):
        hashes, words = word_hashes(data[at[row] : at[end]], at[row : end + 1] - at[row])
        n = np.diff(words)
        tokens = np.full(len(hashes) + end - row, END, np.uint64)
        tokens[np.arange(len(hashes)) + np.repeat(np.arange(end - row), n)] = hashes
        out.append(tokens)
        lengths.append(n + 1)
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([np.zeros(0, np.int64), *lengths])


def _block(number: int, deleted: bool, parts: list) -> pa.RecordBatch:
    tokens, lengths, ids, held = (np.concatenate([p[i] for p in parts]) if i < 2 else sum((p[i] for p in parts), []) for i in range(4))
    keys, seq = np.unique(tokens, return_inverse=True)
    values = [number, deleted, len(tokens), len(keys), ids, held, lengths.tolist(), _ascending(keys), pa.compress(seq.astype("<i4").tobytes(), codec="zstd", asbytes=True)]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])


def _to_blocks(batches):
    """Blocks of about BLOCK tokens from rows of (doc_id, text, held_out, deleted), deleted documents in blocks of their own."""
    waiting: dict[bool, list] = {False: [], True: []}
    filled, made = {False: 0, True: 0}, TaskContext.get().partitionId() << 32
    for batch in batches:
        tokens, lengths = ended_tokens(batch.column(1))
        ids, held, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        start = np.concatenate([[0], np.cumsum(lengths)])
        row = 0
        while row < len(ids):
            end = max(row + 1, int(np.searchsorted(start, start[row] + BLOCK // 4, "right")) - 1)
            for kind in (False, True):
                which = row + np.flatnonzero(flags[row:end] == kind)
                if len(which):
                    of = np.repeat(flags[row:end] == kind, lengths[row:end])
                    waiting[kind].append((tokens[start[row] : start[end]][of], lengths[which], [ids[i] for i in which], [held[i] for i in which]))
                    filled[kind] += int(of.sum())
                if filled[kind] >= BLOCK:
                    yield _block(made, kind, waiting[kind])
                    made, waiting[kind], filled[kind] = made + 1, [], 0
            row = end
    for kind in (False, True):
        if waiting[kind]:
            yield _block(made, kind, waiting[kind])
            made += 1


class Contents:
    """A block opened: its sorted distinct tokens, bigrams and trigrams (keys), and each token's place among them (at).

    A text begins after two END tokens that are no tokens of it. placed: the keys themselves are not kept.
    """

    def __init__(self, row: dict, orders: int = 3, placed: bool = False):
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.held = np.repeat(np.asarray(row["held"], bool), self.lengths)
        tokens = _from_ascending(row["keys"], row["types"])
        seq = np.frombuffer(pa.decompress(row["seq"], 4 * row["tokens"], codec="zstd", asbytes=True), "<i4")
        self.end = int(np.searchsorted(tokens, END))
        self.before = np.concatenate([np.array([self.end], np.int32), seq[:-1]])  # a text's last token is END, the next one's context
        self.first = np.zeros(len(seq), bool)
        self.first[np.cumsum(self.lengths)[:-1]] = True
        self.first[:1] = True
        self.keys, self.at = [tokens], [seq]
        own, last = tokens[seq], tokens[self.before]
        for order in range(1, orders):
            last = mix(last * np.uint64(0xD1342543DE82EF95) + own)
            keys, at = np.unique(last >> np.uint64(64 - BITS[order]), return_inverse=True)
            self.keys.append(None if placed else keys)
            self.at.append(at.astype(np.int32))
            del keys, at
            last[1:] = last[:-1].copy()
            last[self.first] = END

    def parts(self):
        """Slices of about PART tokens."""
        for a in range(0, len(self.before), PART):
            yield slice(a, min(a + PART, len(self.before)))

    def estimates(self, counts: list[np.ndarray], tokens: int, part: slice) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For a slice's tokens and each order (highest first): how often its context was seen, and its frequency there."""
        one, two = counts[0], counts[1]
        seen = [one[self.before[part]]]
        shares = [_ratio(two[self.at[1][part]], seen[0]), one[self.at[0][part]] / max(1, tokens)]
        if len(counts) > 2:
            last = two[self.at[1][np.maximum(np.arange(part.start, part.stop) - 1, 0)]]
            last[self.first[part]] = one[self.end]  # every text begins in the same context
            seen, shares = [last, *seen], [_ratio(counts[2][self.at[2][part]], last), *shares]
        return seen, shares


def _pieces(shards: tuple[int, ...]):
    """What each block sends: for every shard of the hashes of each order its keys there and their training counts."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b, out = Contents(row), []
                for kind, (keys, at, bits) in enumerate(zip(b.keys, b.at, BITS, strict=True)):
                    counts = np.bincount(at[~b.held], minlength=len(keys)).astype(np.uint64)
                    step = -(-(1 << bits) // shards[kind])
                    cuts = [0, *np.searchsorted(keys, np.array([step * i for i in range(1, shards[kind])], np.uint64)).tolist(), len(keys)]
                    for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if i < j:
                            out.append((kind, s, row["block"], row["deleted"], j - i, _ascending(keys[i:j]), packed(counts[i:j])))
                    b.keys[kind] = b.at[kind] = None
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _PIECES.split(", ")])

    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's totals: for every piece its keys' counts in all training documents and in the deleted ones."""
    sizes = pdf["n"].to_numpy()
    keys = np.concatenate([_from_ascending(b, n) for b, n in zip(pdf["keys"], sizes, strict=True)])
    counts = np.concatenate([unpacked(b, n) for b, n in zip(pdf["counts"], sizes, strict=True)]).astype(np.float64)
    own, at = np.unique(keys, return_inverse=True)
    del keys
    total = np.bincount(at, counts, len(own))
    apart = np.bincount(at, counts * np.repeat(pdf["deleted"].to_numpy(), sizes), len(own))
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    each = [(packed(total[x]), packed(apart[x])) for x in (at[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True))]
    out = pdf[["block", "kind", "shard", "deleted", "n"]].assign(total=[t for t, _ in each], apart=[a for _, a in each], types=0, tokens=0, tokens_apart=0)
    first = pdf.iloc[0]
    sums = {"block": -1, "kind": first["kind"], "shard": first["shard"], "deleted": False, "n": 0, "total": b"", "apart": b"", "types": int((total > 0).sum()), "tokens": int(total.sum()), "tokens_apart": int(apart.sum())}
    return pd.concat([out, pd.DataFrame([sums])])[[c.split()[0] for c in _ANSWERS.split(", ")]]


def _answered(block: pd.DataFrame, answers: pd.DataFrame, orders: int = 3, kept: bool = False) -> tuple[Contents, list[np.ndarray]]:
    """A block opened, and the counts of its keys by order; kept: without those in deleted documents."""
    answers = answers.sort_values(["kind", "shard"])

    def read(k: int, c: str) -> np.ndarray:
        own = answers["kind"] == k
        return np.concatenate([unpacked(b, n) for b, n in zip(answers.loc[own, c], answers.loc[own, "n"], strict=True)]).astype(np.float64)

    return Contents(block.iloc[0].to_dict(), orders, placed=True), [read(k, "total") - read(k, "apart") if kept else read(k, "total") for k in range(orders)]


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one for each doubling of its frequency."""
    return np.where(count > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(count, 1)).astype(np.int64)), 0)


def _ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _steps(p: np.ndarray) -> np.ndarray:
    """Probabilities in steps of an octave's STEPS-th part; -1 for none."""
    return np.where(p > 0, np.round(-STEPS * np.log2(np.where(p > 0, p, 1))), -1).astype(np.int64)


def _lower(seen: np.ndarray, shares: list[np.ndarray], weights: np.ndarray, types: int) -> np.ndarray:
    """The mixture of bigram, unigram and uniform estimates."""
    w = weights[bucket(seen)]
    return w[:, 0] * shares[0] + w[:, 1] * shares[1] + w[:, 2] / (types + 1)


def _events(kept_tokens: int, weights: np.ndarray | None = None, types: int = 0):
    """What a deleted block tells of a mixture: events by context bucket and two probabilities in the kept documents.

    Those are the bigram's and the unigram's; with the weights of their mixture the trigram's and that mixture's.
    """

    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(answers):
            return pd.DataFrame({"b": [], "p2": [], "p1": [], "n": []}).astype("int64")
        c, counts = _answered(block, answers, 2 if weights is None else 3, kept=True)
        told = []
        for part in c.parts():
            seen, shares = c.estimates(counts, kept_tokens, part)
            two = shares if weights is None else [shares[0], _lower(seen[1], shares[1:], weights, types)]
            frame = pd.DataFrame({"b": bucket(seen[0]), "p2": _steps(two[0]), "p1": _steps(two[1])})
            told.append(frame[~c.held[part]].groupby(["b", "p2", "p1"]).size().rename("n").reset_index())
        return pd.concat(told).groupby(["b", "p2", "p1"])["n"].sum().reset_index()

    return run


def mixture(events: list, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, estimate) by expectation-maximisation over rows (b, p2, p1, n); a bucket without events takes those of the one below."""
    out = np.tile(np.array([0.3, 0.6, 0.1]), (BUCKETS, 1))
    out[0] = 0, 0.9, 0.1
    rows = np.array([(e["b"], e["p2"], e["p1"], e["n"]) for e in events], np.float64).reshape(-1, 4)
    level = lambda x: np.where(x >= 0, 2.0 ** (-x / STEPS), 0.0)
    p = np.stack([level(rows[:, 1]), level(rows[:, 2]), np.full(len(rows), 1 / (types + 1))], 1)
    for b in range(BUCKETS):
        own = rows[:, 0] == b
        if not own.any():
            out[b] = out[b - 1] if b > 1 else out[b]
            continue
        w = out[b].copy()
        for _ in range(rounds):
            share = p[own] * w
            w = (share / share.sum(1, keepdims=True) * rows[own, 3:]).sum(0) + 1e-3
            w /= w.sum()
        out[b] = w if b else np.array([0, w[0] + w[1], w[2]])
    return out


def upper_mixture(events: list, rounds: int = ROUNDS) -> np.ndarray:
    """The trigram's weight against the mixture below it by context bucket, by expectation-maximisation over rows (b, p2, p1, n); 0 in contexts never seen."""
    out = np.full(BUCKETS, 0.5)
    rows = np.array([(e["b"], e["p2"], e["p1"], e["n"]) for e in events], np.float64).reshape(-1, 4)
    level = lambda x: np.where(x >= 0, 2.0 ** (-x / STEPS), 0.0)
    for b in range(BUCKETS):
        own = rows[rows[:, 0] == b]
        if not len(own):
            out[b] = out[b - 1] if b > 1 else out[b]
            continue
        w, p, q, n = out[b], level(own[:, 1]), level(own[:, 2]), own[:, 3]
        for _ in range(rounds):
            share = w * p / (w * p + (1 - w) * q)
            w = ((share * n).sum() + 1e-3) / (n.sum() + 2e-3)
        out[b] = w
    out[0] = 0
    return out


def _scored(weights: np.ndarray, upper: np.ndarray, tokens: int, types: int):
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({c.split()[0]: [] for c in _SCORES.split(", ")})
        c, counts = _answered(block, answers)
        logs = np.zeros(len(c.before))
        for part in c.parts():
            seen, shares = c.estimates(counts, tokens, part)
            w = upper[bucket(seen[0])]
            logs[part] = np.log10(w * shares[0] + (1 - w) * _lower(seen[1], shares[1:], weights, types))
        own = counts[0][c.at[0]]
        start = np.concatenate([[0], np.cumsum(c.lengths)[:-1]])
        add = lambda x: np.add.reduceat(x, start)
        row = block.iloc[0]
        ids = pd.array([None if x is None or x != x else int(x) for x in row["doc_ids"]], "Int64")
        return pd.DataFrame({
            "doc_id": ids, "held_out": row["held"], "n_tokens": c.lengths, "n_known": add((own > 0).astype(np.int64)), "train_tokens": tokens,
            "base_score": add(np.log10((own + 1) / (tokens + types + 1))), "score": add(logs),
        })

    return run


def score_texts(docs: DataFrame, parts: int = 7, held: int = 2, deleted: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Documents of fold `held` are scored but not learned from; those of fold `deleted` are the part on
    which the mixture's weights are learned. Scores are log10 probabilities of the whole text, its end
    included; a null or empty text is that end alone. Rows repeat as in the input, each counted; a null
    id belongs to the fold of the empty text. An empty table gives no rows. Columns besides the two
    named are not read. Hashes have BITS.
    """
    which = fold(F.col(doc_id), parts)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (which == held).alias("held_out"), (which == deleted).alias("deleted"))
    blocks = stored(rows.mapInArrow(_to_blocks, _BLOCKS))
    tokens, types = (int(x or 0) for x in blocks.agg(F.sum("tokens"), F.sum("types")).first())
    shards = (max(8, -(-types // SHARD)), max(16, -(-tokens // SHARD)), max(16, -(-tokens // SHARD)))
    pieces = blocks.mapInArrow(_pieces(shards), _PIECES)
    answers = stored(pieces.groupBy("kind", "shard").applyInPandas(_add_up, _ANSWERS))
    types, tokens, apart = (int(x or 0) for x in answers.where("block = -1 and kind = 0").agg(F.sum("types"), F.sum("tokens"), F.sum("tokens_apart")).first())
    answers = answers.where("block <> -1").drop("types", "tokens", "tokens_apart")
    some = blocks.where("deleted").groupBy("block")

    def events(told: DataFrame, *also) -> list:
        # at most BUCKETS times the squared number of steps between 1 and 1 / tokens: a bounded table
        found = some.cogroup(told.where("deleted").groupBy("block")).applyInPandas(_events(tokens - apart, *also), "b long, p2 long, p1 long, n long")
        return found.groupBy("b", "p2", "p1").agg(F.sum("n").alias("n")).orderBy("b", "p2", "p1").collect()

    weights = mixture(events(answers.where("kind < 2")), types)
    upper = upper_mixture(events(answers, weights, types))
    told = answers.drop("apart", "deleted")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_scored(weights, upper, tokens, types), _SCORES)

"""Token counts of a sentencepiece BPE model by a two-tier lookup on the map side.

No piece of the model holds a space mark after another character, nor a line feed: merges never
cross the start of a run of spaces or a line feed, so a text's tokens are those of its pre-tokens.
First tier: a table of frequent pre-tokens' lengths, broadcast; second: each worker's cache of what it
had to encode. Which pre-tokens the table holds decides how fast the first texts of a task are, never a
count, so it is taken from a bounded number of texts. Pre-tokens are never shuffled. The texts of a
batch are cut into slices; both tiers are asked once for every distinct pre-token of a slice.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreel.llm.common import slices, utf8_buffers

#: Rows of the broadcast table, texts of a task that it is taken from, and counters held meanwhile.
TABLE, TEXTS, HELD = 16_384, 4_096, 65_536
#: Pre-tokens in a worker's cache before it starts anew; longer ones than LONG are encoded but not kept.
CACHE, LONG = 400_000, 64
#: Bytes of the texts of a slice, and pre-tokens that the library gets at once, longer ones than LONG alone.
SLICE, AT_ONCE = 4_000_000, 4_096
SPACE = "▁"


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of all texts, and each text's offsets into them.

    As sentencepiece sees a text: a leading space, a space mark like a space. A pre-token is a line feed,
    or spaces, if any, and what follows up to the next space or line feed. Empty texts have none.
    """
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), SPACE, " ")
    nothing, mark = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    data, at = utf8_buffers(pc.if_else(pc.equal(texts, nothing), nothing, pc.binary_join_element_wise(nothing, texts, mark)))
    space, line = data == 32, data == 10
    first = line.copy()
    first[1:] |= line[:-1] | space[1:] & ~space[:-1]
    first[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(first)
    buffers = [None, pa.py_buffer(np.append(first, len(data)).astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(first), buffers), np.searchsorted(first, at)


def distinct(tokens: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct pre-tokens, and each one's place among them."""
    coded = tokens.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()


def sliced(texts: pa.Array):
    """Ranges of texts of at most SLICE bytes, or of one text."""
    return slices(np.append(0, np.cumsum(pc.binary_length(texts).fill_null(0).cast(pa.int64()).to_numpy())), SLICE)


class Encoder:
    """Lengths of pre-tokens by the library itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        known = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.splits = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in known) and self.model.encode("\n\n") == self.model.encode("\n")[:1] + 2 * self.model.encode("\n")[1:]
        self.lead = len(self.model.encode("\n"))
        self.space = self.lead - len(self.model.encode("\n\n")) + self.lead

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def __call__(self, tokens: list[str]) -> list[int]:
        """The library puts a space mark before a text: one is taken off, or a line feed shields the rest from it."""
        ids = self.model.encode([t[1:] if t[0] == " " else "\n" + t for t in tokens], num_threads=1)
        return [self.space if t == " " else len(x) if t[0] == " " else len(x) - self.lead for t, x in zip(tokens, ids, strict=True)]


class Lengths(dict):
    """The two tiers: a first table that stays, then what was encoded since."""

    def __init__(self, table: dict[str, int], encoder: Encoder):
        super().__init__(table)
        self.table, self.encoder = table, encoder

    def of(self, tokens: list[str]) -> np.ndarray:
        """Lengths of distinct pre-tokens."""
        found = list(map(self.get, tokens))
        missing = [i for i, n in enumerate(found) if n is None]
        for i in missing:
            if len(tokens[i]) > LONG:
                found[i] = self.encoder([tokens[i]])[0]
        short = [i for i in missing if found[i] is None]
        for at in range(0, len(short), AT_ONCE):
            some = short[at : at + AT_ONCE]
            new = [tokens[i] for i in some]
            if len(self) + len(new) > CACHE + len(self.table):
                self.clear()
                self.update(self.table)
            self.update(zip(new, self.encoder(new), strict=True))
            for i, token in zip(some, new, strict=True):
                found[i] = self[token]
        return np.array(found, np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text."""
        out = np.zeros(len(texts), np.int64)
        for i, j in sliced(texts):
            tokens, own = pre_tokens(texts[i:j])
            names, places = distinct(tokens)
            out[i:j] = np.diff(np.append(0, np.cumsum(self.of(names)[places]))[own])
        return out


def _frequent(batches):
    """The most frequent pre-tokens of a task's first TEXTS texts; rare ones are dropped when too many are held."""
    seen: Counter = Counter()
    texts = 0
    for batch in batches:
        some = batch.column(0)[: max(0, TEXTS - texts)]
        for i, j in sliced(some):
            names, places = distinct(pre_tokens(some[i:j])[0])
            seen.update(dict(zip(names, np.bincount(places).tolist(), strict=True)))
            if len(seen) > 4 * HELD:
                seen = Counter(dict(seen.most_common(HELD)))
        texts += batch.num_rows
    top = [t for t, n in seen.most_common(TABLE) if len(t) <= LONG and n > 1]
    yield pa.RecordBatch.from_arrays([pa.array(top, pa.string())], ["token"])


def frequent_lengths(docs: DataFrame, text: str, path: str) -> dict[str, int]:
    """The broadcast table: at most TABLE pre-tokens of at most LONG characters, with their lengths.

    They are asked of one task, and of more only if those before had too few; nothing is shuffled.
    """
    encoder = Encoder(path)
    some = docs.select(F.col(text).alias("text")).mapInArrow(_frequent, "token string").limit(TABLE) if encoder.splits else None
    top = [r["token"] for r in some.collect()] if some else []
    return dict(zip(top, encoder(top), strict=True))


def token_counts(docs: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, whatever its id; null texts are empty, empty texts have no tokens.

    `path` names the model's file on every machine. Texts are whole, of any length; rows repeat as they
    do in the input; columns besides the two named are not read. A model whose pieces do cross
    pre-tokens is recognised, and its texts are then encoded whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, path))

    def run(batches):
        encoder = Encoder(path)
        lengths = Lengths(shared.value, encoder)
        for batch in batches:
            texts = batch.column(1)
            counts = lengths.counts(texts) if encoder.splits else [encoder.whole(t.as_py() or "") for t in texts]
            sizes = pc.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

"""A linear-chain conditional random field in numpy, over batches of padded sequences.

A position's emission depends on its event (a word, or a token with its neighbours' shapes), so each
distinct event's features are looked up once. Sequences are arrays of event numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


#: Places times labels of the sequences that fit() goes through at once.
CELLS = 4_000_000


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of event numbers, 0 past the end, and the lengths."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    out = np.zeros((len(sequences), int(lengths.max(initial=1))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = np.concatenate(sequences) if len(sequences) else 0
    return out, lengths


def ragged_sums(weights: np.ndarray, rows: list[list[int]]) -> np.ndarray:
    """For each row of numbers the sum of those rows of weights."""
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum()))
    sums = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[flat], 0)])
    end = np.cumsum(sizes)
    return sums[end] - sums[end - sizes]


@dataclass
class Field:
    labels: list[str]
    features: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def emissions(self, events: list[list[str]]) -> np.ndarray:
        get = self.features.get
        return ragged_sums(self.weights, [[i for f in e if (i := get(f)) is not None] for e in events])

    def fit(self, events: list[list[str]], sequences: list[np.ndarray], answers: list[np.ndarray], rounds: int = 60, least: int = 2, decay: float = 1e-4, rate: float = 0.15) -> "Field":
        """Maximum likelihood with weight decay, by Adam over the whole sample; the same sample gives the same weights."""
        seen: dict[str, int] = {}
        for e in events:
            for f in e:
                seen[f] = seen.get(f, 0) + 1
        self.features = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
        rows = [[i for f in e if (i := self.features.get(f)) is not None] for e in events]
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum()))
        n, k = len(self.features), len(self.labels)
        x, lengths = padded(sequences)
        y, _ = padded(answers)
        valid = np.arange(x.shape[1])[None, :] < lengths[:, None]
        total = max(1, int(lengths.sum()))
        truth = np.bincount(x[valid] * k + y[valid], minlength=len(events) * k).reshape(-1, k)
        some = max(1, CELLS // (x.shape[1] * k))
        both = valid[:, 1:]
        true_moves = np.zeros((k, k))
        np.add.at(true_moves, (y[:, :-1][both], y[:, 1:][both]), 1)
        true_first = np.bincount(y[lengths > 0, 0], minlength=k)
        params = [np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            self.weights, self.moves, self.first = params
            scores = ragged_sums(self.weights, rows)
            guess, moved, first = np.zeros((len(events), k)), np.zeros((k, k)), np.zeros(k)
            for a in range(0, len(x), some):
                part, ok = x[a : a + some], valid[a : a + some]
                marginals, moves = self.marginals(scores[part], lengths[a : a + some], with_moves=True)
                guess += np.stack([np.bincount(part[ok], marginals[ok][:, c], minlength=len(events)) for c in range(k)], 1)
                moved += moves
                first += marginals[lengths[a : a + some] > 0, 0].sum(0)
            gap = np.repeat(truth - guess, sizes, 0)
            slope = [np.stack([np.bincount(flat, gap[:, c], minlength=n) for c in range(k)], 1), true_moves - moved, true_first - first]
            for i, (p, g) in enumerate(zip(params, slope, strict=True)):
                g = g / total * 100 - decay * p
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                params[i] = p + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves, self.first = params
        return self

    def _potentials(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.exp(scores - scores.max(2, keepdims=True)), np.exp(self.moves - self.moves.max()), np.exp(self.first - self.first.max())

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, with_moves: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
        """Forward-backward: label probabilities (sequence, position, label), and the expected moves if asked for.

        before, after: for sequences that are parts of longer ones, the messages (sequence, label) that
        enter at the first position and at the last one.
        """
        n, most, k = scores.shape
        p, t, start = self._potentials(scores)
        ahead, back, scale = np.zeros_like(p), np.ones_like(p), np.ones((n, most))
        if after is not None:
            back[:] = after[:, None]
        a = p[:, 0] * (start if before is None else before)
        for i in range(most):
            if i:
                a = (a @ t) * p[:, i]
            scale[:, i] = a.sum(1)
            a = a / scale[:, i][:, None]
            ahead[:, i] = a
        for i in range(most - 2, -1, -1):
            b = ((p[:, i + 1] * back[:, i + 1]) @ t.T) / scale[:, i + 1][:, None]
            back[:, i] = np.where((i + 1 < lengths)[:, None], b, back[:, i])
        out = ahead * back
        out /= out.sum(2, keepdims=True)
        if not with_moves:
            return out
        moved = np.zeros((k, k))
        for i in range(most - 1):
            on = i + 1 < lengths
            moved += t * (ahead[on, i].T @ (p[on, i + 1] * back[on, i + 1] / scale[on, i + 1][:, None]))
        return out, moved

    def transfers(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(sequence, label, label): what each sequence does to a message that enters it, up to a factor."""
        p, t, _ = self._potentials(scores)
        out = p[:, 0, :, None] * np.eye(p.shape[2])
        for i in range(1, p.shape[1]):
            new = (out @ t) * p[:, i, None, :]
            out = np.where((i < lengths)[:, None, None], new / new.max((1, 2), keepdims=True), out)
        return out

    def messages(self, transfers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the parts of one sequence the messages that enter each at its first and at its last position."""
        t, m = np.exp(self.moves - self.moves.max()), len(transfers)
        before, after = np.ones((2, m, transfers.shape[1]))
        before[0] = np.exp(self.first - self.first.max())
        for i in range(1, m):
            a = (before[i - 1] @ transfers[i - 1]) @ t
            before[i] = a / a.sum()
        for i in range(m - 2, -1, -1):
            b = t @ (transfers[i + 1] @ after[i + 1])
            after[i] = b / b.sum()
        return before, after

    def carried(self, scores: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
        """(sequence, label): what the messages that enter each sequence become for the first position behind it."""
        p, t, _ = self._potentials(scores)
        a = p[:, 0] * before
        a /= a.sum(1, keepdims=True)
        for i in range(1, p.shape[1]):
            new = (a @ t) * p[:, i]
            a = np.where((i < lengths)[:, None], new / new.sum(1, keepdims=True), a)
        a = a @ t
        return a / a.sum(1, keepdims=True)

    def brought(self, scores: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> np.ndarray:
        """(sequence, label): what the messages that enter each sequence at its end become for the last position before it."""
        p, t, _ = self._potentials(scores)
        b = after / after.sum(1, keepdims=True)
        for i in range(p.shape[1] - 1, -1, -1):
            new = (p[:, i] * b) @ t.T
            b = np.where((i < lengths)[:, None], new / new.sum(1, keepdims=True), b)
        return b

    def best(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi: the likeliest labels (sequence, position); past a sequence's end they mean nothing. Ties go to the earlier label."""
        n, most, k = scores.shape
        came = np.zeros((n, most, k), np.int64)
        a = scores[:, 0] + self.first
        for i in range(1, most):
            through = a[:, :, None] + self.moves[None]
            came[:, i] = through.argmax(1)
            a = np.where((i < lengths)[:, None], through.max(1) + scores[:, i], a)
        out = np.zeros((n, most), np.int64)
        label = a.argmax(1)
        for i in range(most - 1, -1, -1):
            out[:, i] = label
            label = np.where((0 < i) & (i < lengths), came[np.arange(n), i, label], label)
        return out

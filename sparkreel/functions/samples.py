"""Numbers drawn by rule, the same for everyone, and maps from many samples at once. Helpers of operators.homography."""

from __future__ import annotations

import numpy as np

#: Fixed: shifts and factor of the generator, and the seed of samples.
SHIFTS, FACTOR, SEED = (12, 25, 27), 0x2545F4914F6CDD1D, 0x4D584D
_ALL = (1 << 64) - 1
#: Twice the area of three points from which on they are not in line, at a mean distance of the root of 2 from their middle.
LINE = 1e-9


def drawn(seed: int):
    """Whole numbers of 64 bits without end: a state shifted into itself three times, times the factor."""
    state = max(1, seed)
    while True:
        state ^= state >> SHIFTS[0]
        state = (state ^ state << SHIFTS[1]) & _ALL
        state ^= state >> SHIFTS[2]
        yield state * FACTOR & _ALL


def fours(n: int, rounds: int, seed: int = SEED) -> np.ndarray:
    """(rounds, 4): places below n, four different ones a round, in the order drawn."""
    numbers, out = drawn(seed), np.zeros((rounds, 4), np.int64)
    for r in range(rounds):
        four: list[int] = []
        while len(four) < 4:
            at = next(numbers) % n
            if at not in four:
                four.append(at)
        out[r] = four
    return out


def smallest(sums: np.ndarray) -> np.ndarray:
    """(…, 9): the eigenvector of the smallest eigenvalue of symmetric 9 x 9 matrices."""
    return np.linalg.eigh(sums)[1][..., :, 0]


def _normalised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (m, k, 2) around 0 at the mean distance of the root of 2, and the maps that put them there."""
    centre = p.mean(1)
    away = np.sqrt(((p - centre[:, None]) ** 2).sum(2)).mean(1)
    s = np.where(away > 1e-12, np.sqrt(2) / np.where(away > 1e-12, away, 1), 1.0)
    t = np.zeros((len(p), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = s
    t[:, :2, 2] = -s[:, None] * centre
    t[:, 2, 2] = 1
    return (p - centre[:, None]) * s[:, None, None], t


def maps(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """(m, 3, 3): the projective maps from src to dst, each (m, k, 2)."""
    (a, ta), (b, tb) = _normalised(src), _normalised(dst)
    x, y, u, v = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    one, none = np.ones_like(x), np.zeros_like(x)
    rows = np.concatenate([np.stack([-x, -y, -one, none, none, none, u * x, u * y, u], 2), np.stack([none, none, none, -x, -y, -one, v * x, v * y, v], 2)], 1)
    h = smallest(rows.transpose(0, 2, 1) @ rows).reshape(-1, 3, 3)
    h = np.linalg.inv(tb) @ h @ ta
    last = h[:, 2, 2][:, None, None]
    return h / np.where(np.abs(last) < 1e-12, 1, last)


def through(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(m, 3, 3): the maps that put four points (m, 4, 2) exactly on four others; (m,): where there is just one, no three points being in line.

    Points should lie around 0 at a distance of about 1.
    """
    whole = lambda p: np.concatenate([p, np.ones((*p.shape[:2], 1))], 2)
    a, b = whole(src), whole(dst)
    turn = lambda p, q: np.stack([p[:, 1] - q[:, 1], q[:, 0] - p[:, 0], p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]], 1)
    turns = lambda p: np.stack([turn(p[:, 1], p[:, 2]), turn(p[:, 2], p[:, 0]), turn(p[:, 0], p[:, 1])], 1)
    ca, cb = turns(a), turns(b)
    # the fourth point as a sum of the other three, times their determinant
    wa, wb = (ca * a[:, 3:]).sum(2), (cb * b[:, 3:]).sum(2)
    bent = np.minimum(np.abs(wa).min(1), np.abs(wb).min(1))
    only = np.minimum(bent, np.minimum(np.abs((a[:, 0] * ca[:, 0]).sum(1)), np.abs((b[:, 0] * cb[:, 0]).sum(1)))) > LINE
    share = wb / np.where(only[:, None], wa, 1)
    return (b[:, :3] * share[:, :, None]).transpose(0, 2, 1) @ ca, only


def best(src: np.ndarray, dst: np.ndarray, drawn: np.ndarray, limit: float, close: float, chunk: int) -> tuple[np.ndarray, int] | None:
    """(9,): the map that puts points closest among those through each row of four places, fitted anew to the points within limit, and their number.

    Closest is the least sum of distances, those beyond the limit counting as the limit: by number alone a bent map
    that just takes some points of a wrong marker in would win over the true one. The first such map counts; a mean
    distance below the share `close` of the limit ends the search. Fours with three points in line have no map of
    their own. None if the map has less than four points within limit.
    """
    if len(src) == 4:
        return maps(src[None], dst[None]).reshape(9), 4
    (a, _), (b, t) = _normalised(src[None]), _normalised(dst[None])
    a, b, reach, least, kept = a[0], b[0], limit * t[0, 0, 0], np.inf, np.zeros(len(src), bool)
    with np.errstate(all="ignore"):
        for i in range(0, len(drawn), chunk):
            h, only = through(a[drawn[i : i + chunk]], b[drawn[i : i + chunk]])
            far = np.sqrt(away(h, a, b)) / reach
            far = np.where((far < 1) & only[:, None], far, 1.0)
            sums = far.sum(1)
            one = int(sums.argmin())
            if sums[one] < least:
                least, kept = sums[one], far[one] < 1
            if least < close * len(a):
                break
    return (maps(src[None, kept], dst[None, kept]).reshape(9), int(kept.sum())) if kept.sum() >= 4 else None


def away(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """(m, n): the squared distance from where n points belong to where each of m maps puts them."""
    p = h @ np.concatenate([src, np.ones((len(src), 1))], 1).T
    d = np.where(np.abs(p[:, 2]) < 1e-12, 1e-12, p[:, 2])
    return (p[:, 0] / d - dst[:, 0]) ** 2 + (p[:, 1] / d - dst[:, 1]) ** 2


def near(h: np.ndarray, src: np.ndarray, dst: np.ndarray, limit: float) -> np.ndarray:
    """(m, n): which of n points each of m maps puts less than limit from where they belong."""
    return away(h, src, dst) < limit * limit

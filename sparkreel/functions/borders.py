"""Borders of one raster: walking round what is on, and closed lines with fewer points. Helpers of operators.contours."""

from __future__ import annotations

import numpy as np

#: The eight neighbours clockwise from the left.
AROUND = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def borders(on: np.ndarray) -> list[list[tuple[int, int]]]:
    """Every border of at least four places, as (x, y) in the order walked.

    A walk begins at each place, in page order, that is on, not yet walked and has nothing on its left. It turns
    clockwise from where it came from and ends at its beginning, alone, or after twice the raster's girth.
    """
    h, w = on.shape
    wide = np.zeros((h + 2, w + 2), bool)
    wide[1:-1, 1:-1] = on
    is_on = wide.tolist()
    walked = np.zeros((h + 2, w + 2), bool)
    out = []
    for y, x in np.argwhere(wide[1:-1, 1:-1] & ~wide[1:-1, :-2]).tolist():
        if walked[y + 1, x + 1]:
            continue
        place, came, line = (x, y), 0, []
        while True:
            walked[place[1] + 1, place[0] + 1] = True
            line.append(place)
            for k in range(1, 9):
                turn = (came + k) % 8
                nx, ny = place[0] + AROUND[turn][0], place[1] + AROUND[turn][1]
                if is_on[ny + 1][nx + 1]:
                    place, came = (nx, ny), (turn + 4) % 8
                    break
            else:
                break
            if place == (x, y) and len(line) > 2 or len(line) > 4 * (w + h):
                break
        if len(line) >= 4:
            out.append(line)
    return out


def _bends(p: np.ndarray, most: float) -> list[int]:
    """Places of an open line that stay: its ends, and, part by part, the farthest place from the line between two ends if it is farther than `most`."""
    keep, parts = {0, len(p) - 1}, [(0, len(p) - 1)]
    while parts:
        a, b = parts.pop()
        if b - a < 2:
            continue
        along = p[b] - p[a]
        inner = p[a + 1 : b] - p[a]
        off = np.abs(inner[:, 0] * along[1] - inner[:, 1] * along[0]) / max(np.hypot(*along), 1e-9)
        k = int(off.argmax())
        if off[k] > most:
            at = a + 1 + k
            keep.add(at)
            parts += [(a, at), (at, b)]
    return sorted(keep)


def simplified(line: list[tuple[int, int]], most: float) -> list[tuple[int, int]]:
    """A closed line's corners: cut at two far places (the farthest from its first, and the farthest from that), each half simplified."""
    if len(line) < 3:
        return line
    p = np.array(line, np.float64)
    far = int(((p - p[0]) ** 2).sum(1).argmax())
    other = int(((p - p[far]) ** 2).sum(1).argmax())
    a, b = sorted((far, other))
    one, two = p[a : b + 1], np.concatenate([p[b:], p[: a + 1]])
    return [tuple(map(int, q)) for half in (one, two) for q in half[_bends(half, most)][:-1]]

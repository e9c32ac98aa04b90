"""Parts and contours of rasters against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from sparkreel.functions import borders
from sparkreel.operators import components, contours


def pixels(spark, images):
    rows = [(i, x, y, int(m[y, x])) for i, m in images.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "img long, x long, y long, gray long")


def flooded(m):
    """Sizes and boxes of 8-connected parts by flooding."""
    seen, out = set(), []
    for y, x in np.argwhere(m).tolist():
        if (y, x) in seen:
            continue
        stack, part = [(y, x)], []
        seen.add((y, x))
        while stack:
            a, b = stack.pop()
            part.append((a, b))
            for p in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= p[0] < m.shape[0] and 0 <= p[1] < m.shape[1] and m[p] and p not in seen:
                    seen.add(p)
                    stack.append(p)
        ys, xs = zip(*part, strict=True)
        out.append((min(part), min(xs), min(ys), max(xs), max(ys), len(part)))
    return sorted(out)


def test_parts_of_rasters(spark):
    rng = np.random.default_rng(1)
    spiral = np.zeros((23, 23), int)
    for k in range(0, 11, 2):  # one long winding part
        spiral[k, k : 23 - k] = spiral[k : 23 - k, 22 - k] = spiral[22 - k, k + 2 : 23 - k] = spiral[k + 2 : 23 - k, k + 0] = 1
    images = {1: (rng.random((12, 15)) < 0.35).astype(int), 2: np.zeros((4, 4), int), 3: np.ones((3, 5), int), 4: spiral, 5: np.eye(9, dtype=int)}
    got = {}
    for r in components.raster_components(pixels(spark, images), F.col("gray") > 0).collect():
        got.setdefault(r["img"], []).append(((r["component"]["y"], r["component"]["x"]), r["x1"], r["y1"], r["x2"], r["y2"], r["pixels"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, m in images.items() if (w := flooded(m))}


def test_connected_of_a_long_chain(spark):
    n = 700
    edges = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(50)]
    random.Random(2).shuffle(edges)
    nodes = spark.createDataFrame([(i,) for i in [*range(n + 1), *range(1000, 1050), 5000]], "id long")
    got = {r["id"]: r["label"] for r in components.connected(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), **dict.fromkeys(range(1000, 1050), 1000), 5000: 5000}


def test_borders_and_corners():
    m = np.zeros((20, 24), bool)
    m[3:12, 4:19] = True
    (line,) = borders.borders(m)
    assert line[0] == (4, 3) and len(line) == 2 * (15 + 9) - 4 and set(line) == {(x, y) for y in range(3, 12) for x in range(4, 19) if x in (4, 18) or y in (3, 11)}
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(line, [*line[1:], line[0]], strict=True))
    assert sorted(borders.simplified(line, 1.0)) == [(4, 3), (4, 11), (18, 3), (18, 11)]
    m[5:9, 8:14] = False  # a hole has a border of its own
    assert len(borders.borders(m)) == 2
    assert borders.borders(np.zeros((5, 5), bool)) == [] and borders.borders(np.eye(3, dtype=bool)[:1]) == []
    tilted = np.array([[abs(x - 20) + abs(y - 20) <= 15 for x in range(41)] for y in range(41)])
    (line,) = borders.borders(tilted)
    corners = borders.simplified(line, 1.5)
    assert sorted(corners) == [(5, 20), (20, 5), (20, 35), (35, 20)]


def plain_bends(points, most):
    """Douglas-Peucker by recursion."""
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]
    length = max(((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5, 1e-9)
    off = [abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / length for x, y in points[1:-1]]
    k = off.index(max(off)) + 1
    return plain_bends(points[: k + 1], most)[:-1] + plain_bends(points[k:], most) if max(off) > most else [points[0], points[-1]]


def test_bends_against_recursion():
    r = random.Random(7)
    for _ in range(200):
        line = [(r.randrange(40), r.randrange(40)) for _ in range(r.randrange(3, 30))]
        p = np.array(line, float)
        for most in (0.5, 2.0, 9.0):
            assert [line[i] for i in borders._bends(p, most)] == plain_bends(line, most)


def test_quadrilaterals(spark):
    m = np.zeros((30, 30), int)
    m[4:14, 5:17] = 1
    m[20:22, 20:22] = 1
    m[18:28, 3:6] = m[25:28, 3:15] = 1  # an L
    found = contours.contours(contours.packed_rows(pixels(spark, {7: m, 8: m * 0}), F.col("gray") > 0, 30, 30), 1.0)
    assert found.count() == 3
    (quad,) = contours.quadrilaterals(found, 50.0).collect()
    assert (quad["img"], quad["area"]) == (7, 11.0 * 9.0) and len(quad["line"]) == 2 * (12 + 10) - 4

"""Whole scans: maps, sheets and frames, with scans that lack markers, vote for no sheet, or show a frame's edge only."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from sparkreel.functions import samples
from sparkreel.operators import recovery, scans


def corners(x1, y1, x2, y2):
    return [{"x": float(x), "y": float(y)} for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]


def test_scans_from_markers_to_frames(spark):
    boxes = [(i, 40 * (i % 2), 40 * (i // 2), 40 * (i % 2) + 10, 40 * (i // 2) + 10) for i in range(4)]
    sheets = [(1, [0, 2, 4, 6]), (2, [1, 3, 5, 7])]
    turn = lambda x, y: (30 + 2 * x - 0.5 * y, 10 + 0.5 * x + 2 * y)

    def seen(scan, markers):
        return [(scan, m, [dict(zip("xy", map(float, turn(c["x"], c["y"])), strict=True)) for c in corners(*boxes[m // 2][1:])]) for m in markers]

    rows = seen(1, [0, 2, 4, 6]) + seen(2, [1, 3, 4, 7]) + seen(3, [0, 2, 5, 7]) + [(4, 99, corners(0, 0, 1, 1))]
    found = spark.createDataFrame(rows, "scan long, marker long, corners array<struct<x: double, y: double>>")
    s, b = spark.createDataFrame(sheets, "sheet long, ids array<long>"), spark.createDataFrame(boxes, "place long, x1 long, y1 long, x2 long, y2 long")
    maps = scans.scan_maps(found, s, b)
    report = scans.scan_report(found, s, maps)
    got = {r["scan"]: (r["markers"], r["inliers"], r["sheet"], r["error"]) for r in report.collect()}
    assert got == {1: (4, 16, 1, None), 2: (4, 16, 2, None), 3: (4, 16, None, "no sheet has most of the markers"), 4: (1, 0, None, "too few markers in place")}
    frames = spark.createDataFrame([(1, "in", 12, 12, 36, 28, 6, 4), (1, "edge", -30, 0, -10, 8, 2, 2)], "sheet long, label string, x1 long, y1 long, x2 long, y2 long, w int, h int")
    px = spark.createDataFrame([(k, x, y, x + 3 * y) for k in (1, 2) for x in range(130) for y in range(120)], "scan long, x long, y long, gray long")
    cut = {(r["label"], r["x"], r["y"]): r["gray"] for r in scans.cut_out(report, maps, frames, px).collect()}
    for x in range(6):
        for y in range(4):
            u, v = turn(12 + (x + 0.5) * 4 - 0.5, 12 + (y + 0.5) * 4 - 0.5)
            assert cut["in", x, y] == math.floor(round(u + 3 * v, 4) + 0.5)
    assert cut["edge", 0, 0] == 255 and len(cut) == 28  # left of the scan there is paper


def test_lost_markers_need_others(spark):
    expected = spark.createDataFrame([(s, m, 0, 0, 6, 6) for s in (1, 2) for m in range(5)], "scan long, marker long, x1 long, y1 long, x2 long, y2 long")
    found = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (1, 2), (2, 0), (2, 1), (2, 1)], "scan long, marker long")
    maps = spark.createDataFrame([(s, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for s in (1, 2)], "scan long, h array<double>")
    assert sorted((r["scan"], r["marker"]) for r in recovery.lost(expected, found, maps).collect()) == [(1, 3), (1, 4)]


def test_cells_and_codes_of_a_marker(spark):
    code = 0b1010_0110_1100_0001
    gray = lambda x, y, k: 20 if not (1 <= x // 4 <= 4 and 1 <= y // 4 <= 4) or not code >> (4 * (y // 4 - 1) + x // 4 - 1) & 1 ^ (k == 1 and x // 4 == 2 and y // 4 == 2) else 200
    px = spark.createDataFrame([(k, x, y, 120 if k == 2 else gray(x, y, k)) for k in range(3) for x in range(24) for y in range(24)], "scan long, x long, y long, gray long")
    quads = spark.createDataFrame([(k, 5, 0, 0, 24, 24, [1.0, 0.0, -0.5, 0.0, 1.0, -0.5, 0.0, 0.0, 1.0]) for k in range(3)], "scan long, marker long, x1 long, y1 long, x2 long, y2 long, h array<double>")
    cells = recovery.sampled_cells(quads, px, 6, 4, [(0, 0), (2, 0), (90, 90)])
    assert {r["shift"] for r in cells.where(F.col("scan") == 0).select("shift").distinct().collect()} == {0, 1}  # outside there is nothing
    book = spark.createDataFrame([(5, code)], "marker long, code long")
    assert sorted(tuple(r) for r in recovery.recovered(cells, book, 4, 1, 0.2).collect()) == [(0, 5, 0, 0), (1, 5, 0, 1)]
    assert [r["scan"] for r in recovery.recovered(cells, book, 4, 0, 0.2).collect()] == [0]


def test_every_detection_counts(spark):
    """A marker seen twice is two detections, as in the SQL of scan_reports: in number, in corners and as votes."""
    boxes = [(i, 40 * (i % 2), 40 * (i // 2), 40 * (i % 2) + 10, 40 * (i // 2) + 10) for i in range(4)]
    rows = [(scan, m, corners(*boxes[m // 2][1:])) for scan, seen in ((1, [0, 2, 5, 7, 7]), (2, [0, 2, 5, 7])) for m in seen]
    found = spark.createDataFrame(rows, "scan long, marker long, corners array<struct<x: double, y: double>>")
    s, b = spark.createDataFrame([(1, [0, 2, 4, 6]), (2, [1, 3, 5, 7])], "sheet long, ids array<long>"), spark.createDataFrame(boxes, "place long, x1 long, y1 long, x2 long, y2 long")
    got = {r["scan"]: (r["markers"], r["inliers"], r["sheet"], r["error"]) for r in scans.scan_report(found, s, scans.scan_maps(found, s, b)).collect()}
    assert got == {1: (5, 20, 2, None), 2: (4, 16, None, "no sheet has most of the markers")}


def test_points_in_line_have_no_map_of_their_own():
    src = np.array([[0, 0], [10, 0], [30, 0], [0, 20], [25, 15], [7, 30]], float)
    want = np.array([[1.5, 0.2, 5], [-0.1, 1.4, 4], [1e-3, -2e-3, 1]])
    dst = np.concatenate([src, np.ones((6, 1))], 1) @ want.T
    dst = dst[:, :2] / dst[:, 2:]
    h, only = samples.through(src[[[0, 1, 2, 3], [3, 2, 1, 0], [0, 1, 3, 4], [5, 4, 2, 0], [1, 1, 3, 4]]] / 15, dst[[[0, 1, 2, 3], [3, 2, 1, 0], [0, 1, 3, 4], [5, 4, 2, 0], [1, 1, 3, 4]]] / 20)
    assert only.tolist() == [False, False, True, True, False]
    assert samples.near(h[2:4], src / 15, dst / 20, 1e-9).all()
    dst[5] += 50
    best, inside = samples.best(src, dst, np.array([[0, 1, 2, 3], [0, 1, 4, 5], [0, 1, 3, 4]]), 3.0, 0.01, 2)
    assert inside == 5 and np.abs(best - want.ravel()).max() < 1e-6
    assert samples.best(src, dst, np.array([[0, 1, 2, 3]]), 3.0, 0.01, 2) is None


def test_pixels_of_scans_do_not_go_through_the_driver(spark):
    """Many pixels made of few rows look small to the planner; the join with them must not be a broadcast."""
    px = spark.range(2).select(F.col("id").alias("scan"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("x")).withColumn("y", F.col("x")).withColumn("gray", F.col("x"))
    report = spark.createDataFrame([(1, 1, None)], "scan long, sheet long, error string")
    maps = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "scan long, h array<double>")
    frames = spark.createDataFrame([(1, "a", 0, 0, 4, 4, 4, 4)], "sheet long, label string, x1 long, y1 long, x2 long, y2 long, w int, h int")
    cut = scans.cut_out(report, maps, frames, px)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[scan#\d+L, sx#\d+L, sy#\d+L\]", plan)
    assert {(r["x"], r["y"]): r["gray"] for r in cut.collect()} == {(x, y): x if x == y else 255 for x in range(4) for y in range(4)}


def test_cells_are_sampled_on_all_tasks(spark):
    """Few lost markers have many points, and many pixels made of few rows look small to the planner: both are dealt out, none is a broadcast."""
    line = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")))
    px = spark.range(3).select(F.col("id").alias("scan"), line.alias("x")).withColumn("y", line).withColumn("gray", F.col("x") + F.col("y"))
    quads = spark.createDataFrame([(k, 5, 0, 0, 24, 24, [1.0, 0.0, -0.5, 0.0, 1.0, -0.5, 0.0, 0.0, 1.0]) for k in range(3)], "scan long, marker long, x1 long, y1 long, x2 long, y2 long, h array<double>")
    cells = recovery.sampled_cells(quads, px, 6, 4, [(0, 0)])
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[scan#\d+L, x#\d+L, y#\d+L\]", plan) and "REPARTITION_BY_NUM" in plan
    got = {(r["scan"], r["cell"]): r["mean"] for r in cells.collect()}
    assert len(got) == 3 * 36 and all(abs(m - (4 * (c % 6) + 4 * (c // 6) + 3)) < 1e-6 for (_, c), m in got.items())


def test_a_bent_map_does_not_take_corners_of_wrong_markers_in():
    """Six markers, one of them seen 40 pixels off: a bent map has 22 of 24 corners within the limit, the true one 20."""
    for places, wrong in (((0, 2, 4, 6, 7, 8), {0: 40}), ((1, 2, 5, 7, 8, 9), {2: 66, 8: 79, 9: 53}), ((0, 4, 6, 7, 9), {0: 40, 6: 53, 9: 92})):
        src = np.array([[30 * p + dx, p * p % 7 * 10 + dy] for p in places for dx, dy in ((0, 0), (8, 0), (8, 8), (0, 8))], float)
        off = np.array([float(wrong.get(p, 0)) for p in places for _ in range(4)])
        h, inside = samples.best(src, src * 1.5 + [5, 4] + np.stack([off, 0 * off], 1), samples.fours(len(src), 2000), 3.0, 0.01, 250)
        assert inside == (off == 0).sum() and np.abs(h - [1.5, 0, 5, 0, 1.5, 4, 0, 0, 1]).max() < 1e-6

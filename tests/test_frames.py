"""Deep frames, held folders, conforming and decoding in one pass, at their edges."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkreel.operators import deep, readers


def test_planes_that_do_not_fit(spark):
    frame = spark.createDataFrame([(1, b"\1\2\3\4\5\6\7\10")], "img long, data binary")
    assert sorted(tuple(r) for r in deep.plane(frame, 2, 2, F.lit(0), F.lit(4), "v").collect()) == [(1, 0, 0, 0x0201), (1, 0, 1, 0x0605), (1, 1, 0, 0x0403), (1, 1, 1, 0x0807)]
    for offset, stride, said in ((1, 4, "behind the frame"), (0, 3, "shorter than its row")):
        with pytest.raises(Exception, match=said):
            deep.plane(frame, 2, 2, F.lit(offset), F.lit(stride), "v").collect()
    with pytest.raises(Exception, match="no turn of 45"):
        deep.turned(spark.createDataFrame([(1, 0, 0)], "img long, x long, y long"), 2, 2, F.lit(45)).collect()


@pytest.mark.parametrize("matrix", deep.WEIGHTS)
def test_gray_stays_gray_and_codes_are_cut(spark, matrix):
    luma = spark.createDataFrame([(1, x, 0, v) for x, v in enumerate((64, 940, 502, 0, 9999))], "img long, x long, y long, luma long")
    chroma = spark.createDataFrame([(1, x, 0, 512, 512) for x in range(3)], "img long, x long, y long, u long, v long")
    got = {r["x"]: (r["r"], r["g"], r["b"]) for r in deep.rgb16(luma, chroma, 5, 1, "I420", 10, matrix, False).collect()}
    assert got == {0: (0, 0, 0), 1: (65535,) * 3, 2: (32768,) * 3, 3: (0, 0, 0), 4: (65535,) * 3}


def test_folders_wait_for_their_readers(spark):
    r, start = random.Random(3), datetime(2024, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    for case in range(3):
        clears = [(c, at(t)) for c in "ab" for t in sorted(r.sample(range(100), 6))]
        holds = [(r.choice("ab"), at(s := r.randrange(100)), r.choice([None, at(s + 1 + r.randrange(60)), at(s + 1 + r.randrange(60))]) if case else at(s + r.randrange(1, 60)), r.choice([None, at(s + r.randrange(1, 30))])) for _ in range(12)]
        want = {}
        for c in "ab":
            times = [t for k, t in clears if k == c]
            for g, t in enumerate(times):
                until, ever = t, False
                for k, s, e, n in holds:
                    if k != c or s > t:
                        continue
                    gen = sum(x < s for x in times)
                    gone = e if gen == g else min([x for x in (e, n) if x is not None], default=None)
                    ever, until = ever or gone is None, max(until, gone or until)
                want[c, g] = None if ever else until
        got = readers.deletions(spark.createDataFrame(clears, "cache string, at timestamp"), spark.createDataFrame(holds, "cache string, start timestamp, end timestamp, narrowed timestamp"), "cache").collect()
        assert {(x["cache"], x["generation"]): x["deleted"] for x in got} == want


def test_plan_of_a_mixed_sequence(spark):
    deep_png, small, tiff = "deep png", "8 bits", "deep tiff"
    infos = spark.createDataFrame([(deep_png, 320, 180, True, False, True, 2), (small, 322, 179, False, False, True, 2), (tiff, 320, 180, True, False, False, 0)], "content string, w int, h int, sixteen boolean, alpha boolean, png boolean, colour int")
    plan, verdicts = readers.conform_plan(spark.createDataFrame([("s", i, c) for i, c in enumerate([deep_png, small, deep_png, tiff, small])], "grp string, pos int, content string"), infos, "grp", "content")
    assert plan.first().asDict() == {"grp": "s", "w": 320, "h": 180, "sixteen": True, "alpha": False, "frames": 5, "unique": 3, "passthrough": 1, "conform": 2, "resized": 0}
    assert [v["verdict"] for v in verdicts.orderBy("pos").collect()] == ["copy", "centre", "copy", "centre", "centre"]


def test_decoding_in_one_pass_of_a_hot_file(spark):
    r = random.Random(8)
    frames = [("hot", t, t * 10) for t in sorted(r.sample(range(5000), 900))] + [("few", t, t) for t in (5, 50)] + [("unasked", 1, 1)]
    asks = [("hot", i, r.randrange(-20, 5200)) for i in range(4000)] + [("few", i, t) for i, t in enumerate((0, 5, 49, 50, 99))] + [("no frames", 0, 7)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = readers.in_one_pass(spark.createDataFrame(asks, "file string, ordinal long, at long").repartition(5), spark.createDataFrame(frames, "file string, at long, content long").repartition(3), "file", "at", "content").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    times = {f: [t for g, t, _ in frames if g == f] for f in ("hot", "few", "no frames")}
    of = {(f, t): c for f, t, c in frames}
    want = sorted((f, o, t, of[f, times[f][k - 1]] if (k := bisect.bisect_right(times[f], t)) else None) for f, o, t in asks)
    assert sorted(tuple(x) for x in got) == want

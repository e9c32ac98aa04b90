"""Ink ramps: rows by parts between stops against a plain version, and few rows that become many on all tasks."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from sparkreel.operators import tone
from sparkreel.plans import registry


def plain(stops, ink):
    """The 256 colours of a ramp."""
    given = sorted((min(255.0, max(0.0, d)), i, *c) for i, (d, *c) in enumerate(stops or []))
    if given:
        a = ([(0.0, -1, 255, 255, 255)] if given[0][0] > 0.5 else []) + given
        a += [(255.0, 1 << 30, *given[-1][2:])] if given[-1][0] < 254.5 else []
    else:
        a = [(0.0, 0, 255, 255, 255), (255.0, 1, *ink)]
    out = []
    for x in range(256):
        k = sum(i > 0 and s[0] < x for i, s in enumerate(a))
        low, high = a[k], a[min(k + 1, len(a) - 1)]
        t = min(1.0, max(0.0, (x - low[0]) / (high[0] - low[0]))) if high[0] > low[0] else 0.0
        out.append(tuple(math.floor(float(Decimal(repr(float(m + (n - m) * t))).quantize(Decimal("1e-9"), ROUND_HALF_UP)) + 0.5) for m, n in zip(low[2:], high[2:], strict=True)))
    return out


def test_ramps_by_parts(spark):
    r = random.Random(3)
    colour = lambda: [r.randrange(256) for _ in range(3)]
    given = [None, [], [(0.0, 1, 2, 3)], [(255.0, 9, 8, 7)], [(0.5, 4, 5, 6)], [(0.6, 4, 5, 6)], [(254.5, 1, 1, 1)], [(-9.0, 1, 2, 3), (400.0, 200, 100, 0)]]
    given += [[(100.0, 10, 20, 30), (100.0, 40, 50, 60)], [(100.5, 10, 20, 30), (100.25, 0, 0, 0), (100.75, 9, 9, 9)], [(7.0, *colour()), (7.0, *colour()), (7.0, *colour()), (3.0, *colour())]]
    given += [[(r.choice([r.uniform(-20, 280), float(r.randrange(256)), r.randrange(510) / 2]), *colour()) for _ in range(r.randrange(1, 9))] for _ in range(60)]
    rows = [(k, s, colour()) for k, s in enumerate(given)]
    df = spark.createDataFrame([(k, s, tuple(i)) for k, s, i in rows], "k long, stops array<struct<d: double, r: int, g: int, b: int>>, ink struct<r: int, g: int, b: int>")
    got = {}
    for row in tone.ink_ramps(df, F.col("stops"), F.col("ink")).collect():
        got[row["k"], row["x"]] = row["r"], row["g"], row["b"]
    assert len(got) == 256 * len(rows)
    for k, s, ink in rows:
        assert [got[k, x] for x in range(256)] == plain(s, ink)


def test_rows_of_one_file_become_many_on_all_tasks(spark):
    """Every part's 256 densities, made from a file that one task reads."""
    df = registry.QUERIES["ink_ramps"](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1  # before densities are made, and the sums need no other
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

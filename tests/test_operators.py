"""Operators beyond their queries: edge cases, invariants and round trips."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkreel.functions import samples
from sparkreel.operators import curves, equalise, fill, homography, identity, labels, layout, logs, media, planning, points, resample, robust, sheets, state, timeline, tone
from sparkreel.sources import png


def test_hold_and_keep(spark):
    present = [1, 3, 4, 7, 8, 9]  # eleven slots, holes first, last and two in a row
    df = spark.createDataFrame([("g", p, float(p) if p in present else None) for p in range(11)], "grp string, pos long, content double")
    assert [r["shown"] for r in timeline.hold(df, "grp", "content").orderBy("pos").collect()] == [1, 1, 1, 3, 4, 4, 4, 7, 8, 9, 9]
    kept = timeline.keep_intervals(df, "grp", "content")
    assert sorted((r["from"], r["to"]) for r in kept.collect()) == [(1, 2), (3, 5), (7, 10)]
    assert timeline.check_keep(kept, "grp").collect()[0].asDict() == {"grp": "g", "ordered": True, "frames": 6}
    assert timeline.keep_intervals(df.where("content is not null"), "grp", "content").count() == 0


def test_uniquified_skips_given_labels(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(["a", "a", "a_2", "a", "b"])], "grp string, i long, name string")
    assert [r["label"] for r in labels.uniquified(df, "grp", "name", "i").orderBy("i").collect()] == ["a", "a_2", "a_2_2", "a_3", "b"]


def test_ranges(spark):
    df = spark.createDataFrame([("1, 3-5; 9",), ("7-5",), ("x",), ("",), (None,), ("40-90",)], "t string")
    got = [r[0] for r in df.select(labels.range_set(F.col("t"), 10)).collect()]
    assert got == [[1, 3, 4, 5, 9], [5, 6, 7], [], [], None, []]


def test_upper_medians_of_hot_groups(spark):
    r = np.random.default_rng(5)
    groups = {"hot": r.integers(0, 400, 5001).tolist(), "even": [4, 1, 3, 2], "one": [7], "same": [5] * 90}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {x["g"]: x["median"] for x in robust.upper_medians(spark.createDataFrame(rows, "g string, x double").repartition(4), "g", "x").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {g: sorted(v)[len(v) // 2] for g, v in groups.items()}


@pytest.mark.parametrize("allowed", [0, 1, 3])
def test_nearest_code_against_all_codes(spark, allowed):
    book = identity.code_book(spark, 300)
    codes = [(x["rot"], x["id"], x["code"]) for x in book.collect()]
    seen = [(i, i * 7919 % 65_536) for i in range(400)] + [(900, 7919), (901, None)]
    got = {x["i"]: (x["errors"], x["rot"], x["marker"]) for x in identity.nearest_code(spark.createDataFrame(seen, "i int, bits int"), book, "bits", allowed).collect()}
    want = {i: min((bin(b ^ c).count("1"), rot, k) for rot, k, c in codes) for i, b in seen if b is not None}
    assert got == {i: w for i, w in want.items() if w[0] <= allowed}


@pytest.mark.parametrize("n", range(1, 8))
def test_upper_median(spark, n):
    df = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
    assert df.agg(robust.upper_median("x")).first()[0] == sorted(range(n))[n // 2]


def test_isotonic_is_monotone(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("g", float(i), float(v)) for i, v in enumerate(rng.normal(size=40).cumsum())], "grp string, x double, y double")
    fit = [r["fit"] for r in tone.isotonic(df, "grp", "x", "y").orderBy("x").collect()]
    assert all(a <= b + 1e-9 for a, b in zip(fit[:-1], fit[1:], strict=True))
    assert abs(sum(fit) - df.agg(F.sum("y")).first()[0]) < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3, 4]), st.booleans(), st.integers(0, 2**31))
def test_png_round_trip(h, w, c, deep, seed):
    px = np.random.default_rng(seed).integers(0, 65_536 if deep else 256, (h, w, c)).astype(np.uint16 if deep else np.uint8)
    px = px[:, :, 0] if c == 1 else px
    assert (png.decoded(png.encoded(px)) == px).all()


def test_crossfades_weigh_every_sample(spark):
    keep = spark.createDataFrame([(1, 0, 2, 18375), (1, 5, 9, 18375), (1, 9, 10, 18375), (2, 0, 9, 18475), (2, 10, 20, 18475)], 'grp long, "from" long, "to" long, have long'.replace('"', "`"))
    got = {}
    for r in timeline.crossfade_samples(keep, "grp", 44_100, 24.0, 0.005).collect():
        got.setdefault((r["grp"], r["from"]), []).append((r["i"], r["weight"]))
    assert {k: len(v) for k, v in got.items()} == {(1, 5): 221, (2, 10): 100}  # 18,475 - 18,375 samples are left
    assert sorted(got[2, 10]) == [(i, (i + 0.5) / 100) for i in range(100)]


def drawn_map(seed: int) -> np.ndarray:
    """A map of a page onto its scan: any turn up to 20 degrees, any scale, shift and slant."""
    r = np.random.default_rng(seed)
    turn, size = r.uniform(-0.35, 0.35), r.uniform(0.5, 2)
    out = np.array([[np.cos(turn), -np.sin(turn), 0], [np.sin(turn), np.cos(turn), 0], [0, 0, 1]]) * [[size], [size], [1]]
    out[:2, 2], out[2, :2] = r.uniform(-80, 80, 2), r.uniform(-2e-5, 2e-5, 2)
    return out


def applied(h, p):
    q = np.concatenate([p, np.ones((len(p), 1))], 1) @ np.asarray(h, float).reshape(3, 3).T
    return q[:, :2] / q[:, 2:]


def test_homographies_of_points_some_of_them_wrong(spark):
    cases, rows, want = [(1, 12, 2), (2, 30, 9), (3, 50, 38), (4, 200, 60), (5, 4, 0), (6, 3, 0)], [], {}
    for seed, count, wrong in cases:
        h, r = drawn_map(seed), np.random.default_rng(seed + 100)
        src = r.uniform(0, 900, (count, 2))
        dst, off = applied(h, src), r.permutation(count)[:wrong]
        if wrong:
            dst[off] = r.uniform(dst.min(0), dst.max(0) + 1, (wrong, 2)) + 40
        want[seed] = src, dst, np.setdiff1d(np.arange(count), off)
        rows += [(seed, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(src, dst, strict=True))]
    got = {r["sheet"]: r for r in homography.robust(spark.createDataFrame(rows, "sheet long, id long, x double, y double, u double, v double"), "sheet", "id").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    for seed, (src, dst, on) in want.items():
        if seed in got:
            assert got[seed]["inliers"] >= len(on) and got[seed]["n"] == len(src) and np.abs(applied(got[seed]["h"], src[on]) - dst[on]).max() < 3


def test_samples_are_drawn_by_rule():
    numbers, state = samples.drawn(samples.SEED), samples.SEED
    for _ in range(20):
        state ^= state >> 12
        state ^= state << 25 & (1 << 64) - 1
        state &= (1 << 64) - 1
        state ^= state >> 27
        assert next(numbers) == state * 0x2545F4914F6CDD1D % (1 << 64)
    four = samples.fours(5, 300)
    assert all(len(set(f)) == 4 and max(f) < 5 for f in four.tolist()) and (four == samples.fours(5, 300)).all()


def pixel_rows(spark, *pictures):
    rows = [(i, x, y, int(p[y, x])) for i, p in enumerate(pictures) for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "img long, x long, y long, gray long")


def picture(df, w, h, img=0):
    out = np.full((h, w), -1)
    for r in df.where(F.col("img") == img).collect():
        out[r["y"], r["x"]] = r["gray"]
    return out


def test_pictures_through_maps(spark):
    px = np.random.default_rng(1).integers(0, 256, (6, 7))
    df = pixel_rows(spark, px)
    one = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    assert (picture(resample.warped(df, 7, 6, one, 7, 6), 7, 6) == px).all() and (picture(resample.warped(df, 7, 6, one, 7, 6, cubic=False), 7, 6) == px).all()
    half = picture(resample.warped(df, 7, 6, [1.0, 0, 0.5, 0, 1.0, 0, 0, 0, 1.0], 10, 6), 10, 6)
    row = np.pad(px[2].astype(float), 2, mode="edge")
    assert half[2, 3] == np.floor(np.clip(row[4:8] @ [-0.0625, 0.5625, 0.5625, -0.0625], 0, 255) + 0.5)
    assert (half[:, 8:] == 0).all() and (half[:, 7] == px[:, 6]).all()  # 7.5 is the last place seen


def plain_resized(px, w, h, kind):
    def weights(n, to):
        out = np.zeros((to, n))
        for o in range(to):
            for i in range(n):
                if kind == "area":
                    out[o, i] = max(0.0, min(i + 1, (o + 1) * n / to) - max(i, o * n / to))
                else:
                    x = abs((i + 0.5 - (o + 0.5) * n / to) / max(1.0, n / to))
                    out[o, i] = max(0.0, 1 - x) if kind == "triangle" else np.sinc(x) * np.sinc(x / 3) if x < 3 else 0.0
        return out / out.sum(1, keepdims=True)

    return np.clip(np.floor(np.round(weights(px.shape[0], h) @ px @ weights(px.shape[1], w).T, 9) + 0.5), 0, 255)


@pytest.mark.parametrize("kind", ["area", "triangle", "lanczos"])
def test_pictures_at_other_sizes(spark, kind):
    one, two = np.random.default_rng(2).integers(0, 256, (2, 9, 11))
    df = pixel_rows(spark, one, two)
    for w, h in ((5, 4), (23, 17), (11, 9)):
        got = resample.resized(df, 11, 9, w, h, kind)
        assert (picture(got, w, h) == plain_resized(one, w, h, kind)).all() and (picture(got, w, h, 1) == plain_resized(two, w, h, kind)).all()


def test_local_equalisation_and_flat_fields(spark):
    rng = np.random.default_rng(3)
    px = (rng.integers(0, 60, (12, 17)) + np.arange(17) * 9).astype(int)
    tiles, limit, (h, w) = 4, 3.0, px.shape
    tw, th = -(-w // tiles), -(-h // tiles)
    tables = np.zeros((tiles, tiles, 256))
    for ty in range(tiles):
        for tx in range(tiles):
            part = px[ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw].ravel()
            counts, most = np.bincount(part, minlength=256), int(max(1.0, limit * max(1, part.size) / 256))
            over = np.clip(counts - most, 0, None).sum()
            tables[ty, tx] = np.clip(np.floor(np.cumsum(np.minimum(counts, most) + over // 256) / max(1, part.size) * 255 + 0.5), 0, 255)
    want = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            fy, fx = (y - th / 2) / th, (x - tw / 2) / tw
            y0, x0 = max(0, int(np.floor(fy))), max(0, int(np.floor(fx)))
            ay, ax = (0.0 if f < 0 else f - np.floor(f) for f in (fy, fx))
            y1, x1 = min(y0 + 1, tiles - 1), min(x0 + 1, tiles - 1)
            v = px[y, x]
            want[y, x] = (tables[y0, x0, v] * (1 - ax) + tables[y0, x1, v] * ax) * (1 - ay) + (tables[y1, x0, v] * (1 - ax) + tables[y1, x1, v] * ax) * ay
    df = pixel_rows(spark, px)
    assert (picture(equalise.equalised(df, w, h, tiles, limit), w, h) == np.floor(np.round(want, 9) + 0.5)).all()
    assert (picture(equalise.equalised(df, w, h, 20), w, h) == px).all()
    flat = picture(equalise.flat_field(df, w, h, 2), w, h)
    assert flat.min() == 0 and flat.max() == 255
    assert (picture(equalise.flat_field(pixel_rows(spark, np.full((6, 6), 90)), 6, 6), 6, 6) == 128).all()


def test_png_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png.encoded(np.zeros((3, 5), np.uint8)))
    (tmp_path / "b.png").write_bytes(b"no image at all, but long enough")
    got = {r["path"].rsplit("/", 1)[1]: r["header"] for r in png.images(spark, str(tmp_path)).select("path", "header").collect()}
    assert tuple(got["a.png"]) == (5, 3, 8, 0) and got["b.png"] is None


def test_layout_documents_of_the_first_version(spark):
    box = lambda k: [10 * k, 20 * k, 10 * k + 7, 20 * k + 9]
    page = lambda k, n: {"archivo_hoja": f"page{k}.png", "frames": {f"f{k}{i}": {"bbox": box(k + i), "archivo_original": f"in{i}.jpg"} for i in range(n)}, "qrs": {f"f{k}0": {"bbox": box(50)}}}
    text = json.dumps({"lienzo": {"ancho_px": 900, "alto_px": 1700, "ppi": 96}, "hojas": [page(1, 3), {"frames": {"lone": {"bbox": [1, 2, 3]}}}, page(3, 1)]})
    row = layout.upgraded(spark.createDataFrame([(text,)], "text string"), "text", "me").first()
    doc = row["doc"]
    assert (doc["version"], doc["app"], doc["lienzo"]["dpi"], doc["lienzo"]["orientacion"]) == (2, "me", 96, "portrait")
    assert [s["numero"] for s in doc["hojas"]] == [1, 2, 3] and [s["archivo_hoja"] for s in doc["hojas"]] == ["page1.png", "hoja_002.tif", "page3.png"]
    assert doc["hojas"][0]["frames"]["f12"].asDict()["archivo_original"] == "in2.jpg" and doc["hojas"][1]["frames"]["lone"]["archivo_original"] == "lone"
    assert doc["hojas"][2]["qrs"]["f30"]["texto"] == "f30" and doc["hojas"][1]["qrs"] == {}
    # markers lie MARGIN from the edges of this page
    corner = doc["marcadores"]["bboxes"]["2"]
    assert corner == [900 - layout.MARGIN - layout.SIDE, 1700 - layout.MARGIN - layout.SIDE, 900 - layout.MARGIN, 1700 - layout.MARGIN]
    assert json.loads(row["document"])["hojas"][0]["numero"] == 1
    flat = layout.frames(layout.upgraded(spark.createDataFrame([(text,)], "text string"), "text")).collect()
    assert {(r["numero"], r["name"], r["x1"], r["y2"]) for r in flat} == {(1, "f10", 10, 29), (1, "f11", 20, 49), (1, "f12", 30, 69), (2, "lone", None, None), (3, "f30", 30, 69)}


def test_layout_documents_of_the_second_version_come_back_unchanged(spark):
    text = json.dumps({"version": 2, "proyecto": "q", "lienzo": {"ancho_px": 77, "alto_px": 33, "dpi": 50}, "marcadores": {"ids_por_hoja": {"4": [1, 9]}}, "parche_grises": {"niveles": [0, 255]}, "hojas": [{"numero": 4, "frames": {}}], "video": {"fps": 12}})
    rows = spark.createDataFrame([(1, text), (2, "[]"), (3, None), (4, "{oops"), (5, " {}")], "k int, text string")
    got = {r["k"]: r for r in layout.upgraded(rows, "text").collect()}
    assert got[1]["document"] == text and got[1]["doc"]["hojas"][0]["numero"] == 4 and got[1]["doc"]["lienzo"]["dpi"] == 50
    assert [got[k]["doc"] for k in (2, 3, 4)] == [None] * 3 == [got[k]["document"] for k in (2, 3, 4)]
    assert got[5]["doc"]["hojas"] == [] and json.loads(got[5]["document"])["version"] == 2


def test_fill_of_uncovered_pixels_and_markers(spark):
    px = spark.range(400).select(F.lit(1).alias("img"), (F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"), F.lit(200).cast("long").alias("gray"))
    dark = F.col("x").between(8, 11) & F.col("y").between(8, 11)
    px = px.withColumn("gray", F.when(dark, 0).otherwise(F.col("gray")).cast("long"))
    rects = spark.createDataFrame([(1, 1, 8.0, 8.0, 12.0, 12.0), (2, 1, 0.0, 0.0, 5.0, 5.0)], "img int, ord int, x1 double, y1 double, x2 double, y2 double")
    assert {r["gray"] for r in fill.erased(px, rects, 20, 20).collect()} == {200}
    assert fill.erased(px, rects.where("img = 2"), 20, 20).where("gray = 0").count() == 16
    seen = px.where(fill.covers(F.col("x"), F.col("y"), (1, 0, -5, 0, 1, 0, 0, 0, 1), 100, 100))  # the five leftmost columns lie outside the scan
    assert seen.count() == 300
    white = px.where(~dark).withColumn("gray", F.when(F.col("x") < 10, 10).otherwise(20).cast("long"))
    crop = {(r["x"], r["y"]): r["gray"] for r in fill.crop_filled(white, 20, 20, -1, 0, 11, 10, "mirror").collect()}
    assert len(crop) == 110 and crop[0, 0] == 10 and crop[10, 9] == 20 and fill.paper(white.where("x > 100"), 20, 20).count() == 0
    with pytest.raises(ValueError):
        fill.crop_filled(px, 20, 20, 0, 0, 5, 5, "other")


def column(spark, c):
    return spark.range(1).select(c.alias("c")).first()[0]


def test_isotonic_pools_as_the_plain_rule(spark):
    def plain(ys):
        return [max(min(sum(ys[j : k + 1]) / (k - j + 1) for k in range(i, len(ys))) for j in range(i + 1)) for i in range(len(ys))]

    r = np.random.default_rng(8)
    for ys in ([3.0], [2.0, 1.0], [1.0, 1.0, 0.5, 0.5, 4.0], r.normal(size=60).tolist(), np.sort(r.normal(size=20))[::-1].tolist()):
        assert np.allclose(column(spark, curves.isotonic(F.array(*map(F.lit, ys)))), plain(ys))


def test_curves_at_their_edges(spark):
    one = F.array(F.lit(5.0))
    assert column(spark, curves.smooth_adaptive(one)) == [5.0] and column(spark, curves.pchip(one, one, F.array(F.lit(9.0)))) == [5.0]
    assert column(spark, curves.rising(F.array(*map(F.lit, (1.0, 1.0, 1.0, 0.5))), F.lit(0.25))) == [1.0, 1.25, 1.5, 1.75]
    straight = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: i.cast("double"))
    assert column(spark, curves.effective_lut(straight, 100, 0, F.lit(None).cast("array<double>"))) is None
    assert column(spark, curves.prior_curve(straight))[7] == 7 and column(spark, curves.prior_curve(F.reverse(straight))) is None and column(spark, curves.prior_curve(one)) is None
    assert [column(spark, curves.lerp256(straight, F.lit(x))) for x in (-3.0, 0.25, 254.5, 300.0)] == [0, 0.25, 254.5, 255]
    levels = F.array(*map(F.lit, (128, 0, 255)))
    points_ = column(spark, curves.level_curve(F.array(*map(F.lit, (99.0, 20.0, 220.0))), levels))
    assert [tuple(p) for p in points_] == [(20.0, 0.0), (220.0, 255.0)]
    assert column(spark, curves.level_curve(F.array(*map(F.lit, (99.0, 20.0, 21.0))), levels)) is None
    chart = spark.createDataFrame([("g", [float(i) for i in range(0, 256, 5)], [float(i) for i in range(0, 256, 5)])], "g string, x array<double>, y array<double>")
    lut = curves.chart_lut(chart).first()["lut"]
    assert len(lut) == 256 and max(abs(v - i) for i, v in enumerate(lut)) < 0.6 and lut == sorted(lut)
    assert [r["error"] for r in curves.check_response(chart, 53).collect()] == ["too few patches"]


def test_sheets_at_their_edges(spark):
    assert [column(spark, sheets.marker_count(F.lit(n))) for n in (0, 6, 7, 10, 99)] == [4, 4, 8, 8, 12]
    assert [column(spark, sheets.hex_to_rgb(F.lit(c))) for c in ("#abc", " FF0000", "#12345", "", "#gg0000")] == [[170, 187, 204], [255, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]
    assert column(spark, sheets.page_px(F.lit("Carta (Letter)"), 100, F.lit(True), F.lit(0), F.lit(0))) == (1100, 850)
    assert column(spark, sheets.paper_mm(F.lit("none"))) is None and column(spark, sheets.recommended_mm(F.lit(None).cast("double"), 1.25, 5.0)) == 12


def test_media_and_points_at_their_edges(spark):
    assert [column(spark, media.bytes_text(F.lit(n))) for n in (0, 1_499, 2_500_000, 3_210_000_000)] == ["0 KB", "1 KB", "2.5 MB", "3.2 GB"]
    assert column(spark, media.fits_budget(F.lit(2**62), F.lit(2**62), 10**9)) is False and column(spark, media.upscale_factor(F.lit(0), F.lit(9), 100)) == 1
    square = points.corners(F.lit(0), F.lit(0), F.lit(3), F.lit(2))
    assert column(spark, points.polygon_area(square)) == 6 and column(spark, points.is_convex(square))
    assert column(spark, points.inverse(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 2, 4, 6, 0, 0, 1)]))) is None
    h = F.array(*[F.lit(float(x)) for x in (2, 0, 1, 0, 4, 0, 0, 0, 1)])
    assert np.allclose(column(spark, points.product(h, points.inverse(h))), np.eye(3).ravel())
    spans = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.0, 1.0), (3, 5.0, 1.0)], "s int, a double, b double")
    assert sorted((r["s"], r["t"]) for r in media.sample_times(spans, "a", "b", 2.0).collect()) == [(1, 2.0), (2, 0.0), (2, 0.5), (3, 5.0)]


def test_planning_at_its_edges(spark):
    rows = spark.createDataFrame([("g", i) for i in range(1, 6)], "grp string, pos long")
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<bigint>")
    got = lambda inc, exc: sorted(r["pos"] for r in planning.select_numbers(rows, "pos", inc, exc).collect())
    assert got(arr(), arr(2)) == [1, 3, 4, 5] and got(arr(2, 3), arr(3)) == [2] and got(F.lit(None).cast("array<bigint>"), arr()) == [1, 2, 3, 4, 5]
    names = spark.createDataFrame([("g", i, n) for i, n in enumerate(["a.png", "a.jpg", "a_2.gif", "b"], 1)], "grp string, pos long, name string")
    plan = planning.compute_plan(names, "grp", "name", "pos", arr(), arr(), 3, naming="original").orderBy("k").collect()
    assert [r["label"] for r in plan] == ["a", "a_2", "a_2_2", "b"] and [(r["page"], r["cell"]) for r in plan] == [(0, 0), (0, 1), (0, 2), (1, 0)]


def test_logs_ranges_and_stores_at_their_edges(spark):
    told = column(spark, logs.probed(F.lit("nothing")))
    assert told.asDict() == {"duration": 0.0, "width": 0, "height": 0, "fps": 0.0, "rotation": 0, "pix": None}
    assert column(spark, logs.probed(F.lit("Stream #0:1: Audio: aac, 48000 Hz\nStream #0:0: Video: png, rgba(pc), 64x48, 25 fps")))["pix"].asDict() == {"format": "rgba", "depth": 8, "full": True, "known": True, "matrix": None}
    assert column(spark, logs.planar_format(F.lit("yuv422p10be"))) is None and column(spark, logs.planar_format(F.lit("yuva422p10le"))).asDict() == {"format": "I422P10", "sx": 2, "sy": 1}
    line = "Stream #0:0[0x1](und): Video: hevc (Main 10) (hvc1 / 0x31637668), yuv420p10le(tv, bt2020nc/bt2020/smpte2084, progressive), 3840x2160 [SAR 1:1 DAR 16:9], 71000 kb/s, 23.98 fps, 24k tbr (default)"
    told = column(spark, logs.probed(F.lit(f"  Duration: 01:02:03.50, start: 0.0\n  {line}\n   Display Matrix: rotation of -90.00 degrees")))
    assert told.asDict(True) == {"duration": 3723.5, "width": 3840, "height": 2160, "fps": 23.98, "rotation": 90, "pix": {"format": "yuv420p10le", "depth": 10, "full": False, "known": True, "matrix": "bt2020"}}
    assert column(spark, logs.probed(F.lit("Duration: N/A, x\nStream #0:0: Video: h264, 64x48, 25 fps"))).asDict() == {"duration": 0.0, "width": 64, "height": 48, "fps": 25.0, "rotation": 0, "pix": None}
    assert [column(spark, logs.codec_depth(F.lit(c))) for c in ("vp09.00", "hvc1.C2.4", "hev1.x", "avc1", "av01.0.04M.10.0.110", "")] == [None, 10, None, 8, 10, None]
    nan, inf, one = F.lit(float("nan")), F.lit(float("inf")), F.lit(1.0)
    assert all(column(spark, media.range_problem(a, b, F.lit(0.0))) for a, b in ((nan, one), (one, inf), (one, one), (F.lit(None).cast("double"), one)))
    assert column(spark, media.range_problem(F.lit(0.0), one, F.lit(None).cast("double"))) is None
    assert column(spark, media.bleed_growth(F.lit(-30.0))) == pytest.approx(1.39) and column(spark, media.bleed_growth(F.lit(None).cast("double"))) == 1
    rows = lambda *x: spark.createDataFrame(list(x), "kind string, name string, value int")
    old, new = rows(("a", "x", 1), ("flags", "f", 2)), rows(("a", "x", 9), ("a", "y", 8), ("flags", "g", 7))
    got = lambda **k: {(r["kind"], r["name"]): r["value"] for r in state.merged_stores(old, new, **k).collect()}
    assert got() == {("a", "x"): 1, ("a", "y"): 8, ("flags", "f"): 2}
    assert got(incoming_wins=True, left_out=()) == {("a", "x"): 9, ("a", "y"): 8, ("flags", "f"): 2, ("flags", "g"): 7}


def test_sweeping_spares_what_lives(spark):
    at = lambda s: None if s is None else f"2024-01-01 12:{s // 60:02d}:{s % 60:02d}"
    cases = [(1, 0, False, False, None), (2, 0, True, False, None), (3, None, False, False, None), (4, None, False, True, None), (5, None, False, False, 59 * 60), (6, 59 * 60 + 59, False, False, None)]
    df = spark.createDataFrame([(k, at(s), c, l, at(o)) for k, s, c, l, o in cases], "key int, last string, closed boolean, locked boolean, output string")
    df = df.withColumns({"last": F.to_timestamp("last"), "output": F.to_timestamp("output")})
    got = lambda now: {r["key"]: r["emptied"] for r in state.swept(df, "key", now).collect()}
    assert got("2024-01-01 12:59:59") == {2: True, 3: True, 5: False}
    assert got("2024-01-01 11:50:00") == {1: True, 2: True, 3: True, 5: False, 6: True}  # the clock was set back

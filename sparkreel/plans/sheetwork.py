"""Queries over sheets, markers, plans and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.operators import labels, planning, points, sheets
from sparkreel.plans.base import query
from sparkreel.session import table

L = F.lit


@query("select p_partkey, cast(round(p_size / 25.4::double * 300) as bigint) mm, greatest(1, cast(round(p_size / 72.0::double * 300) as bigint)) pt, p_size * 1000 > 9 and p_size between 1 and 40 fits, abs(p_size - 30) <= greatest(4, 30 // 100) near from part")
def unit_columns(spark, d):
    from sparkreel.operators import media

    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", sheets.mm_to_px(size, 300).alias("mm"), sheets.pt_to_px(size, 300).alias("pt"), media.fits_budget(size, L(1000), 40_000).alias("fits"), media.near(size, L(30)).alias("near"))


_PAPERS = "[" + ", ".join(f"'{n}'" for n in [*sheets.PAPER, *sheets.ALIASES, "own"]) + "]"
_SIZES = "(values " + ", ".join(f"('{n}', {w}::double, {h}::double)" for n, (w, h) in (sheets.PAPER | {a: sheets.PAPER[n] for a, n in sheets.ALIASES.items()}).items()) + ") z(name, pw, ph)"


@query(f"""with s as (select p_partkey, ({_PAPERS})[p_partkey % 13 + 1] paper, p_size % 2 = 0 land, 100 + p_size::double own_w, 200.0::double own_h from part),
m as (select p_partkey, land, coalesce(pw, own_w) w, coalesce(ph, own_h) h from s left join {_SIZES} on name = paper)
select p_partkey, cast(round(case when land then h else w end / 25.4 * 300) as bigint) w, cast(round(case when land then w else h end / 25.4 * 300) as bigint) h from m""")
def page_sizes(spark, d):
    names = F.array(*[L(n) for n in [*sheets.PAPER, *sheets.ALIASES, "own"]])
    page = sheets.page_px(F.get(names, (F.col("p_partkey") % 13).cast("int")), 300, F.col("p_size") % 2 == 0, 100 + F.col("p_size"), L(200.0))
    return table(spark, d, "part").select("p_partkey", page.alias("p")).select("p_partkey", "p.w", "p.h")


@query("""with s as (select p_partkey, 150 + p_size * 5 dpi, (5 + p_size % 9)::double mm, p_size % 3 = 0 cyan, p_partkey % 14 wanted, 3.0::double + p_size % 5 mmargin from part),
a as (select *, greatest(8, cast(round(mm / 25.4 * dpi) as bigint)) side, cast(round(210 / 25.4::double * dpi) as bigint) w, cast(round(297 / 25.4::double * dpi) as bigint) h, cast(round(mmargin / 25.4 * dpi) as bigint) m, case when wanted < 7 then 4 when wanted < 11 then 8 else 12 end n from s),
b as (select *, greatest(2, side // case when cyan then 4 else 7 end) quiet from a), c as (select *, side + 2 * quiet patch, greatest(cast(round(10 / 25.4::double * dpi) as bigint), m + side + 2 * quiet + cast(round(2 / 25.4::double * dpi) as bigint)) margin from b),
e as (select *, w - m - patch r, h - m - patch t from c),
k as (select p_partkey, side, quiet, margin, n, unnest([[m, m], [r, m], [r, t], [m, t], [(w - patch) // 2, m], [r, (h - patch) // 2], [(w - patch) // 2, t], [m, (h - patch) // 2], [m + (r - m) // 3, m], [m + (r - m) * 2 // 3, m], [m + (r - m) // 3, t], [m + (r - m) * 2 // 3, t]]) xy, unnest(range(0, 12)) place from e)
select p_partkey, margin, place, xy[1] + quiet x1, xy[2] + quiet y1, xy[1] + quiet + side x2, xy[2] + quiet + side y2 from k where place < n""")
def compute_layout(spark, d):
    size = F.col("p_size")
    settings = table(spark, d, "part").select(
        "p_partkey", L("A4").alias("paper"), (150 + size * 5).alias("dpi"), L(False).alias("landscape"), L(0.0).alias("own_w"), L(0.0).alias("own_h"), L(10.0).alias("margin_mm"),
        (5 + size % 9).cast("double").alias("marker_mm"), (3.0 + size % 5).alias("marker_margin_mm"), (F.col("p_partkey") % 14).alias("markers_wanted"), (size % 3 == 0).alias("cyan"), L(True).alias("registration"),
    )
    return sheets.compute_layout(settings).select("p_partkey", "margin", F.explode("markers").alias("m")).select("p_partkey", "margin", "m.*")


@query("""with s as (select p_partkey, p_size % 2 = 0 reg, p_size % 3 = 0 qr, case when p_partkey % 14 < 7 then 4 when p_partkey % 14 < 11 then 8 else 12 end n, [50, 100, 250, 1000][p_size % 4 + 1] dict from part)
select p_partkey, case when reg and not qr then cast((dict // n) * (dict // n) as bigint) end capacity from s""")
def marker_capacity(spark, d):
    dictionary = F.get(F.array(*map(L, (50, 100, 250, 1000))), F.col("p_size") % 4)
    return table(spark, d, "part").select("p_partkey", sheets.marker_capacity(dictionary, F.col("p_partkey") % 14, F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("capacity"))


@query("""with b as (select p_partkey, p_size * 10 x1, p_size * 7 y1, p_size * 10 + 200 x2, p_size * 7 + 121 y2, 1 + (p_size % 5) * 0.01::double kx, 1 + (p_size % 2) * 0.02::double ky from part), f as (select *, abs(kx - 1) > 1e-4 or abs(ky - 1) > 1e-4 f from b)
select p_partkey, case when f then cast(round(1240.0::double + (x1 - 1240.0::double) / kx) as bigint) else x1 end x1, case when f then cast(round(1754.0::double + (y1 - 1754.0::double) / ky) as bigint) else y1 end y1, case when f then cast(round(1240.0::double + (x2 - 1240.0::double) / kx) as bigint) else x2 end x2, case when f then cast(round(1754.0::double + (y2 - 1754.0::double) / ky) as bigint) else y2 end y2 from f""")
def print_scaled_boxes(spark, d):
    s = F.col("p_size")
    box = F.struct((s * 10).alias("x1"), (s * 7).alias("y1"), (s * 10 + 200).alias("x2"), (s * 7 + 121).alias("y2"))
    out = table(spark, d, "part").withColumn("b", box).select("p_partkey", sheets.scaled_box(F.col("b"), 1 + (s % 5) * 0.01, 1 + (s % 2) * 0.02, L(2480), L(3508)).alias("b"))
    return out.select("p_partkey", "b.*")


@query("""with b as (select p_partkey, p_size * 20 - 300 x1, p_size * 10 y1, 100 + p_size w, 60.5::double h, (p_size % 4 - 1) * 0.02::double bleed from part), r as (select *, round(w * 1.5::double) cw, round(h * 1.5::double) ch from b),
c as (select p_partkey, cast(round(x1 * 1.5::double + cast(trunc(cw * bleed) as bigint)) as bigint) x, cast(round(y1 * 1.5::double + cast(trunc(ch * bleed) as bigint)) as bigint) y, cast(cw as bigint) - 2 * cast(trunc(cw * bleed) as bigint) w, cast(ch as bigint) - 2 * cast(trunc(ch * bleed) as bigint) h from r)
select * from c where w >= 1 and h >= 1 and x < 800 and y < 700 and x + w > 0 and y + h > 0""")
def crop_rectangles(spark, d):
    s = F.col("p_size")
    box = F.struct((s * 20 - 300).alias("x1"), (s * 10).alias("y1"), (s * 20 - 300 + 100 + s).alias("x2"), (s * 10 + 60.5).alias("y2"))
    out = table(spark, d, "part").withColumn("b", box).select("p_partkey", sheets.crop_rect(F.col("b"), L(1.5), (s % 4 - 1) * 0.02, L(800), L(700)).alias("c"))
    return out.where("c is not null").select("p_partkey", "c.*")


@query("""with c as (select p_partkey, case p_size % 4 when 0 then '#' || lower(lpad(printf('%X', p_partkey * 7919 % 16777216), 6, '0')) when 1 then printf('%03X', p_partkey % 4096) when 2 then 'red' else ' #00ff7f ' end t from part), u as (select p_partkey, trim(ltrim(trim(t), '#')) t from c),
v as (select p_partkey, case when length(t) = 3 then t[1] || t[1] || t[2] || t[2] || t[3] || t[3] else t end t from u), w as (select p_partkey, case when regexp_matches(t, '^[0-9A-Fa-f]{6}$') then t else '000000' end t from v),
x as (select p_partkey, t, cast(('0x' || t[1:2]) as bigint) r, cast(('0x' || t[3:4]) as bigint) g, cast(('0x' || t[5:6]) as bigint) b from w) select p_partkey, r, g, b, '#' || upper(t) hex, (299 * r + 587 * g + 114 * b + 500) // 1000 gray from x""")
def colour_columns(spark, d):
    n = F.col("p_partkey")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(L("#"), F.lower(F.lpad(F.hex(n * 7919 % 16_777_216), 6, "0")))).when(F.col("p_size") % 4 == 1, F.lpad(F.hex(n % 4096), 3, "0")).when(F.col("p_size") % 4 == 2, "red").otherwise(" #00ff7f ")
    rows = table(spark, d, "part").select("p_partkey", sheets.hex_to_rgb(text).alias("c"))
    r, g, b = (F.get("c", L(i)) for i in range(3))
    return rows.select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"), sheets.rgb_to_hex(F.col("c")).alias("hex"), sheets.gray_of(r, g, b).alias("gray"))


@query("""with s as (select p_partkey, ['cyan', ' Cianotipia ', 'normal', 'CYANOTYPE'][p_size % 4 + 1] mode, p_partkey % 5 > 0 reg, p_size % 13 mm, p_size % 2 = 0 qr, p_size % 15 qmm, p_size % 8 margin, p_size % 3 = 0 saving, p_size % 6 halo, [null, '', '#ffffff', '#202020'][p_partkey % 4 + 1] block from part),
w as (select p_partkey, case when regexp_matches(lower(trim(mode)), '^c[yi]an') and reg then list_filter([case when mm < 10 then 'marker' end, case when qr and qmm < 12 then 'qr' end, case when margin < 6 then 'margin' end, case when saving and halo < 4 then 'halo' end, case when block = '#ffffff' then 'block' end], lambda x: x is not null) else [] end w from s)
select p_partkey, cast(len(w) as bigint) n, array_to_string(w, ',') warnings from w""")
def size_warnings(spark, d):
    s, n = F.col("p_size"), F.col("p_partkey")
    settings = table(spark, d, "part").select(
        "p_partkey", F.get(F.array(*map(L, ("cyan", " Cianotipia ", "normal", "CYANOTYPE"))), s % 4).alias("mode"), (n % 5 > 0).alias("registration"), (s % 13).alias("marker_mm"), (s % 2 == 0).alias("qr"), (s % 15).alias("qr_mm"), (s % 8).alias("margin_mm"),
        (s % 3 == 0).alias("saving"), (s % 6).alias("halo_mm"), F.get(F.array(L(None), L(""), L("#ffffff"), L("#202020")), (n % 4).cast("int")).alias("block"),
    )
    return planning.sheet_warnings(settings).select("p_partkey", F.size("warnings").cast("long").alias("n"), F.array_join("warnings", ",").alias("warnings"))


@query("with s as (select p_brand, min(case when p_size % 7 > 1 then p_size / 2.0::double end) m, min(case when p_size > 48 then p_size / 3.0::double end) q from part group by p_brand) select p_brand, m least, case when m is null then 12.0 else greatest(5.0, round(m * 1.25::double * 2) / 2) end marker, case when q is null then 12.0 else greatest(8.0, round(q * 1.2::double * 2) / 2) end qr from s")
def recommended_sizes(spark, d):
    s = F.col("p_size")
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.min(F.when(s % 7 > 1, s / 2)).alias("m"), F.min(F.when(s > 48, s / 3)).alias("q"))
    return rows.select("p_brand", F.col("m").alias("least"), sheets.recommended_mm(F.col("m"), 1.25, 5.0).alias("marker"), sheets.recommended_mm(F.col("q"), 1.2, 8.0).alias("qr"))


@query("with f as (select o_custkey project, o_orderkey sheet, l_linenumber label, l_quantity q from lineitem join orders on l_orderkey = o_orderkey) select project, count(distinct sheet) sheets, count(*) frames, cast(sum(q) as double) total from f group by project")
def assemble_layout(spark, d):
    f = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    f = f.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("sheet"), F.col("l_linenumber").alias("label"), F.array("l_quantity", L(0.0)).alias("box"))
    docs = sheets.assemble_layout(f, "project", "sheet", "label", "box")
    back = F.from_json("document", "sheets array<struct<number:bigint,frames:array<struct<label:int,bbox:array<double>>>>>")
    boxes = F.flatten(F.transform(back["sheets"], lambda s: s["frames"]))
    return docs.select("project", F.size(back["sheets"]).cast("long").alias("sheets"), F.size(boxes).cast("long").alias("frames"), F.aggregate(boxes, L(0.0), lambda a, x: a + x["bbox"][0]).alias("total"))


_FOUND = """lay as (select s_suppkey id, s_suppkey * 37 % 211 * 1.0::double x1, s_suppkey * 53 % 197 * 1.0::double y1 from supplier), fo as (select s_nationkey scan, s_suppkey id, s_suppkey * 37 % 211 * 1.5::double + 4 x, s_suppkey * 53 % 197 * 1.5::double - 2 + s_suppkey % 3 y from supplier where s_suppkey % 6 > 0),
co as (select scan, fo.id, k corner, x + case when k in (1, 2) then 30 else 0 end sx, y + case when k > 1 then 30 else 0 end sy, (x1 + case when k in (1, 2) then 20 else 0 end) * 1.5::double lx, (y1 + case when k > 1 then 20 else 0 end) * 1.5::double ly from fo join lay using (id), (select unnest(range(0, 4)) k))"""


def _pairs(spark, d):
    s = table(spark, d, "supplier").withColumns({"x1": F.col("s_suppkey") * 37 % 211 * 1.0, "y1": F.col("s_suppkey") * 53 % 197 * 1.0})
    layout = s.select(F.col("s_suppkey").alias("id"), "x1", "y1", (F.col("x1") + 20).alias("x2"), (F.col("y1") + 20).alias("y2"))
    x, y = F.col("x1") * 1.5 + 4, F.col("y1") * 1.5 - 2 + F.col("s_suppkey") % 3
    found = s.where("s_suppkey % 6 > 0").select(F.col("s_nationkey").alias("scan"), F.col("s_suppkey").alias("id"), points.corners(x, y, x + 30, y + 30).alias("corners"))
    return points.correspondences(found, layout, "id", 1.5).withColumn("corner", F.col("corner").cast("long"))


@query(f"with {_FOUND} select * from co")
def correspondences(spark, d):
    return _pairs(spark, d)


@query(f"with {_FOUND}, e as (select scan, id, sqrt((sx - 4 - lx) * (sx - 4 - lx) + (sy + 2 - ly) * (sy + 2 - ly)) e from co) select scan, id, round(avg(e), 6) mean_error from e group by scan, id")
def residual_field(spark, d):
    rows = points.corner_residuals(_pairs(spark, d), [1.0, 0.0, -4.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0])
    return rows.groupBy("scan", "id").agg(F.round(F.avg("error"), 6).alias("mean_error"))


@query(f"with {_FOUND}, e as (select scan, sqrt((sx - 4 - lx) * (sx - 4 - lx) + (sy + 2 - ly) * (sy + 2 - ly)) e from co), m as (select scan, count(*) points, list_sort(list(e))[count(*) // 2 + 1] m from e group by scan) select scan, points, round(m, 6) median, points >= 16 and m >= 0.9::double worth from m")
def local_shift_guard(spark, d):
    rows = points.corner_residuals(_pairs(spark, d), [1.0, 0.0, -4.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0])
    return points.worth_shifting(rows, "scan", 6.0).withColumn("median", F.round("median", 6))


@query(f"with {_FOUND}, c as (select scan, (max(lx) - min(lx)) * (max(ly) - min(ly)) / (400.0::double * 300) c from co group by scan) select scan, round(c, 6) cover, c < 0.25 small from c")
def marker_cover(spark, d):
    return points.cover(_pairs(spark, d), "scan", 400.0, 300.0).withColumn("cover", F.round("cover", 6))


@query("""with l as (select o_orderkey sheet, unnest(range(0, 5)) place, o_orderkey % 97 + 100 * unnest(range(0, 5)) marker from orders), k as (select *, row_number() over (partition by marker order by sheet desc, place desc) n from l)
select marker, sheet, place, place * 50.0::double x1 from k where n = 1 and place < 4""")
def resolve_markers(spark, d):
    ids = F.transform(F.sequence(L(0), L(4)), lambda i: F.col("o_orderkey") % 97 + 100 * i)
    boxes = spark.range(4).select(F.col("id").alias("place"), (F.col("id") * 50.0).alias("x1"))
    return points.resolved_markers(table(spark, d, "orders").select(F.col("o_orderkey").alias("sheet"), ids.alias("ids")), boxes, "sheet", "ids").select("marker", "sheet", "place", "x1")


@query("with r as (select l_orderkey scan, l_suppkey marker, l_linenumber, row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber) n from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey < 10)) select scan, marker, l_linenumber from r where n = 1")
def detected_filter(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.col("l_suppkey").alias("marker"), "l_linenumber")
    return points.first_detected(found, table(spark, d, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("marker")), "scan", "marker", "l_linenumber").select("scan", "marker", "l_linenumber")


@query("with s as (select p_size number, min(p_partkey) sheet from part group by p_size) select l_orderkey, l_linenumber, sheet from lineitem join s on number = cast(l_quantity as bigint)")
def sheet_by_number(spark, d):
    asks = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("number"))
    known = table(spark, d, "part").select(F.col("p_size").alias("number"), F.col("p_partkey").alias("sheet"))
    return points.sheet_by_number(asks, known, "number", "sheet").select("l_orderkey", "l_linenumber", "sheet")


@query("with p as (select vec_id, embedding::double[] e from embeddings), q as (select vec_id, [[e[1], e[2]], [e[3] + 1, e[4]], [e[5] + 1, e[6] + 1], [e[7], e[8] + 1]] v from p), a as (select vec_id, list_transform([1, 2, 3, 4], lambda i: v[i][1] * v[i % 4 + 1][2] - v[i % 4 + 1][1] * v[i][2]) t, list_transform([1, 2, 3, 4], lambda i: (v[i % 4 + 1][1] - v[i][1]) * (v[(i + 1) % 4 + 1][2] - v[i % 4 + 1][2]) - (v[i % 4 + 1][2] - v[i][2]) * (v[(i + 1) % 4 + 1][1] - v[i % 4 + 1][1])) c from q) select vec_id, round(abs(list_sum(t)) / 2, 6) area, not (list_max(c) > 0 and list_min(c) < 0) convex from a")
def polygon_columns(spark, d):
    e = lambda i, k=0.0: F.get("embedding", L(i)).cast("double") + k
    corners = [(e(0), e(1)), (e(2, 1), e(3)), (e(4, 1), e(5, 1)), (e(6), e(7, 1))]
    rows = table(spark, d, "embeddings").select("vec_id", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]).alias("p"))
    return rows.select("vec_id", F.round(points.polygon_area(F.col("p")), 6).alias("area"), points.is_convex(F.col("p")).alias("convex"))


@query("with e as (select vec_id, embedding::double[] e from embeddings), p as (select vec_id, 1 + e[1] a, e[2] b, 10 * e[3] c, e[4] d, 1 + e[5] e, 10 * e[6] f, 5 + e[7] x, 7 + e[8] y from e), q as (select *, a * x + b * y + c u, d * x + e * y + f v, a * e - b * d det from p) select vec_id, round(u, 6) u, round(v, 6) v, case when abs(det) >= 1e-12 then round((e * (u - c) - b * (v - f)) / det, 4) end x, case when abs(det) >= 1e-12 then round((a * (v - f) - d * (u - c)) / det, 4) end y from q")
def map_columns(spark, d):
    e = lambda i: F.get("embedding", L(i)).cast("double")
    h = F.array(1 + e(0), e(1), 10 * e(2), e(3), 1 + e(4), 10 * e(5), L(0.0), L(0.0), L(1.0))
    rows = table(spark, d, "embeddings").select("vec_id", h.alias("h"), (5 + e(6)).alias("x"), (7 + e(7)).alias("y")).withColumn("i", points.inverse(F.col("h")))
    at = lambda m, x, y: points.projected([F.get(m, L(k)) for k in range(9)], x, y)
    rows = rows.withColumn("p", at("h", F.col("x"), F.col("y"))).withColumn("q", at("i", F.col("p.x"), F.col("p.y")))
    return rows.select("vec_id", F.round("p.x", 6).alias("u"), F.round("p.y", 6).alias("v"), F.round("q.x", 4).alias("x"), F.round("q.y", 4).alias("y"))


@query("""with r as (select p_brand grp, p_partkey, p_name, row_number() over (partition by p_brand order by p_partkey) pos from part), s as (select *, row_number() over (partition by grp order by pos) k from r where not (pos between 5 and 9)),
l as (select grp, pos, k, 'f_' || case when pos + 9 < 1000 then lpad(cast(pos + 9 as varchar), 3, '0') else cast(pos + 9 as varchar) end as label from s) select grp, pos, k, label, (k - 1) // 12 page, (k - 1) % 12 cell from l""")
def plan_with_exclusions(spark, d):
    rows = labels.pages(table(spark, d, "part").select(F.col("p_brand").alias("grp"), "p_partkey", L("f").alias("name")), "grp", 12, "p_partkey").withColumnRenamed("number", "pos")
    plan = planning.compute_plan(rows, "grp", "name", "pos", F.array().cast("array<bigint>"), labels.range_set(L("5-9"), 1000), 12, start=10, digits=3, numbering="original")
    return plan.select("grp", "pos", "k", "label", "page", "cell")


@query("""with r as (select p_brand grp, row_number() over (partition by p_brand order by p_partkey) pos from part), s as (select *, row_number() over (partition by grp order by pos) k from r where pos % 3 > 0 and pos <= 40) select grp, (k - 1) // 6 page, 3 + (min(pos) - 1) // 6 original_page, 'p' || lpad(cast(3 + (min(pos) - 1) // 6 as varchar), 3, '0') as label from s group by grp, (k - 1) // 6""")
def original_page_labels(spark, d):
    rows = labels.pages(table(spark, d, "part").select(F.col("p_brand").alias("grp"), "p_partkey"), "grp", 12, "p_partkey").withColumnRenamed("number", "pos").drop("page", "cell")
    include = F.filter(F.sequence(L(1).cast("long"), L(40).cast("long")), lambda x: x % 3 > 0)
    plan = planning.compute_plan(rows.withColumn("name", L("f")), "grp", "name", "pos", include, F.lit(None).cast("array<bigint>"), 6)
    out = planning.original_pages(plan, "grp", "page", "pos", 6, 3)
    return out.withColumn("label", planning.page_label(F.col("original_page"), "p", 3))


@query("""with m as (select coalesce(nullif(trim(translate(p_name, '<>:"/\\|?*', '_________')), ''), 'frame') as label, max(p_partkey) m from part where p_size % 2 = 0 group by 1), o as (select p_name as label, max(p_partkey) o from part where p_size % 3 = 0 group by 1) select coalesce(m.label, o.label) as label, coalesce(o, m) content from m full join o on m.label = o.label""")
def available_frames(spark, d):
    part = table(spark, d, "part").select(F.col("p_name").alias("label"), F.col("p_partkey").alias("content"), "p_size")
    return planning.available_frames(part.where("p_size % 2 = 0"), part.where("p_size % 3 = 0"), "label", "content")


@query("with r as (select p_brand, p_partkey seq, nullif(p_size, 7) sheet, row_number() over (partition by p_brand order by case when p_partkey % 50 = 3 then 0 else 1 end, coalesce(nullif(p_size, 7), 0), p_partkey) n from part) select p_brand, seq, sheet from r where n = 1")
def reference_entry(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("seq"), F.nullif(F.col("p_size"), L(7)).alias("sheet"), (F.col("p_partkey") % 50 == 3).alias("chosen"))
    return planning.reference_entry(rows, "p_brand", "chosen", "sheet", "seq")


@query("select p_partkey, case when not (p_size % 2 = 0 and p_size % 3 > 0) then 'raw' when nullif(p_size % 5, 0) is null then 'unreadable' when p_size % 7 > 2 then 'normal' when p_size % 11 = 0 then 'raw' else 'cyan:' || p_brand end as key from part")
def levels_key(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", planning.levels_key(s % 2 == 0, s % 3 > 0, F.nullif(s % 5, L(0)), s % 7 <= 2, F.when(s % 11 > 0, F.col("p_brand"))).alias("key"))


@query("select p_partkey, case p_size % 3 when 0 then 'DICT_4X4_50' when 1 then 'other' else 'new' end as dict, '' as ink, case when p_size % 2 = 0 then floor(p_size / 4.0::double + 0.5) end as dpi, p_size / 4.0::double as mm from part")
def settings_columns(spark, d):
    s = F.col("p_size")
    old = F.when(s % 3 == 0, "old four").when(s % 3 == 1, "other").otherwise("new")
    given = F.create_map(L("dict"), old, L("ink"), L("#123456"), L("dpi"), F.when(s % 2 == 0, (s / 4).cast("string")).otherwise("none"), L("mm"), (s / 4).cast("string"))
    rows = table(spark, d, "part").select("p_partkey", planning.normalized_settings(given, {"dict": {"old four": "DICT_4X4_50"}}, ("ink",)).alias("m"), planning.numeric_settings(given, ("dpi",)).alias("n"))
    return rows.select("p_partkey", F.col("m")["dict"].alias("dict"), F.col("m")["ink"].alias("ink"), F.col("n")["dpi"].alias("dpi"), F.col("n")["mm"].alias("mm"))


@query("select o_custkey, count(distinct l_orderkey) sheets, count(*) frames from lineitem join orders on l_orderkey = o_orderkey group by o_custkey")
def layout_summary(spark, d):
    f = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return planning.layout_summary(f, "o_custkey", "l_orderkey")


@query("select p_name as label, arg_max(p_size, p_partkey) content from part group by p_name")
def claimed_labels(spark, d):
    return planning.claimed_labels(table(spark, d, "part").select(F.col("p_name").alias("label"), F.col("p_size").alias("content"), F.col("p_partkey").alias("seq")), "label", "content", "seq")


@query("with c as (select user_id grp, event_id, unnest(string_split(event_type || cast(event_id % 10 as varchar), '')) ch from events) select grp, ch as char, min(event_id) as first from c where ch not in ('e', 'i', 'c', '1') group by grp, ch")
def missing_characters(spark, d):
    texts = table(spark, d, "events").select(F.col("user_id").alias("grp"), "event_id", F.concat("event_type", (F.col("event_id") % 10).cast("string")).alias("text"))
    return planning.missing_characters(texts, spark.createDataFrame([("e",), ("i",), ("c",), ("1",)], "char string"), "grp", "text", "event_id")

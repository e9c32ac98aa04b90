"""Queries over layout documents and the filling of crops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sparkreel.operators import fill, layout
from sparkreel.plans.base import GRAY8, gray8, query
from sparkreel.session import table

UPPER = "list_sort(list({0}))[len(list({0})) // 2 + 1]"
PAPER = f"pap as (select img, {UPPER.format('gray')} paper from px group by img)"


@query("""with c as (select l_orderkey doc, l_returnflag flag, l_partkey part, min(l_suppkey)::double a, min(l_linenumber)::double b, max(l_quantity) c from lineitem group by all),
s as (select doc, flag, row_number() over (partition by doc order by flag) numero from (select distinct doc, flag from c))
select doc, numero, case when flag = 'R' then 'hoja_' || lpad(cast(numero as varchar), 3, '0') || '.tif' else flag || '.tif' end archivo_hoja, 'p' || part as name, 'p' || part as etiqueta, 'p' || part as archivo_original,
  a x1, b y1, a + c x2, b + c y2, case when doc % 3 = 0 then 2480 else 1000 + doc % 7 * 10 end ancho, case when doc % 3 = 0 then 3508 else 2000 end alto, case when doc % 3 = 0 then 300 else 150 end dpi,
  case when doc % 3 = 0 then 2480 else 1000 + doc % 7 * 10 end - 140.0::double marker_x from c join s using (doc, flag)""")
def layout_upgrade(spark, d):
    cells = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))
    cells = cells.agg(F.min("l_suppkey").cast("double").alias("a"), F.min("l_linenumber").cast("double").alias("b"), F.max("l_quantity").alias("c"))
    frame = F.struct(F.concat(F.lit("p"), F.col("part").cast("string")), F.struct(F.array(F.col("a"), F.col("b"), F.col("a") + F.col("c"), F.col("b") + F.col("c")).alias("bbox")))
    sheets = cells.groupBy("doc", "flag").agg(F.collect_list(frame).alias("frames"))
    sheet = F.struct("flag", F.when(F.col("flag") != "R", F.concat("flag", F.lit(".tif"))).alias("archivo_hoja"), "frames")
    named = lambda s: F.struct(s["archivo_hoja"].alias("archivo_hoja"), F.map_from_entries(s["frames"]).alias("frames"))
    page = F.when(F.col("doc") % 3 != 0, F.struct((1000 + F.col("doc") % 7 * 10).alias("ancho_px"), F.lit(2000).alias("alto_px"), F.lit(150).alias("ppi")))
    docs = sheets.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(sheet)), named).alias("hojas")).select("doc", F.to_json(F.struct(page.alias("lienzo"), "hojas")).alias("text"))
    docs = layout.upgraded(docs.withColumnRenamed("doc", "key"), "text").select(F.col("key").alias("k"), "doc")
    docs = docs.select("k", "doc", F.col("doc.lienzo.ancho_px").alias("ancho"), F.col("doc.lienzo.alto_px").alias("alto"), F.col("doc.lienzo.dpi").alias("dpi"), F.element_at("doc.marcadores.bboxes", "1")[0].alias("marker_x"))
    return layout.frames(docs, "k", "ancho", "alto", "dpi", "marker_x").withColumnRenamed("k", "doc")


def _crop(mode: str, sx: str, sy: str) -> str:
    return f"select '{mode}' fill, img, dx x, dy y, {sx} sx, {sy} sy, paper from pap, (select unnest(range(0, 12)) dx), (select unnest(range(0, 13)) dy)"


def _fold(i: str) -> str:
    return f"case when ({i} + 16) % 16 < 8 then ({i} + 16) % 16 else 15 - ({i} + 16) % 16 end"


@query(f"""with {GRAY8}, {PAPER}, a as ({_crop('paper', 'dx - 2', 'dy - 3')} union all {_crop('mirror', _fold('(dx - 2)'), _fold('(dy - 3)'))} union all {_crop('tile', '(dx + 6) % 8', '(dy + 5) % 8')})
select fill, a.img, a.x, a.y, coalesce(px.gray, paper) gray from a left join px on px.img = a.img and px.x = sx and px.y = sy""")
def crop_fill_modes(spark, d):
    px = gray8(spark, d)
    crops = [fill.crop_filled(px, 8, 8, -2, -3, 12, 13, mode).select(F.lit(mode).alias("fill"), "*") for mode in fill.MODES]
    return reduce(lambda a, b: a.unionByName(b), crops)


@query(f"""with {GRAY8}, tone as (select img, {UPPER.format('gray')} tone from px where not (x >= greatest(0, img % 3 - 1) and x < img % 3 + 5 and y >= 1 and y < 7) and x < 8 and x >= img % 3 - 4 group by img)
select img, x, y, case when x >= greatest(0, img % 3 - 1) and x < img % 3 + 5 and y >= 1 and y < 7 then tone else gray end gray from px join tone using (img)""")
def erase_markers(spark, d):
    px = gray8(spark, d)
    left = (F.col("img") % 3).cast("double") + 1
    rects = px.select("img").distinct().select("img", F.lit(1).alias("ord"), left.alias("x1"), F.lit(3.0).alias("y1"), (left + 2).alias("x2"), F.lit(5.0).alias("y2"))
    return fill.erased(px, rects, 8, 8)

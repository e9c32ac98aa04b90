"""Layout documents: JSON of either version as columns of the second one, and their frames as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the first version: markers of 100 pixels, 40 from the edges of an A4 page at 300 dpi.
SIDE, MARGIN, WIDTH, HEIGHT, DPI = 100, 40, 2480, 3508, 300

_FRAME = "struct<bbox:array<double>,celda:int,archivo_original:string,orig_px:array<bigint>,etiqueta:string>"
_CODE = "struct<bbox:array<double>,celda:int,texto:string,etiqueta:string>"
_SCHEMA = f"""version bigint, app string, proyecto string, modo string, espejado boolean,
lienzo struct<ancho_px:bigint,alto_px:bigint,ppi:bigint,dpi:bigint,orientacion:string>,
marcadores struct<dict:string,cantidad:int,lado_px:int,bboxes:map<string,array<double>>>,
hojas array<struct<numero:bigint,archivo_hoja:string,frames:map<string,{_FRAME}>,qrs:map<string,{_CODE}>>>,
timeline array<struct<pos:int,etiqueta:string,rep:string>>, originales_dir string"""


def _marker_boxes(w: Column, h: Column) -> Column:
    """The four corners' boxes, clockwise from the upper left."""
    near, far = F.lit(MARGIN), F.lit(MARGIN + SIDE)
    corners = [(near, near, far, far), (w - far, near, w - near, far), (w - far, h - far, w - near, h - near), (near, h - far, far, h - near)]
    return F.create_map(*[x for i, c in enumerate(corners) for x in (F.lit(str(i)), F.array(*[v.cast("double") for v in c]))])


def _sheet(sheet: Column, i: Column) -> Column:
    """A sheet of the first version: numbered by place, labels and payloads are the frames' names."""
    none = F.lit(None)
    frame = lambda k, v: F.struct(v["bbox"].alias("bbox"), none.cast("int").alias("celda"), F.coalesce(v["archivo_original"], k).alias("archivo_original"), none.cast("array<bigint>").alias("orig_px"), k.alias("etiqueta"))
    code = lambda k, v: F.struct(v["bbox"].alias("bbox"), none.cast("int").alias("celda"), k.alias("texto"), none.cast("string").alias("etiqueta"))
    named = F.concat(F.lit("hoja_"), F.when(i < 999, F.lpad((i + 1).cast("string"), 3, "0")).otherwise((i + 1).cast("string")), F.lit(".tif"))
    return F.struct(
        (i + 1).cast("long").alias("numero"),
        F.coalesce(sheet["archivo_hoja"], named).alias("archivo_hoja"),
        F.coalesce(F.transform_values(sheet["frames"], frame), F.create_map().cast(f"map<string,{_FRAME}>")).alias("frames"),
        F.coalesce(F.transform_values(sheet["qrs"], code), F.create_map().cast(f"map<string,{_CODE}>")).alias("qrs"),
    )


def upgraded(docs: DataFrame, text: str, app: str | None = None) -> DataFrame:
    """Adds doc: the fields known here as a struct of the second version, whichever version the document was written in, and document: its text.

    A document without version is of the first; app is what an upgraded one names as its writer. The text of one of
    the second version comes back unchanged, with fields not known here; an upgraded one is written anew. Text that
    is null or no JSON object gives nulls.
    """
    d, old = F.col("_d"), F.coalesce(F.col("_d.version"), F.lit(1)) < 2
    w, h = (F.coalesce(d["lienzo"][k], F.lit(n)) for k, n in (("ancho_px", WIDTH), ("alto_px", HEIGHT)))
    either = lambda new, field: F.when(old, new).otherwise(d[field]).alias(field)
    lienzo = F.struct(
        F.when(old, w).otherwise(d["lienzo"]["ancho_px"]).alias("ancho_px"),
        F.when(old, h).otherwise(d["lienzo"]["alto_px"]).alias("alto_px"),
        F.when(old, F.coalesce(d["lienzo"]["ppi"], F.lit(DPI))).otherwise(d["lienzo"]["dpi"]).cast("long").alias("dpi"),
        F.when(old, F.coalesce(d["lienzo"]["orientacion"], F.lit("portrait"))).otherwise(d["lienzo"]["orientacion"]).alias("orientacion"),
    )
    markers = F.struct(F.lit("DICT_4X4_50").alias("dict"), F.lit(4).alias("cantidad"), F.lit(SIDE).alias("lado_px"), _marker_boxes(w, h).alias("bboxes"))
    sheets = F.coalesce(F.transform(d["hojas"], _sheet), F.array().cast(f"array<struct<numero:bigint,archivo_hoja:string,frames:map<string,{_FRAME}>,qrs:map<string,{_CODE}>>>"))
    whole = F.struct(
        F.when(old, F.lit(2).cast("long")).otherwise(d["version"]).alias("version"),
        either(F.lit(app).cast("string"), "app"), either(F.lit(""), "proyecto"), either(F.lit("normal"), "modo"), either(F.lit(False), "espejado"),
        lienzo.alias("lienzo"), either(markers, "marcadores"), either(sheets, "hojas"),
        either(F.array().cast("array<struct<pos:int,etiqueta:string,rep:string>>"), "timeline"),
        either(F.lit(None).cast("string"), "originales_dir"),
    )
    usable = F.startswith(F.ltrim(F.col(text)), F.lit("{")) & F.try_parse_json(F.col(text)).isNotNull()
    return docs.withColumn("_d", F.from_json(F.col(text), _SCHEMA)).withColumn("doc", F.when(usable, whole)).withColumn("document", F.when(usable, F.when(old, F.to_json("doc")).otherwise(F.col(text)))).drop("_d")


def frames(docs: DataFrame, *keys: str, doc: str = "doc") -> DataFrame:
    """A row for each frame of each sheet: keys, numero, archivo_hoja, name, etiqueta, archivo_original and the box's corners.

    A box that is not four numbers gives null corners.
    """
    rows = docs.select(*keys, F.explode(f"{doc}.hojas").alias("s")).select(*keys, "s.numero", "s.archivo_hoja", F.explode("s.frames").alias("name", "f"))
    box = F.when((F.size("f.bbox") == 4) & ~F.exists("f.bbox", lambda v: v.isNull()), F.col("f.bbox"))
    return rows.select(*keys, "numero", "archivo_hoja", "name", "f.etiqueta", "f.archivo_original", *[box[i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])

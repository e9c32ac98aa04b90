"""PDF documents of any number of pages from tables of compressed pictures: objects, page tree and cross references placed before they are written."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.operators import placing
from sparkreel.operators.archives import file_name
from sparkreel.sources import segments
from sparkreel.sources.archive import Ranged

#: Fixed by the format: what a file begins with, the largest offset of ten digits.
HEADER, FURTHEST = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n", 9_999_999_999
#: Objects of the catalog, the page tree and the first page.
CATALOG, TREE, FIRST = 1, 2, 3


def text(*parts: Column | str) -> Column:
    return F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), "UTF-8")


def _object(number: Column | int, *body: Column) -> Column:
    return F.concat(text(F.lit(number) if isinstance(number, int) else number, " 0 obj\n"), *body, F.lit(b"\nendobj\n"))


def _stream(dictionary: Column, data: Column) -> Column:
    return F.concat(dictionary, text(" /Length ", F.octet_length(data), " >>\nstream\n"), data, F.lit(b"\nendstream"))


def page_objects(i: Column, w: Column, h: Column, bits: Column, stream: Column, predicted: Column, dpi: float) -> tuple[Column, Column, Column]:
    """The three objects of page i (from 0): picture, drawing, page. predicted: the stream's rows begin with a PNG filter's number."""
    size = lambda n: F.format_string("%.2f", n.cast("double") * 72.0 / dpi)
    image, name = i * 3 + FIRST, F.concat(F.lit("/Im"), i.cast("string"))
    parms = F.when(predicted, F.concat(F.lit(" /DecodeParms << /Predictor 15 /Colors 3 /BitsPerComponent "), bits.cast("string"), F.lit(" /Columns "), w.cast("string"), F.lit(" >>"))).otherwise("")
    picture = _stream(text("<< /Type /XObject /Subtype /Image /Width ", w, " /Height ", h, " /ColorSpace /DeviceRGB /BitsPerComponent ", bits, " /Filter /FlateDecode", parms), stream)
    drawing = _stream(text("<<"), text("q\n", size(w), " 0 0 ", size(h), " 0 0 cm\n", name, " Do\nQ\n"))
    page = text("<< /Type /Page /Parent 2 0 R /MediaBox [0 0 ", size(w), " ", size(h), "] /Resources << /XObject << ", name, " ", image, " 0 R >> >> /Contents ", image + 1, " 0 R >>")
    return _object(image, picture), _object(image + 1, drawing), _object(image + 2, page)


def write_documents(pages: DataFrame, doc: str, order: str, dpi: float, path: str, stream: str = "stream") -> DataFrame:
    """Writes path/<doc>.pdf for every document and returns (doc, order, i, at) of its pages as placed.

    pages: (doc, order, w, h, bits, stream, predicted): RGB rows of 8 or 16 bits compressed by deflate, one picture a
    page in this order. A file whose cross references would begin past ten digits is an error.
    """
    numbered = placing.placed(pages.select(doc, order, "w", "h", "bits", "predicted", F.octet_length(stream).cast("long").alias("_n")), doc, [order], {"i": (F.lit(1).cast("long"), F.lit(0))})
    blank = F.lit(b"")  # lengths without the streams themselves
    short = sum(F.octet_length(o) for o in page_objects(F.col("i"), F.col("w"), F.col("h"), F.col("bits"), blank, F.col("predicted"), dpi))
    size = (short + F.col("_n") + F.length(F.col("_n").cast("string")) - 1).cast("long")
    kid = F.concat(F.when(F.col("i") > 0, " ").otherwise(""), (F.col("i") * 3 + FIRST + 2).cast("string"), F.lit(" 0 R"))
    at = placing.placed(numbered, doc, [order], {"at": (size, F.lit(len(HEADER))), "kid_at": (F.length(kid).cast("long"), F.lit(0))}).withColumn("_size", size)
    file = file_name(doc, ".pdf").alias("file")
    rows = pages.join(at.select(doc, order, "i", "at"), [doc, order])
    objects = page_objects(F.col("i"), F.col("w"), F.col("h"), F.col("bits"), F.col(stream), F.col("predicted"), dpi)
    bodies = rows.select(file, "at", F.concat(*objects).alias("data"))

    ends = at.groupBy(doc).agg(F.count("*").alias("pages"), (F.max(F.col("at") + F.col("_size"))).alias("tree_at"), F.max(F.col("kid_at") + F.length(kid)).alias("kids"))
    ends = ends.withColumn("_head", text(F.lit(TREE), " 0 obj\n<< /Type /Pages /Kids [")).withColumn("_foot", F.concat(text("] /Count ", F.col("pages"), " >>"), F.lit(b"\nendobj\n")))
    ends = ends.withColumn("_catalog", _object(CATALOG, text("<< /Type /Catalog /Pages 2 0 R >>")))
    ends = ends.withColumn("kids_at", F.col("tree_at") + F.octet_length("_head")).withColumn("catalog_at", F.col("kids_at") + F.col("kids") + F.octet_length("_foot"))
    ends = ends.withColumn("xref_at", F.col("catalog_at") + F.octet_length("_catalog"))
    ends = ends.withColumn("xref_at", F.when(F.col("xref_at") > FURTHEST, F.raise_error(F.concat(F.lit("a PDF can't point past 9.3 GB: "), F.col(doc).cast("string")))).otherwise(F.col("xref_at")).cast("long"))
    count = F.col("pages") * 3 + FIRST
    ends = ends.withColumn("_table", text("xref\n0 ", count, "\n0000000000 65535 f \n")).withColumn("lines_at", F.col("xref_at") + F.octet_length("_table"))
    line = lambda offset: text(F.lpad(offset.cast("string"), 10, "0"), " 00000 n \n")
    single = F.array(
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(HEADER).alias("data")),
        F.struct(F.col("tree_at").alias("at"), F.col("_head").alias("data")),
        F.struct((F.col("kids_at") + F.col("kids")).alias("at"), F.concat("_foot", "_catalog", "_table", line(F.col("catalog_at")), line(F.col("tree_at"))).alias("data")),
        F.struct((F.col("lines_at") + 20 * (count - 1)).alias("at"), text("trailer\n<< /Size ", count, " /Root 1 0 R >>\nstartxref\n", F.col("xref_at"), "\n%%EOF\n").alias("data")),
    )
    small = ends.select(file, F.explode(single).alias("s")).select("file", "s.at", "s.data")
    listed = rows.join(ends.select(doc, "kids_at", "lines_at"), doc)
    kids = at.join(ends.select(doc, "kids_at"), doc).select(file, (F.col("kids_at") + F.col("kid_at")).alias("at"), F.encode(kid, "UTF-8").alias("data"))
    first, second = F.octet_length(objects[0]), F.octet_length(objects[1])
    lines = listed.select(file, (F.col("lines_at") + 20 * (F.col("i") * 3 + 2)).alias("at"), F.concat(line(F.col("at")), line(F.col("at") + first), line(F.col("at") + first + second)).alias("data"))
    segments.written(bodies, small.unionByName(kids).unionByName(lines), path)
    return at.select(doc, order, "i", "at")


_FOUND = "file string, object long, at long, head string"


def references(paths: DataFrame, path: str) -> DataFrame:
    """(file, object, at, head) of written documents: each cross reference and the line that stands there; only these ranges are read."""

    def run(batches):
        for pdf in batches:
            for name in pdf[path]:
                file = Ranged(name)
                last = file.at(max(0, file.size - 64), min(64, file.size))
                xref = int(re.search(rb"startxref\s+(\d+)", last)[1])
                head = file.at(xref, min(64, file.size - xref))
                m = re.match(rb"xref\n0 (\d+)\n", head)
                count, at = int(m[1]), xref + m.end()
                for a in range(0, count, 4096):
                    lines = file.at(at + 20 * a, 20 * min(4096, count - a))
                    rows = [(name, a + i, int(lines[20 * i : 20 * i + 10])) for i in range(len(lines) // 20) if lines[20 * i + 17 : 20 * i + 18] == b"n"]
                    yield pd.DataFrame([(f, o, p, file.at(p, min(32, file.size - p)).split(b"\n")[0].decode("latin-1")) for f, o, p in rows], columns=["file", "object", "at", "head"])

    return paths.select(path).mapInPandas(run, _FOUND)

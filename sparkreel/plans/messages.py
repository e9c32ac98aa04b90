"""Queries over translated messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkreel.operators import translation
from sparkreel.plans.base import query
from sparkreel.session import table

L = F.lit

EXACT = [("Ready", "Listo"), ("No marker found", "Sin marcadores"), ("blue ink", "tinta azul")]
TEMPLATES = [("{#0} frames in {1}", "{#0} fotogramas en {1}"), ("Preset “{0}” saved", "Ajuste “{0}” guardado"), ("{0} saved", "{0}: guardado"), ("{0} against {0}", "{0} consigo"), ("Scan {#0}: {1}", "Escaneo {#0}: {1}")]

_NAME = "case p_partkey % 3 when 0 then 'blue ink' when 1 then 'b7.png' else p_brand end"
_SAID = "case p_partkey % 3 when 0 then 'tinta azul' when 1 then 'b7.png' else p_brand end"


@query(f"""with p as (select p_partkey, p_size, p_brand, {_NAME} name, {_SAID} said from part)
select p_partkey, case p_partkey % 8 when 0 then p_size || ' fotogramas en ' || said when 1 then 'Ajuste “' || name || '” guardado' when 2 then said || ': guardado' when 3 then 'Listo · 12 · Sin marcadores' when 4 then ' Listo ' when 5 then 'Escaneo ' || p_size || ': ' || said || ': guardado'
  when 6 then case when p_size % 2 = 0 then said || ' consigo' end else 'Sin marcadores Listo' end as translation from p where p_partkey % 8 <> 6 or p_size % 2 = 0
union all select p_partkey, null from part where p_partkey % 8 = 6 and p_size % 2 > 0""".replace("'Sin marcadores Listo'", "'Listo. Sin marcadores'"))
def translated_messages(spark, d):
    """Messages by whole entries, templates with text, number, quoted and repeated holes, pieces and sentences."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(k % 3 == 0, "blue ink").when(k % 3 == 1, "b7.png").otherwise(F.col("p_brand"))
    text = (
        F.when(k % 8 == 0, F.concat(s, L("  frames in "), name)).when(k % 8 == 1, F.concat(L("Preset “"), name, L("” saved"))).when(k % 8 == 2, F.concat(name, L(" saved")))
        .when(k % 8 == 3, "Ready · 12 · No marker found").when(k % 8 == 4, " Ready ").when(k % 8 == 5, F.concat(L("Scan "), s, L(": "), name, L(" saved")))
        .when(k % 8 == 6, F.concat(name, L(" against "), F.when(F.col("p_size") % 2 == 0, name).otherwise("another"))).otherwise("Ready. No marker found")
    )
    exact = spark.createDataFrame([*EXACT, ("Ready.", "Listo.")], "source string, target string")
    shapes = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "ord int, source string, target string")
    return translation.translated(table(spark, d, "part").select("p_partkey", text.alias("text")), "text", exact, shapes).select("p_partkey", "translation")

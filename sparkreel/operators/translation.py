"""Messages translated by a dictionary: each distinct text once, joined back to all its rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreel.functions.phrases import Phrases

#: Entries of a dictionary at most: it goes to every task.
ENTRIES = 100_000


def translated(texts: DataFrame, text: str, exact: DataFrame, templates: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Adds `translation` to rows with a text, null where the dictionary has nothing for it, and for a null text.

    exact: (source, target); templates: (ord, source, target), tried by literal characters and then by ord. Only
    templates that share a whole word with a text are tried on it. A dictionary of more than ENTRIES entries is an error.
    """
    whole = exact.select("source", "target").limit(ENTRIES + 1).collect()
    shapes = templates.orderBy("ord").select("source", "target").limit(ENTRIES + 1).collect()
    if len(whole) + len(shapes) > ENTRIES:
        raise ValueError(f"a dictionary has at most {ENTRIES} entries")
    given = [tuple(r) for r in whole], [tuple(r) for r in shapes]

    def run(batches):
        phrases = Phrases(*given, ignored)
        for pdf in batches:
            yield pdf.assign(translation=[phrases.translated(t) for t in pdf["_text"]])

    found = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct().mapInPandas(run, "_text string, translation string")
    return texts.join(found.withColumnRenamed("_text", text), text, "left")

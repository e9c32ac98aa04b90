"""Every rule of translated messages."""

import time

import pytest

from sparkreel.functions.phrases import Phrases
from sparkreel.operators import translation

EXACT = [("Ready", "Listo"), ("the  sheet", "la hoja"), ("Stop.", "Alto."), ("Go on.", "Sigue."), ("e.g.", "p. ej.")]
TEMPLATES = [("Open {0}", "Abre {0}"), ("Open {0} now", "Abre {0} ya"), ("{#0} of {#1}", "{#1}, {#0}"), ("Preset “{0}” saved", "Ajuste “{0}” guardado"), ("{0} is {0}", "{0} es igual"), ("({0})", "[{0}]"), ("Page {#0}: {1}", "Pág. {0}: {1}"), ("as {0} as", "tan {1}{0}")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ready", "Listo"), ("  Ready\n", "  Listo\n"), ("the sheet", "la hoja"), ("unknown words", None), ("", None),
        ("Open the sheet", "Abre la hoja"), ("Open the sheet now", "Abre la hoja ya"), ("Open file.png", "Abre file.png"),  # the longer template first; names stay
        ("3 of 1,204", "1,204, 3"), ("three of 4", None), ("-2.5 of 7", "7, -2.5"),  # numbers only
        ("Preset “the sheet” saved", "Ajuste “the sheet” guardado"),  # quoted holes are names
        ("Ready is Ready", "Listo es igual"), ("Ready is not", None),  # the same hole twice
        ("(((((Ready)))))", "[[[[(Ready)]]]]"),  # translated three deep
        ("Page 7: Open the sheet", "Pág. 7: Abre la hoja"), ("as Ready as", "tan Listo"),
        ("Ready · 12 · the sheet", "Listo · 12 · la hoja"), ("Ready; unknown words", None), ("Ready / the sheet; Ready", "Listo / la hoja; Listo"),
        ("Stop. Go on.", "Alto. Sigue."), ("Stop. What", None), ("Open a.b.c; Ready", "Abre a.b.c; Ready"),
        ("12 / 13", "12 / 13"), ("e.g.", "p. ej."),
    ],
)
def test_rules(text, want):
    assert Phrases(EXACT, TEMPLATES).translated(text) == want


def test_names_that_are_ignored():
    assert Phrases(EXACT, TEMPLATES, (r"^the ",)).translated("Open the sheet") == "Abre the sheet"


def test_only_templates_with_a_word_of_the_text_are_tried():
    phrases = Phrases([], [(f"word{i} {{0}} there", f"{i} {{0}}") for i in range(5000)])
    assert [t.to for t in phrases.candidates("word77 and word78 there")] == ["77 {0}", "78 {0}"]
    began = time.perf_counter()
    assert phrases.translated("word4999 x1 there") == "4999 x1" and time.perf_counter() - began < 0.5


def test_rows_of_any_kind(spark):
    rows = [(1, "Ready"), (2, "Ready"), (3, None), (4, ""), (5, "Open Ready")]
    table = lambda *x: spark.createDataFrame(list(x), "ord int, source string, target string")
    exact, shapes = table((0, *EXACT[0])), table(*[(i, *t) for i, t in enumerate(TEMPLATES)])
    got = translation.translated(spark.createDataFrame(rows, "id int, text string"), "text", exact, shapes)
    assert sorted((r["id"], r["translation"]) for r in got.collect()) == [(1, "Listo"), (2, "Listo"), (3, None), (4, None), (5, "Abre Listo")]

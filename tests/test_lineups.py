"""Line-ups of each source, on titles and texts of our own."""

import pytest
from pyspark.sql import functions as F

from stagelight.functions import lineups as L


def value(spark, column, **fields):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in fields.items())
    return spark.createDataFrame([tuple(fields.values())], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text, force, words, want",
    [
        ("Mo Ray, The Pines + Kelp", False, True, ["Mo Ray", "The Pines", "Kelp"]), ("Ada and Bo", False, True, ["Ada", "Bo"]), ("Ada and Bo", False, False, ["Ada and Bo"]), ("Ada & Bo", False, True, ["Ada & Bo"]), ("Ada & Bo", True, True, ["Ada", "Bo"]),
        ("Ada & The Bees", True, True, ["Ada & The Bees"]), ("ADA & BO", False, True, ["ADA", "BO"]), ("Ada, DJ, special guests, Bo (solo set)", False, True, ["Ada", "Bo"]), ("Ada | and Bo | TBA", False, True, ["Ada", "Bo"]), ("", False, True, []),
        ("performed by Ada Lim / live", False, True, ["Ada Lim"]), ("Ada and the music of Bo", False, False, ["Ada"]),
    ],
)
def test_split(spark, text, force, words, want):
    assert value(spark, L.split_list(F.col("t"), force, words), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [("with special guests Ada & Bo", ["Ada", "Bo"]), ("Ada & Bo", ["Ada & Bo"]), ("Big Tour with special guests: Kelp, Mo", ["Kelp", "Mo"]), ("w/ Kelp; supports from Mo", ["Kelp", "Mo"]), ("Special guests TBA", []), (None, [])],
)
def test_guests(spark, text, want):
    assert value(spark, L.guests(F.col("t")), t=text) == want


def test_titles(spark):
    title = lambda f, t: value(spark, f(F.col("t")), t=t)
    assert title(L.title_featured, "Night Market ft. Ada, Bo") == ["Ada", "Bo"]
    assert title(L.title_presented, "Some Label presents: Kelp + Mo") == ["Kelp", "Mo"]
    assert title(L.title_trailing_with, "Kelp 'Sea' with Mo & Bo (WA)") == ["Mo", "Bo"]
    assert title(L.title_headliner, "Kelp – Sea Songs album launch") == ["Kelp"] and title(L.title_headliner, 'Kelp "Sea" single launch') == ["Kelp"] and title(L.title_headliner, "A, B 'Sea'") == []
    assert title(L.title_lineup, "Kelp, Mo, Bo") == ["Kelp", "Mo", "Bo"] and title(L.title_lineup, "Kelp, Mo launch party") == []
    assert title(L.tribute_subjects, "A tribute to Kelp & Mo with Bo") == ["Kelp", "Mo"] and title(L.tribute_subjects, "Kelp/Mo tribute night") == ["Kelp", "Mo"]


def test_descriptions(spark):
    lines = ["Welcome", "Full Line Up:", "Kelp (WA)", "Mo Ray", "Doors 7pm", "lineup", "Only One", "ends here.", "Join Ada, Bo, Cy and Di as they play", "Join Ada as they play", "all shows will be supported by Eve, Flo."]
    assert value(spark, L.description_names(F.col("t")), t=lines) == ["Kelp", "Mo Ray", "Ada", "Bo", "Cy", "Di", "Eve", "Flo"]
    assert value(spark, L.lineup_block(F.col("t")), t=["Line Up", "Only One", "Doors"]) == []


def test_orders_and_spellings(spark):
    two = lambda f, names, other: value(spark, f(F.col("n"), F.col("o")), n=names, o=other)
    assert two(L.ordered_by, ["Ada", "Bo"], ["BO", "Ada (WA)"]) == ["Bo", "Ada"] and two(L.ordered_by, ["Ada", "Bo"], ["Bo", "Cy"]) == ["Ada", "Bo"] and two(L.ordered_by, ["Ada", "Bo"], ["Bo", "Ada", "Cy"]) == ["Ada", "Bo"]
    assert two(L.ordered_by_covering, ["Ada", "Bo"], ["Cy", "Bo", "Ada"]) == ["Bo", "Ada"] and two(L.ordered_by_covering, ["Ada", "Bo"], ["Cy", "Bo"]) == ["Ada", "Bo"]
    assert two(L.first_by_title, ["Cy", "Ada", "Bo"], "Bo + Ada World Tour") == ["Bo", "Ada", "Cy"] and two(L.first_by_title, ["Cy", "Ada"], "Bo + Ada") == ["Cy", "Ada"]
    assert two(L.coalesce_band_names, ["Cy", "Bees", "Ada"], "Ada and the Bees + Cy") == ["Cy", "Ada and the Bees"]
    assert two(L.without_title_aliases, ["Ada", "Ada Band", "Bo"], "Ada Band live") == ["Ada Band", "Bo"]
    assert two(L.names_as_in_title, ["pines", "Kelp", "Mo. (x)"], "The Pines, Kelp Trio and more") == ["The Pines", "Kelp Trio", "Mo. (x)"]
    assert value(spark, L.not_known(F.col("n"), F.col("o")), n=["K3lp", "Ada & Bo", "Cy"], o=["Kelp", "Ada", "Bo"]) == ["Cy"]
    assert value(spark, L.shared_surname(F.col("a"), F.col("b")), a="Ann", b="Bob Lee") == ["Ann Lee", "Bob Lee"]


def test_sources(spark):
    rows = [
        ("Kelp 'Sea' Tour 2024", ["Kelp", "Mo & Bo"], "with special guests Ada & Kelp", ["Line up", "Ada", "Kelp", "Mo & Bo"]), ("A tribute to Kelp", ["Kelp", "Sea Band"], None, []), ("Kelp vs Mo Party", ["Kelp", "Bo"], "", []), ("Kelp, Mo, Bo", [], None, None), ("Quiet night", [], None, []),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, bands array<string>, guests string, lines array<string>")
    got = {r.i: (r.artists, r.artist_kind) for r in L.with_oztix_names(frame, "title", "bands", "guests", "lines").collect()}
    assert got == {0: (["Ada", "Kelp", "Mo & Bo"], "structured"), 1: (["Sea Band"], "structured"), 2: (["Bo"], "structured"), 3: (["Kelp", "Mo", "Bo"], "parsed_text"), 4: ([], "unknown")}
    ticketek = L.ticketek_names(F.col("a"), F.col("b"), F.col("c"))
    assert value(spark, ticketek, a="Ada and Bo presents Sea", b="feat. Cy, Di and more!", c=None) == ["Ada", "Bo", "Cy", "Di"] and value(spark, ticketek, a="Frontier Touring presents Sea", b=None, c="x") == []
    bird = L.bird_names(F.col("a"), F.col("b"), F.col("c"))
    assert value(spark, bird, a="Ada, Sea, Bo", b="Headlined by someone aka Cy. Featuring:\nDi, bringing joy\n& Eve on the 1s and 2s all night\nSee you there!", c="Sea") == ["Ada", "Bo", "Cy", "Di", "Eve"]
    assert value(spark, bird, a="Presented by Ada, Bo", b=None, c="x") == []
    milk = L.milk_bar_names(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert value(spark, milk, a=["Sea Band – recreating it all"], b=["Kelp"], c=None, d="x") == ("Sea Band".split("|"), "explicit_lineup")
    assert value(spark, milk, a=["battle between Ada vs Bo."], b=[], c=None, d="x")[0] == ["Ada", "Bo"] and value(spark, milk, a=[], b=["Kelp"], c="with Mo & Bo", d="The Kelp") == (["The Kelp", "Mo", "Bo"], "structured")

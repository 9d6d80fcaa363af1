from datetime import date

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.lemmas import LightFrench, Lookup, LowerCase


def test_accents_and_normal_form():
    assert [X.strip_accents(s) for s in ("café", "éàïü", "plain")] == ["cafe", "eaiu", "plain"]
    assert X.normalize("Café   Théâtre") == "cafe theatre"
    assert X.normalize("  HELLO  WORLD  ") == "hello world"
    assert X.normalize("") == X.normalize(None) == ""
    assert X.normalize("Straße") == "strasse"


def test_tokens_and_entities():
    found = X.tokenize("Le 15/03/2024, 3.14 et Saint-Étienne")
    assert {"15/03/2024", "3.14", "Saint-Étienne"} <= set(found)
    assert X.tokenize("l’eau d'or") == ["l", "eau", "d", "or"]
    assert all(map(X.is_entity_text, ("2024-03-15", "15/03/2024", "3.14")))
    assert not X.is_entity_text("airbus")


def test_distances():
    assert [X.common_prefix_text(*p) for p in (("airbis", "airbus"), ("airbus", "airbus"), ("xyz", "abc"), ("", "a"))] == [4, 6, 0, 0]
    assert [X.edit_distance(*p) for p in (("airbis", "airbus"), ("same", "same"), ("", "abc"), ("abc", ""))] == [1, 0, 3, 3]
    assert X.edit_distance("abcdef", "ghijkl", 2) == 3


def test_dates():
    assert X.parse_day("3 mars 2013") == date(2013, 3, 3)
    assert X.parse_day("4/5/2013") == X.parse_day("4-5-2013") == X.parse_day("4 5 2013") == date(2013, 5, 4)
    assert X.parse_day("31/02/2013") is X.parse_day("3/4-2013") is X.parse_day("3 foo 2013") is None
    assert X.parse_month("février 2012") == (2012, 2)
    assert X.parse_month("13/2012") is None


def test_columns(spark):
    rows = spark.createDataFrame([("airbis", "airbus"), ("", "abc"), ("same", "same")], "a string, b string")
    got = rows.select(X.common_prefix(F.col("a"), F.col("b")).alias("p"), X.normalized(F.col("a")).alias("n")).collect()
    assert [r["p"] for r in got] == [4, 0, 4]
    texts = spark.createDataFrame([("Titre\nun\ndeux",), ("Seul",), ("",)], "t string")
    got = texts.select(X.first_line(F.col("t")).alias("a"), X.other_lines(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("Titre", "un\ndeux"), ("Seul", ""), ("", "")]


@pytest.mark.parametrize("word", ["chevaux", "bateaux", "articles", "Énergies", "os"])
def test_light_french_is_the_same_on_both_sides(spark, word):
    lem = LightFrench()
    got = lem.apply(spark.createDataFrame([(word,)], "surface string")).first()["term"]
    assert got == lem.lemma(word)


def test_lookup(spark):
    table = spark.createDataFrame([("Chevaux", "cheval")], "surface string, lemma string")
    lem = Lookup(table, {"chevaux": "cheval"})
    got = lem.apply(spark.createDataFrame([("CHEVAUX",), ("Vache",)], "surface string")).collect()
    assert sorted(r["term"] for r in got) == ["cheval", "vache"]
    assert lem.lemma("Chevaux") == "cheval"
    assert LowerCase().lemmas("L'Eau!") == ["l", "eau"]

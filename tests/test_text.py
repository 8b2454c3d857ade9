"""Golden vectors of the value functions."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions import text

FIXTURES = (Path(__file__).parents[1] / "FIXTURES.md").read_text()


def vectors(name):
    body = FIXTURES.split(f"### `{name}`")[1].split("\n### ")[0].split("\n## ")[0]
    rows = re.findall(r"^\| \d+ \| `(.*?)` \| `(.*?)` \|$", body, re.M)
    clean = lambda x: "" if x == "(empty)" else x
    return [(clean(a), clean(b)) for a, b in rows]


def results(spark, rows, function):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, v string")
    return [r["out"] for r in function(df).orderBy("i").collect()]


@pytest.mark.parametrize(
    "name, function",
    [
        ("standardizeCapitalization", text.capitalization),
        ("standardizeDateFormat", lambda v: text.date(v, 2023)),
        ("standardizeNumberFormat", text.number),
        ("correctCommonSpellingMistakes", text.spelling),
    ],
)
def test_vectors(spark, name, function):
    rows = vectors(name)
    assert len(rows) > 10
    assert results(spark, rows, lambda df: df.select("i", function(F.col("v")).alias("out"))) == [b for _, b in rows]


def test_corrected(spark):
    rows = vectors("correctCellValue")
    assert results(spark, rows, lambda df: df.select("i", text.correct(F.col("v"), 2023).alias("out"))) == [b for _, b in rows]


def test_clean(spark):
    rows = [("  a  b ", "a b"), ("Été", "Ete"), ("N/A", ""), ("null", ""), ("", ""), (None, ""), ("x^`", "x"), ("\ufeffa", "a"), ("n\u0061\u0308h", "nah")]
    rows += [("\u03ac  \u0439", "\u03b1 \u0438"), ("\u0401\u00e9", "\u0415e"), ("\u1f84", "\u03b1"), ("\ud55c", "\ud55c"), ("\u0438", "\u0438"), ("a\u1fef", "a"), ("\u0ccb", "\u0cc2\u0cd5")]
    assert results(spark, rows, lambda df: df.select("i", text.clean(F.col("v")).alias("out"))) == [b for _, b in rows]


def test_spaces_of_all_kinds(spark):
    rows = [("1\u00a0234,56", "1234.56"), ("1\u202f234\u202f567", "1234567"), ("-1\u00a0234", "-1234"), ("1\u00a0234,5e3", "1234.5e3"), ("\u00a0", "\u00a0"), ("1.2.3", "123"), ("1,2,34", "12.34"), ("+1,5", "+1.5"), (None, None)]
    assert results(spark, rows, lambda df: df.select("i", text.number(F.col("v")).alias("out"))) == [b for _, b in rows]
    rows = [("new\u00a0york city", "New\u00a0york City"), ("good day.\u00a0bad day", "Good day.\u00a0Bad day")]
    assert results(spark, rows, lambda df: df.select("i", text.capitalization(F.col("v")).alias("out"))) == [b for _, b in rows]


def test_values_stay_in_the_jvm(spark):
    plan = spark.createDataFrame([("a",)], "v string").select(text.correct(text.clean(F.col("v")), 2023).alias("out"))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan


def test_spelling_is_one_pass(spark):
    assert results(spark, [("UntillLiason", 0), (None, 0), ("no error", 0), ("A\nLOT of ALOT, Wierd wIERD x", 0)], lambda df: df.select("i", text.spelling(F.col("v")).alias("out"))) == ["UntilLiaison", None, "no error", "A\nLOT of A LOT, Weird weird x"]


def test_uri_functions(spark):
    rows = [("http://www.wikidata.org/entity/Q5", "Wikidata Type Q5"), ("http://dbpedia.org/ontology/SportsEvent", "Sports Event"), ("http://x/HTTPServer", "HTTP Server")]
    assert results(spark, rows, lambda df: df.select("i", text.uri_label(F.col("v"), "Type").alias("out"))) == [b for _, b in rows]
    rows = [("hasCity", "isCityOf"), ("isAuthorOf", "hasAuthor"), ("treats", "treatsInverse")]
    assert results(spark, rows, lambda df: df.select("i", text.inverse_name(F.col("v")).alias("out"))) == [b for _, b in rows]

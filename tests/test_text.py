import pytest
from pyspark.sql import functions as F

from lexirank.functions import text as T
from lexirank.functions.porter import stem
from lexirank.functions.stopwords import english

STEMS = "caresses caress ponies poni ties tie cats cat agreed agre plastered plaster motoring motor sing sing hopping hop falling fall filing file relational relat conditional condit triplicate triplic hopeful hope goodness good adjustment adjust adoption adopt roll roll investments invest happy happi died die spied spi skies sky enjoy enjoy"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_stems():
    words = STEMS.split()
    assert [(w, stem(w)) for w in words[::2]] == list(zip(words[::2], words[1::2], strict=True))


def test_stop_words():
    words = english()
    assert len(words) == 318
    assert {"a", "the", "none", "couldnt"} <= words and not words & {"did", "does", "just"}


@pytest.mark.parametrize(("text", "tokens"), [("Can't STOP", ["stop"]), ("401(k) x", ["401"]), ("Élan m² a_b", ["élan", "m²", "a_b"]), ("", []), (None, []), ("dog dog", ["dog", "dog"]), ("日本語 ок", ["日本語", "ок"])])
def test_tokens(spark, text, tokens):
    assert one(spark, text, T.kept_tokens(F.col("text"))) == tokens


def test_display(spark):
    long = "x" * 400
    assert one(spark, "  \n ", T.title(F.lit("id7"), F.col("text"))) == "id7"
    assert one(spark, " first \nsecond", T.title(F.lit("id7"), F.col("text"))) == "first"
    assert one(spark, long, T.title(F.lit("i"), F.col("text"))) == "x" * 85 + "..."
    assert one(spark, "x" * 88, T.title(F.lit("i"), F.col("text"))) == "x" * 88
    assert one(spark, long, T.snippet(F.col("text"))) == "x" * 277 + "..."
    assert one(spark, long, T.console_snippet(F.col("text"))) == "x" * 300 + "..."
    assert one(spark, None, T.snippet(F.col("text"))) == ""


@pytest.mark.parametrize(("text", "yes"), [("what is it", True), ("Really?", True), ("whatever works", False), ("  can't you", True), ("", False), (None, False), ("it is so", False)])
def test_questions(spark, text, yes):
    assert one(spark, text, T.is_question(F.col("text"))) is yes


def test_segments_are_lossless(spark):
    text = "A b, c!  déjà-vu"
    cut = one(spark, text, T.segments(F.col("text")))
    assert "".join(s["text"] for s in cut) == text
    assert [s["word"] for s in cut[:3]] == [True, False, True]


def test_paragraphs(spark):
    assert one(spark, "a\n\n b \n\n\nc", T.paragraphs(F.col("text"))) == ["a", "b", "c"]
    assert one(spark, "a\nb", T.paragraphs(F.col("text"))) == ["a", "b"]
    assert one(spark, " ", T.paragraphs(F.col("text"))) == ["(Empty document.)"]


def test_fuzzy():
    assert T.fuzzy_score("What", "what is") == 1.0
    assert T.fuzzy_score("", "what") == 0.0
    assert 0 < T.fuzzy_score("whut", "what is") < 1


def test_shown_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in (None, 0.0, 0.1234567, -1.0, 99.99999, 12345.678, -100.5)], "x double")
    assert [r["s"] for r in rows.select(T.shown_number(F.col("x")).alias("s")).collect()] == ["—", "0.000000", "0.123457", "-1.0000", "100.0000", "12345.68", "-100.50"]

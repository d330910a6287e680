"""Text rules and display formats, one table of cases for each."""

import pytest
from pyspark.sql import functions as F

from glosswork.functions import display, text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, want",
    [("a b\u0085c\x1cd　e", "a b c d e"), ("  x \t y ", "x y"), ("", "")],
)
def test_normalize_space(spark, text, want):
    assert one(spark, text, tx.normalize_space) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. Two! Three? four", ["One.", "Two!", "Three?", "four."]),
        ('He said "no." Then', ['He said "no." Then.']),
        ("  ", []),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, tx.sentences) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Teacher's P12 'quoted' café 4-H x2", ["teacher's", "quoted", "caf", "h", "x2"]),
        ("it’s 한국어 참가자 가", ["it", "s", "한국어", "참가자", "가"]),
        ("''' -", []),
    ],
)
def test_words(spark, text, want):
    assert one(spark, text, tx.words) == want
    assert tx.python_words(text, keep_stopwords=True) == want


def test_content_words_and_grams(spark):
    assert one(spark, "the small group of peers helped", tx.content_words) == ["small", "group", "peers", "helped"]
    terms = one(spark, "the small group of peers", tx.vector_terms)
    assert terms == ["small", "group", "peers", "small_group", "group_peers", "small_group_peers"]
    assert one(spark, "the of", tx.vector_terms) == []


def test_match_form_and_alignment(spark):
    assert one(spark, "  ÉCOLE 4-H, ok! ", tx.normalize_for_match) == "cole 4-h ok"
    focus = "teacher perspective accessibility"
    assert one(spark, "Teachers see accessibility.", lambda c: tx.alignment(c, focus)) == pytest.approx(2 / 3)
    assert one(spark, "anything", lambda c: tx.alignment(c, "the")) == 0.0
    assert one(spark, "my teacher", lambda c: tx.focus_augmented(c, "teacher")) == "my teacher teacher teacher"
    assert one(spark, "nothing", lambda c: tx.focus_augmented(c, "teacher")) == "nothing"


def test_display(spark):
    paths = lambda p: one(spark, p, display.file_selection, "array<string>")
    assert [paths([]), paths(["/a/teacher.txt"]), paths(["a", "b", "c"])] == [
        "No transcripts selected", "teacher.txt", "3 transcripts selected"
    ]
    assert one(spark, 3, lambda c: display.status(c, F.lit(42), F.lit(6)), "int") == "3 documents | 42 quote units | 6 themes"
    assert one(
        spark, 0.72, lambda c: display.theme_row(F.lit("Accessibility Support"), F.lit(12), c), "double"
    ) == "Accessibility Support  |  12 quotes  |  72% focus"
    assert one(spark, "no", display.percent) == "0%"
    assert one(spark, 0.725, display.percent, "double") == "72%"
    v = {
        "evidence_count": F.lit(12), "source_count": F.lit(3), "speaker_count": F.lit(7), "central_theme_alignment": F.col("c"),
        "review_status": F.lit("Researcher review required")
    }
    assert one(
        spark, 0.72, lambda c: display.validation_line(v), "double"
    ) == "Evidence 12 | Sources 3 | Speakers 7 | Focus 72% | Researcher review required"
    assert one(spark, 11, display.theme_color, "int") == "#2563eb"

"""Display formats as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lexicon import REVIEW_STATUS, THEME_COLORS


def theme_color(number: Column) -> Column:
    """The colour of theme 1, 2, ...; colours are used in turn."""
    return F.element_at(
        F.array(*[F.lit(c) for c in THEME_COLORS]), (F.pmod(number - 1, F.lit(len(THEME_COLORS))) + 1).cast("int")
    )


def percent(value: Column) -> Column:
    """0..1 as a whole percentage, halves to even; what is no number is 0."""
    number = F.coalesce(value.try_cast("double"), F.lit(0.0))
    number = F.when(F.isnan(number), F.lit(0.0)).otherwise(number)
    return F.concat(
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)) * 100, 0).cast("int").cast("string"), F.lit("%")
    )


def file_selection(paths: Column) -> Column:
    """Of an array of paths."""
    n = F.size(paths)
    name = F.element_at(F.split(F.element_at(paths, 1), "/"), -1)
    return F.when(n == 1, name).when(
        n > 1, F.concat(n.cast("string"), F.lit(" transcripts selected"))
    ).otherwise("No transcripts selected")


def status(documents: Column, quotes: Column, themes: Column) -> Column:
    return F.format_string("%d documents | %d quote units | %d themes", documents, quotes, themes)


def theme_row(name: Column, quote_count: Column, focus: Column) -> Column:
    return F.concat(name, F.lit("  |  "), quote_count.cast("string"), F.lit(" quotes  |  "), percent(focus), F.lit(" focus"))


def validation_line(v) -> Column:
    """For the screen; v gives the fields of a validation struct (or columns) by name."""
    text = F.concat(
        F.lit("Evidence "), v[
            "evidence_count"
        ].cast("string"), F.lit(" | Sources "), v["source_count"].cast("string"), F.lit(" | Speakers "),
        v["speaker_count"].cast("string"), F.lit(" | Focus "), percent(
            v["central_theme_alignment"]
        ), F.lit(" | "), v["review_status"],
    )
    return F.coalesce(text, F.lit(REVIEW_STATUS))


def validation_text(v) -> Column:
    """For reports; v as in validation_line."""
    text = F.concat(
        F.lit("evidence="), v[
            "evidence_count"
        ].cast("string"), F.lit(", sources="), v["source_count"].cast("string"), F.lit(", speakers="),
        v["speaker_count"].cast("string"), F.lit(", central alignment="), v[
            "central_theme_alignment"
        ].cast("string"), F.lit(", status="), v["review_status"],
    )
    return F.coalesce(text, F.lit(REVIEW_STATUS))

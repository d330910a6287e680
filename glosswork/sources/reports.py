"""Reports of results: Markdown, JSON and CSV, built by Column functions from the result rows."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import display, lexicon


def _f3(c: Column) -> Column:
    return F.format_string("%.3f", c)


def _lines(*items) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in items])


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _each(array, f) -> Column:
    return F.flatten(F.transform(array, f))


def markdown_array() -> Column:
    """The lines of a result's report, in order."""
    themes = F.col("themes")
    none = F.array().cast("array<string>")

    def mark(t):
        return _text("[", t["id"], " ", t["color"], "] ")

    def quote(t):
        return lambda q: _lines(
            _text("> ", q["text"]), "",
            _text(
                "- ", mark(t), "Speaker: ", q["speaker"], " | Quote ID: ", q["quote_id"], " | Source: ", q["source_name"],
                " | Line: ", q["source_line"].cast("string"), " | Relevance: ", _f3(q["relevance"])
            ),
            "",
        )

    def theme(t, i):
        words = F.array_join(t["keywords"], ", ")
        head = _lines(
            _text("## Theme ", (i + 1).cast("string"), ": ", t["name"]), "",
            _text("- Theme ID: ", t["id"]),
            _text("- Theme color: ", t["color"]),
            _text("- Quote units in theme: ", t["quote_count"].cast("string")),
            _text("- Cohesion score: ", _f3(t["score"])),
            _text("- Keywords: ", F.when(words != "", words).otherwise("None")),
            _text("- Validation: ", display.validation_text(t["validation"])),
            "", "### Quote Evidence", "",
        )
        return F.concat(head, _each(t["quotes"], quote(t)))

    def coded(t):
        return _each(
            t["quotes"],
            lambda q: _lines(
                _text(
                    "- ", mark(t), "Source: ", q["source_name"], " | Line: ", q["source_line"].cast("string"), " | Speaker: ",
                    q["speaker"], " | Quote ID: ", q["quote_id"]
                ),
                _text("  > ", q["text"]),
            ),
        )

    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    checks = F.when(F.size("validation_summary") > 0, bullets("validation_summary")).otherwise(
        _lines("- Researcher review required before using suggested themes as findings.")
    )
    evidence = F.concat(_lines("## Color-Coded Transcript Evidence", ""), _each(themes, coded), _lines(""))
    return F.concat(
        _lines(
            "# Qualitative Thematic Coding Report", "", _text("Generated with Glosswork v", F.col("version"), "."), "",
            "## Researcher review required", "", lexicon.REPORT_WARNING, ""
        ),
        _lines(
            "## Summary", "", _text(
                "- Documents analyzed: ", F.col("document_count").cast("string")
            ), _text("- Quote units analyzed: ", F.col("quote_count").cast("string")),
            _text("- Suggested themes: ", F.size(themes).cast("string")), "", "## Validation Framework", "",
        ),
        checks, _lines(""),
        _each(themes, theme),
        F.when(F.size(themes) > 0, evidence).otherwise(none),
        F.when(F.size("notes") > 0, F.concat(_lines("## Notes", ""), bullets("notes"), _lines(""))).otherwise(none),
    )


def markdown_lines(result: DataFrame) -> DataFrame:
    """(corpus_id, line_no, line)"""
    rows = result.select("corpus_id", F.posexplode(markdown_array()).alias("p", "line"))
    return rows.select("corpus_id", (F.col("p") + 1).alias("line_no"), "line")


def markdown(result: DataFrame) -> DataFrame:
    """(corpus_id, report)"""
    return result.select(
        "corpus_id",
        F.concat(F.rtrim(F.regexp_replace(F.array_join(markdown_array(), "\n"), r"\s+$", "")), F.lit("\n")).alias("report")
    )


RECORD = ["version", "document_count", "quote_count", "themes", "notes", "validation_summary"]


def _indented(value: Column, kind: T.DataType, depth: int = 0) -> Column:
    """JSON of a value, two spaces a level, a space after colons, other scripts as they are."""
    line = F.lit("\n" + "  " * (depth + 1))
    end = F.lit("\n" + "  " * depth)
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            comma = [F.lit(",")] if parts else []
            parts += [*comma, line, F.lit(f'"{f.name}": '), _indented(value[f.name], f.dataType, depth + 1)]
        out = F.concat(F.lit("{"), *parts, end, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: F.concat(line, _indented(x, kind.elementType, depth + 1)))
        out = F.when(F.size(value) == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(items, ","), end, F.lit("]")))
    elif isinstance(kind, T.StringType):
        out = F.regexp_replace(F.to_json(F.array(value)), r"(?s)^\[|\]$", "")
    else:
        out = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(out)


def json_text(result: DataFrame) -> DataFrame:
    """(corpus_id, report): the whole result, indented, other scripts as they are."""
    record = result.select("corpus_id", F.struct(*RECORD).alias("r"))
    return record.select("corpus_id", F.concat(_indented(F.col("r"), record.schema["r"].dataType), F.lit("\n")).alias("report"))


def csv_rows(result: DataFrame) -> DataFrame:
    """One row for each shown quote of each theme, in report order; corpus_id and row_no come first."""
    t = result.select("corpus_id", F.posexplode("themes").alias("p", "t")).select("*", F.posexplode("t.quotes").alias("k", "q"))
    return t.select(
        "corpus_id", "p", "k", F.col("t.id").alias("theme_id"), F.col("t.name").alias("theme_name"), F.array_join(
            "t.keywords", "; "
        ).alias("theme_keywords"), F.col("t.color").alias("theme_color"),
        "q.quote_id", "q.speaker", F.col("q.source_name").alias("source_file"), "q.source_line", _f3(
            F.col("q.relevance")
        ).alias("relevance"), F.col("q.text").alias("quote"),
        F.col("t.validation.review_status").alias("validation_review_status"),
    )


CSV_COLUMNS = [
    "theme_id", "theme_name", "theme_keywords", "theme_color", "quote_id", "speaker", "source_file", "source_line", "relevance",
    "quote", "validation_review_status"
]


def _csv_line() -> Column:
    def cell(c):
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))  # a null is an empty cell
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *[cell(c) for c in CSV_COLUMNS])


def csv_lines(result: DataFrame) -> DataFrame:
    """(corpus_id, line_no, line): each corpus's header, then its rows; a line may hold line ends of a cell."""
    head = result.select("corpus_id", F.lit(-1).alias("p"), F.lit(-1).alias("k"), F.lit(",".join(CSV_COLUMNS)).alias("line"))
    rows = head.unionByName(csv_rows(result).select("corpus_id", "p", "k", _csv_line().alias("line")))
    place = F.struct("p", "k")
    return rows.select("corpus_id", place.alias("line_no"), "line")


def csv_text(result: DataFrame) -> DataFrame:
    """(corpus_id, report): header and rows, quoted where needed, quotes doubled."""
    rows = csv_rows(result).select("corpus_id", F.struct("p", "k", _csv_line().alias("line")).alias("r"))
    rows = rows.groupBy("corpus_id").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]).alias("lines"))
    all_ = result.select("corpus_id").join(rows, "corpus_id", "left")
    lines = F.concat(F.array(F.lit(",".join(CSV_COLUMNS))), F.coalesce("lines", F.array().cast("array<string>")))
    return all_.select("corpus_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("report"))


def write_csv(result: DataFrame, path: str) -> None:
    """The rows of all corpora as a distributed CSV table."""
    csv_rows(result).drop("p", "k").write.option("header", True).option("escape", '"').csv(path, mode="overwrite")


FORMATS = {"markdown": markdown, "json": json_text, "csv": csv_text}
SUFFIXES = {".csv": "csv", ".json": "json"}


def save(result: DataFrame, path: str, fmt: str | None = None) -> None:
    """Reports as local files; without a format the suffix decides.

    A single corpus is written to path; of several, each to a file of its own, with its number
    (in order of corpus_id) before the suffix.  Reports come to the driver one at a time.
    """
    stem, suffix = os.path.splitext(path)
    fmt = fmt or SUFFIXES.get(suffix.lower(), "markdown")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows = FORMATS[fmt](result)
    several = len(rows.take(2)) > 1
    for k, row in enumerate(rows.orderBy("corpus_id").toLocalIterator(), 1):
        with open(f"{stem}-{k}{suffix}" if several else path, "w", encoding="utf-8", newline="\n") as f:
            f.write(row.report)

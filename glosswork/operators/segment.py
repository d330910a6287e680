"""From documents to quote units.

documents: corpus_id, doc_pos, source_name, text.  Everything up to the quotes of a document is
computed within its row, without a shuffle; only the running numbers of a corpus need one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import stages
from ..functions import text as tx

UNKNOWN = "Unknown"


def not_blank(documents: DataFrame) -> DataFrame:
    """Documents with any character that is no white space."""
    return stages.spread(documents).where(tx.filled(F.col("text")))


def _lines(text):
    return F.transform(F.split(text, tx.LINE_END), tx.strip)


def segment_array(text):
    """Speaker turns of a text: array of (speaker, text, source_line).

    A turn starts at a labelled line, at the first line and after a blank line; other lines go on
    with it.  source_line counts all lines from 1.
    """
    lines = _lines(text)

    def build(all_lines):
        at = lambda i: F.element_at(all_lines, i)
        start = F.filter(
            F.sequence(F.lit(1), F.size(all_lines)),
            lambda i: (at(i) != "") & (
                (i == 1) | (at(F.greatest(i - 1, F.lit(1))) == "") | (F.contains(at(i), F.lit(":")) & at(i).rlike(tx.SPEAKER))
            ),
        )

        return tx.bound(start, lambda starts: turns(all_lines, starts))

    def turns(all_lines, start):
        at = lambda i: F.element_at(all_lines, i)

        def turn(i, k):
            after = F.coalesce(F.get(start, k + 1), F.size(all_lines) + 1)
            said = F.regexp_extract(at(i), tx.SPEAKER, 2)
            first = F.when(said != "", said).otherwise(at(i))
            rest = F.filter(F.slice(all_lines, i + 1, after - i - 1), lambda x: x != "")
            speaker = tx.strip(F.regexp_extract(at(i), tx.SPEAKER, 1))
            return F.struct(
                F.when(speaker != "", speaker).otherwise(F.lit(UNKNOWN)).alias("speaker"),
                tx.normalize_space(F.array_join(F.concat(F.array(first), rest), " ")).alias("text"),
                i.alias("source_line"),
            )

        return F.filter(F.transform(start, turn), lambda s: s["text"] != "")

    return tx.bound(lines, build)


def segments(documents: DataFrame) -> DataFrame:
    """(corpus_id, doc_pos, source_name, seg_pos, speaker, text, source_line)"""
    out = not_blank(documents).select(
        "corpus_id", "doc_pos", "source_name", F.posexplode(segment_array(F.col("text"))).alias("p", "s")
    )
    return out.select(
        "corpus_id", "doc_pos", "source_name", (F.col("p") + 1).alias("seg_pos"), "s.speaker", "s.text", "s.source_line"
    )


def sentence_units(segs: DataFrame) -> DataFrame:
    """One row per sentence of each segment, with sent_pos and word_count."""
    out = segs.select("*", F.posexplode(tx.sentences(F.col("text"))).alias("p", "sentence")).drop("text")
    out = out.withColumn("sent_pos", F.col("p") + 1).withColumnRenamed("sentence", "text").drop("p")
    return out.withColumn("word_count", tx.word_count(F.col("text")))


def quote_array(text, min_quote_words: int = 4):
    """Quotes of a text: array of (seg_pos, speaker, text, source_line, word_count)."""

    def of_segment(s, k):
        def quote(x):
            return F.struct(
                (k + 1).alias("seg_pos"), s["speaker"].alias("speaker"), x.alias("text"), s["source_line"].alias("source_line"),
                tx.word_count(x).alias("word_count")
            )

        return F.transform(tx.sentences(s["text"]), quote)

    return F.filter(F.flatten(F.transform(segment_array(text), of_segment)), lambda q: q["word_count"] >= min_quote_words)


def unnumbered_quotes(documents: DataFrame, min_quote_words: int = 4) -> DataFrame:
    """Sentences of enough words, without running numbers: one scan, no shuffle."""
    # outer: else a filter on the whole array is inferred and pushed below, and evaluated again
    rows = not_blank(documents).select(
        "corpus_id", "doc_pos", "source_name", F.explode_outer(quote_array(F.col("text"), min_quote_words)).alias("q")
    )
    return rows.where("q is not null").select("corpus_id", "doc_pos", "source_name", "q.*")


#: Documents whose numbers are summed in one task: those with equal doc_pos div RUN; runs are
#: summed by RUN in turn.
RUN = 4096


def parsed(documents: DataFrame, min_quote_words: int = 4) -> DataFrame:
    """The documents' columns but text, with row (a number of their own), filled (whether not blank), quotes
    and n, their count: a table, as texts are parsed once."""
    return _counted(stages.write(_parsed(stages.spread(documents), min_quote_words)))


def parsed_in_place(documents: DataFrame, min_quote_words: int = 4) -> DataFrame:
    """parsed() where the documents are: no table, so texts are parsed again by each that reads it."""
    return _counted(_parsed(documents, min_quote_words))


def _parsed(documents: DataFrame, min_quote_words: int) -> DataFrame:
    # row: also keeps filters on the quotes from being pushed below, where texts would be parsed again for them
    return documents.withColumns(
        {
            "row": F.monotonically_increasing_id(), "filled": tx.filled(F.col("text")), "content": F.xxhash64("text"),
            "quotes": quote_array(F.coalesce("text", F.lit("")), min_quote_words)
        }
    ).drop("text")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n", F.size("quotes").cast("long"))


def numbered(docs: DataFrame) -> DataFrame:
    """The quotes of parsed documents, numbered through each corpus.

    A quote's number is the count in earlier runs of documents, plus that in earlier documents of
    the run, plus its place in its document.  These sums need the counts only, a narrow row for each
    document, and no task sums a whole corpus; then each document learns where it begins.  Documents of
    equal position are taken by name, then by content; a null corpus or position is one like any
    other, nulls first.
    """
    before = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    run = F.floor(F.col("doc_pos") / RUN).alias("run")
    counts = docs.where("n > 0").select("corpus_id", run, "doc_pos", "source_name", "content", "row", "n")
    counts = counts.repartition("corpus_id", "run")
    runs = counts.groupBy("corpus_id", "run").agg(F.sum("n").alias("n")).withColumn("part", F.floor(F.col("run") / RUN))
    # a row for each run, then for each 4096 runs
    parts = runs.groupBy("corpus_id", "part").agg(F.sum("n").alias("n"))
    parts = parts.select(
        F.col("corpus_id").alias("c"), F.col("part").alias("p"),
        so_far("n", before("corpus_id").orderBy("part")).alias("parts_before")
    )
    runs = runs.withColumn("runs_before", so_far("n", before("corpus_id", "part").orderBy("run")))
    runs = runs.join(parts, F.col("corpus_id").eqNullSafe(F.col("c")) & F.col("part").eqNullSafe(F.col("p")))
    runs = runs.select(
        F.col("corpus_id").alias("c"), F.col("run").alias("r"), (F.col("parts_before") + F.col("runs_before")).alias("before")
    )
    order = before("corpus_id", "run").orderBy("doc_pos", "source_name", "content", "row")
    begin = counts.withColumn("docs_before", so_far("n", order))
    begin = begin.join(runs, F.col("corpus_id").eqNullSafe(F.col("c")) & F.col("run").eqNullSafe(F.col("r")))
    begin = begin.select("row", (F.col("before") + F.col("docs_before")).alias("before"))
    return _exploded(docs.select("row", "corpus_id", "doc_pos", "source_name", "quotes").join(begin, "row"))


def numbered_in_place(docs: DataFrame) -> DataFrame:
    """numbered() of documents that are dealt by corpus, where a task holds a whole corpus: nothing is shuffled."""
    order = Window.partitionBy("corpus_id").orderBy("doc_pos", "source_name", "content", "row")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return _exploded(docs.where("n > 0").withColumn("before", F.coalesce(before, F.lit(0))))


def _exploded(docs: DataFrame) -> DataFrame:
    """The quotes of documents, with their numbers; before: how many come earlier in the corpus."""
    rows = docs.select("corpus_id", "doc_pos", "source_name", "before", F.posexplode_outer("quotes").alias("p", "q"))
    rows = rows.withColumn("quote_idx", (F.col("before") + F.col("p") + 1).cast("int"))
    return rows.select(
        "corpus_id", "doc_pos", "q.seg_pos", "quote_idx", quote_id(
            F.col("quote_idx")
        ).alias("quote_id"), "q.speaker", "q.text", "q.source_line", "q.word_count", "source_name"
    )


def filled(documents: DataFrame) -> DataFrame:
    """The documents that are not blank."""
    return documents.where(tx.filled(F.col("text"))).select("corpus_id", "doc_pos", "source_name", "text")


def parsed_filled(documents: DataFrame, min_quote_words: int = 4) -> DataFrame:
    """parsed() of the documents that are not blank."""
    return parsed(filled(documents), min_quote_words)


def quote_units(documents: DataFrame, min_quote_words: int = 4) -> DataFrame:
    """Sentences of enough words, numbered through each corpus."""
    return numbered(parsed_filled(documents, min_quote_words))


def quote_id(number):
    return F.format_string("Q%04d", number)

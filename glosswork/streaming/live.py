"""Transcripts that arrive as a stream.

Turns and sentences of a document are computed within its row, so they work on a stream as they
are; numbers, vectors and clusters need the whole corpus, so results are analysed anew for the
corpora of each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import segment
from ..plans.analysis import analyze, release
from ..settings import Settings


def live_sentences(documents: DataFrame, min_quote_words: int = 4) -> DataFrame:
    """Quote-length sentences of a stream of documents, without running numbers."""
    return segment.sentence_units(segment.segments(documents)).where(F.col("word_count") >= min_quote_words)


def spoken_by_window(documents: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """Sentences and words by speaker and event-time window; later rows than delay are dropped."""
    timed = segment.not_blank(documents.withWatermark(time, delay))
    turns = timed.select("corpus_id", time, F.explode(segment.segment_array(F.col("text"))).alias("s"))
    from ..functions import text as tx

    rows = turns.select("corpus_id", time, "s.speaker", F.explode(tx.sentences(F.col("s.text"))).alias("sentence"))
    rows = rows.withColumn("n", F.size(tx.words(F.col("sentence"))))
    return rows.groupBy(F.window(time, width), "corpus_id", "speaker").agg(
        F.count("*").alias("sentences"), F.sum("n").alias("words")
    )


def analyze_batches(documents: DataFrame, sink: Callable[[DataFrame, int], None], settings: Settings = Settings()):
    """A writer that gives the result of each micro-batch's corpora to sink(result, batch_id).

    The result's table goes once sink returns, so batches leave nothing behind."""

    def run(batch, n):
        result = analyze(batch, settings)
        try:
            sink(result, n)
        finally:
            release(result)

    return documents.writeStream.foreachBatch(run)

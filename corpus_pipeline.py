"""The corpus pipeline: five operators, one after the other, over documents.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from glosswork.llm import decontamination, ngram_join, segmentation, shared, substring_dedup, toxicity

#: A document with this score or more is toxic.
TOXIC = 0.3


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents and drops those it finds toxic.

    Null and empty texts have the intercept's score; rows are judged one by one, so null and
    repeated ids don't matter; other columns stay as they are, whatever their names.
    """
    weights = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = shared.own_name(docs, "__toxicity")
    return toxicity.score(docs, weights, column=name).where(F.col(name) < TOXIC).select(*columns(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest doc_id.

    Rows are told apart by doc_id and text, so of equal ids with other texts only the copies go.
    Of several rows with that id and a text of the group the one with the least hash of the text
    stays, and one of rows that agree in both.  Rows without an id or without words stay.
    """
    rows = shared.cut(ngram_join.rows_with_components(docs).where("node is not null and doc_id is not null"))
    kept = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "content")).alias("k")).select("k.doc_id", "k.content")
    ids, content, first = shared.own_name(docs, "__id"), shared.own_name(docs, "__content"), shared.own_name(docs, "__first")
    known = rows.select("doc_id", "content").distinct().join(
        kept.withColumn("stays", F.lit(True)), ["doc_id", "content"], "left"
    )
    known = known.select(
        F.col("doc_id").alias(ids), F.col("content").alias(content), F.coalesce("stays", F.lit(False)).alias(first)
    )
    # rows without an id match nothing and are spread
    text_hash = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))
    marked = docs.withColumns({ids: F.col("doc_id").cast("long"), content: text_hash})
    marked = marked.join(known.hint("merge"), [ids, content], "left")
    # numbers the copies of a row that stays; other rows each get 1
    number = F.row_number().over(Window.partitionBy(ids, content).orderBy(ids, content))
    marked = marked.withColumn(content, F.when(F.col(first), number).otherwise(1))
    return marked.where(F.coalesce(first, F.lit(True)) & (F.col(content) == 1)).select(*columns(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of windows that occur earlier from the texts.

    Null texts stay null; texts that lose nothing stay byte for byte, others have one space
    between their words.  Rows with null id come last; equal rows lose the same words.
    """
    return substring_dedup.strip(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a verbatim, edited or paraphrased test item.

    Rows are told apart by a hash of id and text, so null ids are judged like others, and of
    equal ids only the texts that hold an item go.
    """
    key = shared.own_name(docs, "__row")
    marked = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text")))
    judged = marked.select(F.col(key).alias("doc_id"), "text")
    found = decontamination.contaminated(judged, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.select(F.col("doc_id").alias(key)).distinct()
    return marked.join(found.hint("merge"), key, "left_anti").select(*columns(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless) of every document that is left; null texts have null
    pieces, empty ones none, and rows with null id are sampled by their text."""
    return segmentation.encode(docs.select("doc_id", "text"), check=True).select("doc_id", "n_pieces", "pieces", "lossless")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: No SQL: learned weights, alignment and sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table goes once the next one is written, or on an error,
    and the last stays in the checkpoint folder, as the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    try:
        for _, stage in STAGES[:-1]:
            docs = shared.written(stage(spark, docs, sf_dir))
            shared.discard(*before)
            before = [docs]
        return STAGES[-1][1](spark, docs, sf_dir)
    except BaseException:
        shared.discard(*before)
        raise

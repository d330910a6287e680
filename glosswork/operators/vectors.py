"""TF-IDF vectors in long form, centroids and cosines; all keyed by corpus_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import stages
from ..functions import text as tx


def counted(all_terms):
    """Array of (term, tf) of an array of terms."""
    once = F.array_distinct(all_terms)
    n = lambda t: F.size(all_terms) - F.size(F.array_remove(all_terms, t))
    many = lambda t: F.struct(t.alias("term"), n(t).cast("long").alias("tf"))
    one = lambda t: F.struct(t.alias("term"), F.lit(1).cast("long").alias("tf"))
    return F.when(F.size(once) == F.size(all_terms), F.transform(once, one)).otherwise(F.transform(once, many))


def terms(quotes: DataFrame, focus: str = "") -> DataFrame:
    """(corpus_id, quote_idx, term, tf): counted within the quote's row, without a shuffle."""
    every = tx.vector_terms(tx.focus_augmented(F.col("text"), focus))
    # outer: else a filter on the whole array is inferred and pushed below, and evaluated again
    rows = stages.spread(quotes).select("corpus_id", "quote_idx", F.explode_outer(tx.bound(every, counted)).alias("t"))
    return rows.where("t is not null").select("corpus_id", "quote_idx", "t.term", "t.tf")


def idf(tf: DataFrame, quotes: DataFrame) -> DataFrame:
    """(corpus_id, term, df, idf): ln((1+N)/(1+df))+1, N quotes."""
    total = quotes.groupBy("corpus_id").agg(F.count("*").alias("total"))
    df = tf.groupBy("corpus_id", "term").agg(F.count("*").alias("df"))
    return df.join(total, "corpus_id").select(
        "corpus_id", "term", "df", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf")
    )


def unit(rows: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Weights scaled to length 1 for each key; vectors of length 0 go."""
    norm = F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(*keys)))
    return rows.withColumn("__norm", norm).where("__norm > 0").withColumn(
        weight, F.col(weight) / F.col("__norm")
    ).drop("__norm")


def weights(tf: DataFrame, idfs: DataFrame) -> DataFrame:
    """(corpus_id, quote_idx, term, tf, weight); a quote's length cancels out in the scaling."""
    raw = tf.join(idfs.select("corpus_id", "term", "idf"), ["corpus_id", "term"])
    return unit(
        raw.withColumn("weight", F.col("tf") * F.col("idf")), ["corpus_id", "quote_idx"]
    ).select("corpus_id", "quote_idx", "term", "tf", "weight")


def weigh(quotes: DataFrame, focus: str = "") -> tuple[DataFrame, DataFrame]:
    """idf() and weights() of quotes, each a table."""
    tf = terms(quotes, focus)
    idfs = stages.write(idf(tf, quotes))
    return idfs, stages.write(weights(tf, idfs))


def hashed(quotes: DataFrame, focus: str = "") -> DataFrame:
    """(quote_idx, term, weight) of the quotes of one corpus: term is a 64-bit hash, and weights are not scaled.

    For cosines of hashed vectors, which don't depend on a length.  Terms are made once, as a table; only
    frequencies above one are sent back to the quotes."""
    every = F.transform(tx.vector_terms(tx.focus_augmented(F.col("text"), focus)), lambda t: F.xxhash64(t))
    rows = stages.write(stages.spread(quotes).select("quote_idx", tx.bound(every, counted).alias("t")))
    rows = rows.select("quote_idx", F.explode("t").alias("t")).select("quote_idx", "t.term", F.col("t.tf").cast("int").alias("tf"))
    df = rows.groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    idf = F.log((1 + F.lit(quotes.count())) / (1 + F.coalesce("df", F.lit(1)))) + 1
    return rows.join(df, "term", "left").select("quote_idx", "term", (F.col("tf") * idf).alias("weight"))


def l1(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("corpus_id", "quote_idx").agg(F.sum(F.abs("weight")).alias("l1"))


def centroids(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """(corpus_id, cluster_pos, term, weight): unit mean vectors of clusters."""
    own = assignments.select("corpus_id", "cluster_pos", "quote_idx")
    total = vectors.join(own, ["corpus_id", "quote_idx"]).groupBy(
        "corpus_id", "cluster_pos", "term"
    ).agg(F.sum("weight").alias("weight"))
    return unit(total, ["corpus_id", "cluster_pos"])


def relevance(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """(corpus_id, cluster_pos, quote_idx, cos): each member's cosine with its centroid; 0 without terms."""
    own = assignments.select("corpus_id", "cluster_pos", "quote_idx")
    center = centroids(vectors, assignments).withColumnRenamed("weight", "c")
    dots = vectors.join(own, ["corpus_id", "quote_idx"]).join(center, ["corpus_id", "cluster_pos", "term"])
    dots = dots.groupBy("corpus_id", "cluster_pos", "quote_idx").agg(F.sum(F.col("weight") * F.col("c")).alias("cos"))
    return own.join(dots, ["corpus_id", "cluster_pos", "quote_idx"], "left").fillna(0.0, ["cos"])


def pair_cosine(vectors: DataFrame) -> DataFrame:
    """(corpus_id, left_idx, right_idx, cos) of quotes that share a term, left before right.

    The pairs are those of a term within a corpus: use it for corpora of bounded size, such as
    one conversation.
    """
    a = vectors.select("corpus_id", "term", F.col("quote_idx").alias("left_idx"), F.col("weight").alias("x"))
    b = vectors.select("corpus_id", "term", F.col("quote_idx").alias("right_idx"), F.col("weight").alias("y"))
    both = a.join(b, ["corpus_id", "term"]).where("left_idx < right_idx")
    return both.groupBy("corpus_id", "left_idx", "right_idx").agg(F.sum(F.col("x") * F.col("y")).alias("cos"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most similar pair of each corpus; of equals the first."""
    order = Window.partitionBy("corpus_id").orderBy(F.desc("cos"), "left_idx", "right_idx")
    return pairs.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


#: How far below the best known cosine a pair may be and still be looked at: more than the digits compared.
MARGIN = 2e-6


def likely_pairs(vectors: DataFrame) -> DataFrame:
    """(corpus_id, left_idx, right_idx, cos): few pairs, among them the most similar of each corpus and its ties.

    Equal vectors stand for their first quote, and their first two are a pair.  A lower bound of the best
    cosine comes from the two heaviest quotes of each term.  Terms are put in order, rare ones first; a
    quote's last terms are left out of the index as long as what they could add to any cosine, by their
    length or by each term's greatest weight, stays below the bound.  A pair that reaches it shares a
    term that both keep, the first they share.
    """
    listed = F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("v")
    packed = vectors.groupBy("corpus_id", "quote_idx").agg(listed)
    first = packed.groupBy("corpus_id", "v").agg(F.min("quote_idx").alias("quote_idx"), F.count("*").alias("n"))
    first = stages.write(first)
    copies = packed.join(first.where("n > 1").select("corpus_id", "v", F.col("quote_idx").alias("left_idx")), ["corpus_id", "v"])
    copies = copies.where("quote_idx > left_idx").groupBy("corpus_id", "left_idx").agg(F.min("quote_idx").alias("right_idx"))
    rows = first.select("corpus_id", "quote_idx", F.explode("v").alias("t")).select("corpus_id", "quote_idx", "t.*")
    terms = rows.groupBy("corpus_id", "term").agg(
        F.count("*").alias("df"), F.max("weight").alias("most"), F.max(F.struct("weight", "quote_idx")).alias("a")
    )
    shared = terms.where("df > 1")
    rows = stages.write(rows.join(shared, ["corpus_id", "term"]))  # terms of one quote make no pair
    next_ = rows.where("quote_idx <> a.quote_idx").groupBy("corpus_id", "term").agg(
        F.max(F.struct("weight", "quote_idx")).alias("b"), F.first("a").alias("a")
    )
    lone = next_.select("corpus_id", F.least("a.quote_idx", "b.quote_idx").alias("left_idx"), F.greatest("a.quote_idx", "b.quote_idx").alias("right_idx"))
    known = _cosines(lone.distinct(), rows).unionByName(copies.withColumn("cos", F.lit(1.0)))
    known = stages.write(known)
    bound = known.groupBy("corpus_id").agg((F.max("cos") - MARGIN).alias("bound"))
    line = Window.partitionBy("corpus_id", "quote_idx").orderBy(F.desc("df"), "term")
    rest = F.least(F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(line)), F.sum(F.col("weight") * F.col("most")).over(line))
    index = rows.join(bound, "corpus_id").withColumn("rest", rest).where("rest >= bound").select("corpus_id", "term", "quote_idx")
    index = stages.write(index)
    pairs = index.withColumnRenamed("quote_idx", "left_idx").join(index.withColumnRenamed("quote_idx", "right_idx"), ["corpus_id", "term"])
    pairs = pairs.where("left_idx < right_idx").select("corpus_id", "left_idx", "right_idx").distinct()
    return _cosines(pairs, rows).unionByName(copies.withColumn("cos", F.lit(1.0)))


def _cosines(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    left = rows.select("corpus_id", F.col("quote_idx").alias("left_idx"), "term", F.col("weight").alias("x"))
    right = rows.select("corpus_id", F.col("quote_idx").alias("right_idx"), "term", F.col("weight").alias("y"))
    both = pairs.join(left, ["corpus_id", "left_idx"]).join(right, ["corpus_id", "right_idx", "term"])
    return both.groupBy("corpus_id", "left_idx", "right_idx").agg(F.sum(F.col("x") * F.col("y")).alias("cos"))

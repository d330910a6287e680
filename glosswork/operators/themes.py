"""From assigned quotes to themes: keywords, labels, ranking, validation, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import stages
from ..functions import display, lexicon, text as tx
from ..settings import Settings
from . import bycorpus, online, ranks, vectors as vec

KEYWORDS = 5
HINT_WEIGHT, PHRASE_WEIGHT = 4.0, 1.75
KEY = ["corpus_id", "cluster_pos"]


def hints():
    pairs = [F.lit(x) for item in lexicon.THEME_HINTS.items() for x in item]
    return F.create_map(*pairs)


#: Members whose words are joined in one task: those with equal member_pos div RUN.
RUN = 4096


def _ahead(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows with n1 and n2: the first two words behind a row, from the rows' own first two (w1, w2)."""
    line = Window.partitionBy(*key).orderBy(order)
    after = F.coalesce(F.lead("w2", 1).over(line), F.lead("w1", 2).over(line))
    return rows.withColumns({"n1": F.lead("w1", 1).over(line), "n2": after})


def _borders(words: DataFrame) -> DataFrame:
    """(KEY, last, w, n1, n2): of each member the last words (one or two) and the next two of the cluster.

    words: KEY, member_pos, and of each member with any words its first two (w1, w2) and last two.
    Members are taken by runs, so a cluster needs no single task.
    """
    words = words.withColumn("run", F.floor(F.col("member_pos") / RUN))
    words = _ahead(words, [*KEY, "run"], "member_pos")
    # of a run: its first word, and the second, which may be the next member's
    first = F.min(F.struct("member_pos", "w1", F.coalesce("w2", "n1").alias("w2"))).alias("f")
    runs = words.groupBy(*KEY, "run").agg(first).select(*KEY, "run", "f.w1", "f.w2")
    runs = _ahead(runs, KEY, "run").select(*KEY, "run", F.col("n1").alias("r1"), F.col("n2").alias("r2"))
    n1 = F.coalesce("n1", "r1").alias("n1")
    n2 = F.when(F.col("n1").isNull(), F.col("r2")).otherwise(F.coalesce("n2", "r1")).alias("n2")
    return words.join(runs, [*KEY, "run"]).select(*KEY, "last", n1, n2).where("n1 is not null")


def keywords(quotes: DataFrame, assignments: DataFrame, idf: DataFrame, limit: int = KEYWORDS) -> DataFrame:
    """(corpus_id, cluster_pos, keyword, score, k): the best terms and phrases of each cluster.

    Phrases run over the members' texts in member order, from one quote into the next.  Those
    within a quote are made in its row; those over a border from the last two words of each
    member and the two words that follow, so only these four are put in order.  idf's terms may be hashes.
    """
    own = assignments.select(*KEY, "member_pos", "quote_idx")
    # outer: words are made once, before the filter
    words = stages.spread(quotes).select("corpus_id", "quote_idx", F.explode_outer(F.array(tx.content_words(F.col("text")))).alias("t"))
    words = stages.write(words.where(F.size("t") > 0).join(own, ["corpus_id", "quote_idx"]))  # read twice, made once
    inside = words.select(*KEY, F.explode_outer(F.concat("t", tx.grams(F.col("t"), 2, " "), tx.grams(F.col("t"), 3, " "))).alias("keyword"))
    ends = words.select(
        *KEY, "member_pos", F.get("t", F.lit(0)).alias("w1"), F.get("t", F.lit(1)).alias("w2"),
        F.slice("t", -F.least(F.size("t"), F.lit(2)), F.lit(2)).alias("last")
    )
    over = _borders(ends)
    a, b = F.element_at("last", -1), F.try_element_at("last", F.lit(-2))
    three = F.when(F.col("n2").isNotNull(), F.concat_ws(" ", a, "n1", "n2"))
    across = F.array(F.concat_ws(" ", a, "n1"), three, F.when(b.isNotNull(), F.concat_ws(" ", b, a, "n1")))
    over = over.select(*KEY, F.explode_outer(across).alias("keyword")).where("keyword is not null")
    counts = inside.unionByName(over).groupBy(*KEY, "keyword").agg(F.count("*").alias("n"))
    # words hold neither spaces nor underscores
    counts = counts.withColumn("term", F.translate("keyword", " ", "_"))
    if idf.schema["term"].dataType.typeName() == "long":
        hashed = idf.select("corpus_id", F.col("term").alias("hash"), "idf")
        return best_keywords(counts.withColumn("hash", F.xxhash64("term")).join(hashed, ["corpus_id", "hash"], "left"), limit)
    return best_keywords(counts.join(idf.select("corpus_id", "term", "idf"), ["corpus_id", "term"], "left"), limit)


def best_keywords(counts: DataFrame, limit: int = KEYWORDS) -> DataFrame:
    """(KEY, keyword, score, k) of (KEY, keyword, term, n, idf)."""
    scored = counts.withColumn("w", F.when(F.contains("keyword", F.lit(" ")), PHRASE_WEIGHT).otherwise(1.0))
    bonus = F.when(
        (F.col("w") == 1.0) & F.coalesce(F.map_contains_key(hints(), F.col("term")), F.lit(False)), HINT_WEIGHT * F.col("n")
    ).otherwise(0.0)
    scored = scored.withColumn(
        "score", F.col("n") * F.col("w") * F.coalesce("idf", F.lit(1.0)) + bonus
    ).where(F.length("keyword") >= 3)
    order = Window.partitionBy(*KEY).orderBy(F.desc(F.round("score", 9)), "keyword")
    return scored.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select(*KEY, "keyword", "score", "k")


def keyword_lists(rows: DataFrame) -> DataFrame:
    """(corpus_id, cluster_pos, keywords): at most `limit` each, in order."""
    listed = F.sort_array(F.collect_list(F.struct("k", "keyword")))
    return rows.groupBy(*KEY).agg(F.transform(listed, lambda s: s["keyword"]).alias("keywords"))


def prioritized(words, focus: str, aligned):
    """The focus words before the others, five in all, where the cluster has any of them."""
    terms = tx.python_words(focus)
    if not terms:
        return words
    first = F.array(*[F.lit(t) for t in terms])
    return F.when(aligned > 0, F.slice(F.array_distinct(F.concat(first, words)), 1, KEYWORDS)).otherwise(words)


def label(words):
    """The label that a keyword's word suggests, the first first; else the first keyword as a title."""
    table = hints()
    parts = F.flatten(F.transform(words, lambda k: F.split(k, " ")))
    hinted = F.filter(F.transform(parts, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
    title = F.filter(F.split(F.coalesce(F.get(words, F.lit(0)), F.lit("")), " "), lambda w: ~tx.is_stopword(w) & (w != ""))
    title = F.array_join(F.slice(F.transform(title, F.initcap), 1, 5), " ")
    return F.coalesce(F.get(hinted, F.lit(0)), F.when(title != "", title), F.lit("Emerging Theme"))


def ranked(rows: DataFrame, key: list[str], settings: Settings) -> DataFrame:
    """rows with quote_rank within each theme: relevance and focus, then place in the sources."""
    return ranks.numbered(rows, key, rank_order(settings), "quote_rank")


def rank_order(settings: Settings) -> list:
    rank_score = F.col("relevance") + tx.alignment(F.col("text"), settings.central_theme)
    return [F.desc(F.round(rank_score, 9)), F.col("source_name"), F.col("source_line"), F.col("quote_id")]


def is_shown(settings: Settings):
    """Whether a ranked quote is one of the best of its theme; all are, if no number is set."""
    return F.col("quote_rank") <= settings.quotes_per_theme if settings.quotes_per_theme > 0 else F.lit(True)


def shown(rows: DataFrame, settings: Settings) -> DataFrame:
    """The best quotes of each theme, or all."""
    return rows.where(is_shown(settings)) if settings.quotes_per_theme > 0 else rows


QUOTE = ["quote_id", "speaker", "text", "relevance", "source_line", "source_name"]


def focus_flags(text, focus: str) -> list:
    """For each focus word whether a text contains it, 1 or 0."""
    normal = tx.normalize_for_match(text)
    return [F.contains(normal, F.lit(tx.match_form(t))).cast("int") for t in tx.python_words(focus)]


def evidence(rows: DataFrame, key: list[str], settings: Settings, listed: bool = True) -> DataFrame:
    """By theme: the columns of of_shown()."""
    return shown(rows, settings).groupBy(*key).agg(*of_shown(settings, listed))


def of_shown(settings: Settings, listed: bool = True) -> list:
    """Of all ranked quotes of a theme: the shown ones, in order (none without listed), the counts of its validation, and
    found, which focus words the shown quotes have."""
    own = lambda c: F.when(is_shown(settings), c)
    # the shown text has a focus word if one of its quotes has: words hold no space
    flags = [F.max(own(f)) for f in focus_flags(F.col("text"), settings.central_theme)]
    aligned = F.round(sum(flags, F.lit(0)) / float(len(flags)), 3) if flags else F.max(F.lit(0.0))
    quote = F.struct("quote_rank", F.struct(*QUOTE).alias("q"))
    quotes = F.sort_array(F.collect_list(own(quote) if listed else F.when(F.lit(False), quote)))
    # a set of as many as are shown; without such a number rows are sent to be counted, as a set may be too large
    distinct = (lambda c: F.size(F.collect_set(own(c)))) if settings.quotes_per_theme > 0 else F.count_distinct
    return [
        F.transform(quotes, lambda s: s["q"]).alias("quotes"),
        F.count_if(is_shown(settings)).cast("int").alias("displayed_quote_count"),
        distinct(F.col("source_name")).cast("int").alias("source_count"),
        distinct(F.col("speaker")).cast("int").alias("speaker_count"),
        aligned.alias("central_theme_alignment"), F.array(*flags).cast("array<int>").alias("found")
    ]


def validation(evidence_count):
    return F.struct(
        evidence_count.cast("int").alias(
            "evidence_count"
        ), "displayed_quote_count", "source_count", "speaker_count", "central_theme_alignment",
        F.lit(lexicon.REVIEW_STATUS).alias("review_status"),
    )


def clustered_rows(quotes: DataFrame, relevance: DataFrame, settings: Settings) -> DataFrame:
    """The quotes of every cluster, ranked: quotes' columns, KEY, cos, relevance, quote_rank."""
    rows = relevance.join(quotes, ["corpus_id", "quote_idx"]).withColumn("relevance", F.round("cos", 3))
    return ranked(rows, KEY, settings)


def dealt_rows(clustered: DataFrame, columns: list[str], settings: Settings) -> DataFrame:
    """clustered_rows() of quotes that are dealt by corpus (see bycorpus)."""
    own = [c for c in columns if c not in ("corpus_id", "quote_idx")]
    rows = bycorpus.relevance(clustered, settings.central_theme, tuple(own)).withColumn("relevance", F.round("cos", 3))
    rows = rows.withColumn("quote_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(*rank_order(settings))))
    return rows.select("corpus_id", "quote_idx", "cluster_pos", "cos", *own, "relevance", "quote_rank")


def of_clusters(dealt: DataFrame, large: DataFrame | None, clusters, columns: list[str], settings: Settings, weighed=None) -> tuple[DataFrame, DataFrame]:
    """The ranked rows of all clusters and their keyword_lists(), each a table.  dealt: clustered quotes by corpus;
    clusters: gives the assignments of the quotes in large (see bycorpus.apart()); weighed: their vectors, if known."""
    rows, found = dealt_rows(dealt, columns, settings), dealt_keywords(dealt, settings)
    if large is not None:
        more = of_large(large, clusters(large), settings, weighed)
        rows, found = rows.unionByName(more[0].select(*rows.columns)), found.unionByName(more[1])
    return stages.write(rows), stages.write(keyword_lists(found))


def dealt_keywords(dealt: DataFrame, settings: Settings) -> DataFrame:
    """keywords() of clustered quotes that are dealt by corpus."""
    return best_keywords(bycorpus.keyword_counts(dealt, settings.central_theme))


def of_large(large: DataFrame, assigned: DataFrame, settings: Settings, weighed=None) -> tuple[DataFrame, DataFrame]:
    """clustered_rows() and keywords() of quotes by joins."""
    if isinstance(weighed, online.Weighed):
        idf, cosines = weighed
    else:
        idf, weights = weighed or vec.weigh(large, settings.central_theme)
        cosines = vec.relevance(weights, assigned)
    return clustered_rows(large, stages.write(cosines), settings), keywords(large, assigned, idf)


def clustered_themes(
    rows: DataFrame, listed: DataFrame, settings: Settings, listed_quotes: bool = True, dealt: bool = False
) -> DataFrame:
    """Themes of clusters: corpus_id, number, id, name, color, keywords, quote_count, score, quotes, validation,
    found.  rows and listed: of_clusters().  Without listed_quotes, quotes are empty lists.  dealt: both are still dealt
    by corpus, as no tables are."""
    aligned = F.max(tx.alignment(F.col("text"), settings.central_theme)).alias("aligned")
    # one pass: rows that are no table are not made again for the shown ones
    themes = rows.groupBy(*KEY).agg(
        F.count("*").cast("int").alias("quote_count"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("cos"))), 3).alias("score"), aligned,
        *of_shown(settings, listed_quotes)
    )
    if dealt:  # joined by the corpus alone: both keys would have the themes shuffled with their quotes
        words = F.map_from_entries(F.collect_list(F.struct("cluster_pos", "keywords")))
        themes = themes.join(listed.groupBy("corpus_id").agg(words.alias("words")), "corpus_id", "left")
        themes = themes.withColumn("keywords", F.try_element_at("words", F.col("cluster_pos"))).drop("words")
    else:
        themes = themes.join(listed, KEY, "left")
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    themes = themes.withColumn("keywords", prioritized(words, settings.central_theme, F.col("aligned")))
    number = F.col("cluster_pos")
    return themes.select(
        "corpus_id", number.alias("number"), F.format_string("T%02d", number).alias("id"), label(
            F.col("keywords")
        ).alias("name"), display.theme_color(number).alias("color"),
        "keywords", "quote_count", "score", "quotes", validation(F.col("quote_count")).alias("validation"), "found",
    )


FRAME_KEY = ["corpus_id", "frame_pos"]


def codebook_themes(matched: DataFrame, settings: Settings, listed_quotes: bool = True) -> DataFrame:
    """Themes of frames, same columns; only the first theme_count frames that matched are kept.

    matched: codebook.matches(), with quote_rank if they are ranked already."""
    key = FRAME_KEY
    rows = matched if "quote_rank" in matched.columns else ranked(matched, key, settings)
    mean = F.avg(F.col("relevance").cast("decimal(10,3)")).cast("double")
    totals = matched.groupBy(*key).agg(
        F.count("*").cast("int").alias("quote_count"), F.round(mean, 3).alias("score"), F.first("frame_name").alias("name"), F.first(
            "frame_keywords"
        ).alias("keywords")
    )
    first = F.row_number().over(Window.partitionBy("corpus_id").orderBy("frame_pos"))
    totals = totals.withColumn("__k", first).where(F.col("__k") <= max(1, settings.theme_count))
    themes = totals.join(evidence(rows, key, settings, listed_quotes), key)
    number = F.col("frame_pos")
    return themes.select(
        "corpus_id", number.alias("number"), F.format_string(
            "C%02d", number
        ).alias("id"), "name", display.theme_color(number).alias("color"), "keywords", "quote_count", "score",
        "quotes", validation(F.col("quote_count")).alias("validation"), "found",
    )


def ordered(themes: DataFrame, settings: Settings) -> DataFrame:
    """themes with theme_pos: by focus, size, score, name, number."""
    # a focus word counts if the name, a keyword or a shown quote has it: words hold no space
    flags = focus_flags(F.concat_ws(" ", "name", F.array_join("keywords", " ")), settings.central_theme)
    either = [F.greatest(f, F.get("found", F.lit(i))) for i, f in enumerate(flags)]
    focus = F.round(sum(either, F.lit(0)) / float(len(flags)), 9) if flags else F.lit(0.0)
    order = Window.partitionBy("corpus_id").orderBy(F.desc(focus), F.desc("quote_count"), F.desc("score"), "name", "number")
    return themes.withColumn("theme_pos", F.row_number().over(order)).drop("found")

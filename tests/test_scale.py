"""What keeps single groups, lists and plans small: ranks over ranges, few pairs, large codebooks, staged plans."""

import math
import random
import time

import pytest
from pyspark.sql import Window, functions as F

from glosswork import stages
from glosswork.operators import codebook, ranks, vectors as vec
from glosswork.plans import analysis, catalog
from glosswork.settings import Settings

SF = "/root/testdata/sf0.001"


def test_ranks_over_ranges_are_those_of_a_window(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 30 == 2, None).otherwise("cold").alias("key"),
        (F.xxhash64("id") % 50).alias("score"), "id"
    ).repartition(4)
    order = [F.desc("score"), F.col("id")]
    want = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    got = ranks.numbered(rows, ["key"], order, "place", most=150)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # the large key lies in several partitions
    placed = ranks._by_ranges(rows.where("key = 'hot'"), ["key"], order, "place")
    assert placed.agg(F.max("place")).first()[0] == 2000


def test_best_pairs_come_from_few(spark):
    _, w = vec.weigh(stages.write(catalog.conv_quotes(spark, "/root/testdata/sf0.01", one_corpus=True)))
    pairs = stages.write(vec.pair_cosine(w))
    rounded = lambda df: df.withColumn("cos", F.round("cos", 6))
    few = stages.write(vec.likely_pairs(w))
    assert vec.best_pair(rounded(few)).collect() == vec.best_pair(rounded(pairs)).collect()
    assert few.count() * 10 < pairs.count()


def test_copies_are_no_pairs_of_each_other(spark):
    """Of a third of all quotes that are equal, one pair is looked at."""
    vectors = [(["a", "b"], [0.6, 0.8])] * 200 + [([f"t{i}", "a"], [math.sqrt(0.5)] * 2) for i in range(100)]
    rows = [("c", i, t, x) for i, (ts, xs) in enumerate(vectors) for t, x in zip(ts, xs)] + [("d", 1, "a", 1.0), ("e", 1, "x", 1.0), ("e", 2, "y", 1.0)]
    got = vec.likely_pairs(spark.createDataFrame(rows, "corpus_id string, quote_idx int, term string, weight double"))
    assert got.count() < 50
    assert [tuple(r) for r in vec.best_pair(got).collect()] == [("c", 0, 1, 1.0)]


def large_codebook(rng, frames, words):
    return [
        (
            i, f"f{i}", [rng.choice(words) for _ in range(4)] + [rng.choice(words) + "-" + rng.choice(words)],
            [" ".join(rng.choice(words) for _ in range(2)) for _ in range(4)] + ["", None][: i % 2], ["k"]
        )
        for i in range(frames)
    ]


def test_a_large_codebook_scores_like_a_plain_one(spark):
    rng = random.Random(4)
    words = [a + b for a in ("garden", "soil", "rain", "bean", "frost") for b in ("er", "y", "ing", "ed", "let")]
    texts = [" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(300)]
    quotes = stages.write(spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "corpus_id string, quote_idx int, text string"))
    frames = [(i, n, t, [p for p in ps if p], k) for i, n, t, ps, k in large_codebook(rng, 1500, words)]
    book = spark.createDataFrame(frames, codebook.SCHEMA)
    took, got = {}, None
    for n in (4, 1500):
        some = stages.write(book.where(F.col("frame_pos") < n))
        for _ in range(2):  # the second run counts
            start = time.time()
            got = codebook.matches(quotes, some).select("quote_idx", "frame_pos", "score").collect()
            took[n] = time.time() - start
    plain = {}
    for q, text in enumerate(texts):
        normal, said = text[:-1], set(text[:-1].split())
        for i, _, terms, phrases, _ in frames:
            s = sum(2.5 for p in phrases if p in normal) + sum((1.5 if t in normal else 0) if "-" in t else float(t in said) for t in terms)
            if s:
                plain[q, i] = s
    assert {(r.quote_idx, r.frame_pos): r.score for r in got} == plain
    assert took[1500] < 3 * took[4] + 3
    with pytest.raises(ValueError):
        codebook.matches(quotes, spark.createDataFrame([(1, "x" * (codebook.MOST_TEXT + 1), [], [], [])], codebook.SCHEMA))


def nodes_of(plan):
    """Operators of an executed plan."""
    text = plan.toString()
    return sum(line.strip(" :+-*()0123456789").startswith(tuple("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for line in text.splitlines())


def test_an_analysis_runs_in_small_plans_and_leaves_nothing(spark, monkeypatch):
    sizes, paths, write = [], [], stages.write

    def seen(df):
        sizes.append(nodes_of(df._jdf.queryExecution().executedPlan()))
        out = write(df)
        paths.append(out.staged_at)
        return out

    monkeypatch.setattr(stages, "write", seen)

    def there():
        at = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
        return [p for p, a in zip(paths, at) if a.getFileSystem(spark._jsc.hadoopConfiguration()).exists(a)]

    cached = spark._jsc.getPersistentRDDs().size()
    for k in range(2):
        result = analysis.analyze(catalog.conversations(spark, SF), Settings(theme_count=3, quotes_per_theme=2, agglomerative_limit=5 + 200 * k))
        assert result.count() == 20 and result.where("size(themes) > 0").count() > 10
        assert len(paths) > 10 and there() == [result.staged_at]
        analysis.release(result)
        assert there() == []
    assert spark._jsc.getPersistentRDDs().size() == cached
    assert max(sizes) < 100, sorted(sizes)


def test_evidence_is_a_table_beside_the_result(spark):
    texts = {"camp": "Aunt: He was diagnosed with autism last winter, yet 4-H camp became his favourite week. The siren was too loud and everyone talked at once."}
    rows = [("camp", 0, "camp.txt", texts["camp"])] + [r for r in map(tuple, catalog.conversations(spark, SF).limit(30).collect())]
    docs = spark.createDataFrame(rows, "corpus_id string, doc_pos long, source_name string, text string")
    for s in (Settings(theme_count=2, central_theme="thin erth"), Settings(theme_count=2, quotes_per_theme=2)):
        whole = analysis.analyze(docs, s)
        result, evidence = analysis.analyze_tables(docs, s)
        listed = {(r.corpus_id, t.id, i + 1, *q) for r in whole.collect() for t in r.themes for i, q in enumerate(t.quotes)}
        assert {tuple(r) for r in evidence.collect()} == listed and {x[1][0] for x in listed} == {"C", "T"}
        bare = [[t.asDict(True) | {"quotes": []} for t in r.themes] for r in whole.orderBy("corpus_id").collect()]
        assert bare == [[t.asDict(True) for t in r.themes] for r in result.orderBy("corpus_id").collect()]
        for table in (whole, result, evidence):
            analysis.release(table)

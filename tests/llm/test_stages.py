"""Every pipeline stage on nulls, repeated rows and ids, extra and clashing columns, very long texts
and empty tables; and the operators in a session that was started elsewhere."""

import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glosswork.llm import decontamination, ngram_join, suffix_dedup, substring_dedup

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, n_words string, __key string, __toxicity int, __rid int, __starts string, __row int, `a.b` int, n_chars long, kept string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(300)) for _ in range(n))


def rows_of(pairs):
    return [(d, t, "own", "k", 7, 8, "s", 9, 10, None if t is None else len(t), "mine") for d, t in pairs]


@pytest.fixture(scope="module")
def pairs():
    same = words(60, 1)
    return [
        (1, same), (3, same), (
            3, words(50, 2)
        ), (5, words(40, 3)), (6, words(45, 4)), (6, words(45, 4)), (7, None), (7, None), (8, ""), (9, " \n"),
        (None, same), (None, None), (None, words(30, 5)), (10, words(60_000, 6)), (11, "one"), (12, "One"), (
            13, same + " " + words(40, 7)
        ),
    ]


def staged(spark, name, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    if name != "sentencepiece":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    return out.collect()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, name):
    assert staged(spark, name, []) == []


def test_toxicity_keeps_all_columns(spark, pairs):
    got = staged(spark, "toxicity", rows_of(pairs))
    assert Counter(got) <= Counter(map(tuple, rows_of(pairs))) and len(got) >= len(pairs) - 1


def test_one_of_each_group_stays(spark, pairs):
    got = Counter(staged(spark, "ngram_jaccard_join", rows_of(pairs)))
    want = Counter(map(tuple, rows_of(pairs)))
    for gone in ((3, pairs[0][1]), (6, pairs[4][1]), (12, "One")):
        want[tuple(rows_of([gone])[0])] -= 1
    assert got == +want


def test_repeated_words_go(spark, pairs):
    got = staged(spark, "substring_dedup", rows_of(pairs))
    assert len(got) == len(pairs)
    by = Counter((r.doc_id, r.text) for r in got)
    assert by[1, pairs[0][1]] == 1 and by[3, ""] == 1 and by[13, pairs[16][1].split(" ", 60)[60]] == 1 and by[7, None] == 2
    assert by[None, ""] == 1 and by[None, None] == 1 and by[10, pairs[13][1]] == 1
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert {(r.n_words, r["__rid"], r["a.b"], r.kept) for r in got} == {("own", 8, 10, "mine")}


def test_contaminated_rows_go(spark, pairs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 80").orderBy("item_id").first().text
    more = [
        (20, "so " + item), (20, words(20, 9)), (None, item), (21, words(30_000, 10) + " " + item + " " + words(30_000, 11))
    ]
    got = Counter(staged(spark, "benchmark_decontamination", rows_of(pairs + more)))
    assert got == Counter(map(tuple, rows_of(pairs + more[1:2])))


def test_pieces(spark, pairs):
    got = staged(spark, "sentencepiece", rows_of(pairs))
    assert len(got) == len(pairs) and all(r.lossless for r in got)
    assert Counter(r.pieces is None for r in got) == Counter(t is None for _, t in pairs)


def test_clashing_columns_and_long_texts_of_operators(spark, pairs):
    plain = spark.createDataFrame(pairs, "doc_id long, text string")
    odd = plain.withColumns(
        {c: F.lit("x") for c in ("node", "component_id", "n", "seeds", "item_id", "score", "content", "region", "h")}
    )
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for run in (ngram_join.join, lambda d: decontamination.contaminated(d, bench.withColumn("words", F.lit(1)))):
        assert Counter(run(odd).collect()) == Counter(run(plain).collect())
    for op in (suffix_dedup.dedup, substring_dedup.dedup):
        cols = [c for c in op(plain).columns if c not in ("kept",)]
        clash = plain.withColumns(
            {
                "__rid": F.lit(1), "__ord": F.lit(2), "__starts": F.lit(3), "rest": F.lit(4), "__places": F.lit(5),
                "n_removed": F.lit("x")
            }
        )
        assert Counter(op(clash).select(cols).collect()) == Counter(op(plain).select(cols).collect())
        assert {r.rest for r in op(clash).select("rest").collect()} == {4}


def test_a_session_started_elsewhere(tmp_path):
    """Workers don't need the package on their import path: only the driver knows where it is."""
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as entry
queries = entry.queries()
for k in (5, 8, 9, 10):
    name = next(n for n in queries if n.startswith(f"op{{k}}_"))
    print("ROWS", name, queries[name](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.stdout.count("ROWS") == 4, run.stderr[-2000:]

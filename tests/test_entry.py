"""The driver contract: every query with SQL agrees with it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from glosswork.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def shown(row):
    return tuple(repr(float(v)) if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v) for v in row)


def compare(spark, duck, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(shown(r) for r in df.select(*cols).collect()) == sorted(shown([r[i] for i in at]) for r in got.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    compare(spark, duck, catalog.QUERIES[name], catalog.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_counts(spark, tmp_path):
    from glosswork.streaming import live

    spark.createDataFrame(
        [("c", 0, "s", "Ann: one two three four. five six seven eight")],
        "corpus_id string, doc_pos int, source_name string, text string"
    ).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(
        "corpus_id string, doc_pos int, source_name string, text string"
    ).parquet(str(tmp_path / "in"))
    q = live.live_sentences(stream).writeStream.format("memory").queryName("live_rows").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).start()
    q.awaitTermination(60)
    assert spark.table("live_rows").count() == 2

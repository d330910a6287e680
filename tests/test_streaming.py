"""Windows with late rows, and analysis of micro-batches."""

import datetime as dt
import time

from glosswork.settings import Settings
from glosswork.streaming import live

SCHEMA = "corpus_id string, doc_pos int, source_name string, text string, at timestamp"


def arrivals(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in order of their times
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def at(hour, minute):
    return dt.datetime(2024, 5, 1, hour, minute)


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    batches = [
        [("c", 0, "s", "Ann: one two three. four five six", at(10, 0))],
        [("c", 1, "s", "Ann: seven eight\n\nBob: nine ten.", at(10, 7))],
        [("c", 2, "s", "Ann: far too late", at(9, 0)), ("c", 3, "s", "Bob: closes the window", at(10, 40))],
        [("c", 4, "s", "Bob: still open", at(10, 41))],
    ]
    stream = live.spoken_by_window(arrivals(spark, str(tmp_path / "in"), batches), "at", "10 minutes", "15 minutes")
    q = stream.writeStream.format("memory").queryName("live_windows").outputMode("append").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(40)
    got = {(r.window.start.hour, r.window.start.minute, r.speaker, r.sentences, r.words) for r in spark.table("live_windows").collect()}
    assert got == {(10, 0, "Ann", 3, 8), (10, 0, "Bob", 1, 2)}


def test_corpora_of_a_micro_batch_are_analysed(spark, tmp_path, monkeypatch):
    batches = [[("a", 0, "x", "Ann: one", at(10, 0)), ("b", 0, "y", "two", at(10, 0))], [("a", 1, "z", "Bob: three", at(10, 1))]]
    used, seen = [], []

    def analyze(batch, settings):
        used.append(settings)
        return batch.groupBy("corpus_id").count()

    monkeypatch.setattr(live, "analyze", analyze)
    stream = arrivals(spark, str(tmp_path / "in"), batches).drop("at")
    writer = live.analyze_batches(stream, lambda result, n: seen.append((n, sorted(map(tuple, result.collect())))), Settings(theme_count=1))
    q = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(60)
    assert seen == [(0, [("a", 1), ("b", 1)]), (1, [("a", 1)])] and used == [Settings(theme_count=1)] * 2

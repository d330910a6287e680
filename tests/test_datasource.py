"""Transcripts read, and reports written, as data sources."""

import io
import os
import zipfile

import pytest

from glosswork.plans import analysis
from glosswork.settings import Settings
from glosswork.sources import datasource, files, reports
from pyspark.sql import functions as F

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture
def folder(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    at = tmp_path / "in"
    (at / "a.txt").write_bytes(b"\xef\xbb\xbfAnn: one\r\ntwo")
    (at / "deep" / "b.DOCX").write_bytes(docx("Bob: three", "four"))
    (at / "c.rtf").write_bytes(rb"{\rtf1 Cy: caf\'e9\par next}")
    (at / "bad.docx").write_bytes(b"no zip")
    (at / "d.bin").write_bytes(b"left out")
    return tmp_path


def test_transcripts_are_read_by_kind(spark, folder):
    df = spark.read.format("transcripts").option("split", 1).load(str(folder / "in"))
    got = {r.source_name: (r.text, r.error and r.error.split(":")[0]) for r in df.collect()}
    assert got == {
        "a.txt": ("Ann: one\ntwo", None), "b.DOCX": ("Bob: three\nfour", None), "c.rtf": ("Cy: café\nnext", None),
        "bad.docx": (None, "BadZipFile")
    }
    assert df.rdd.getNumPartitions() == 4
    one = spark.read.format("transcripts").option("kinds", ".rtf").load(str(folder / "in"))
    assert [r.source_name for r in one.collect()] == ["c.rtf"]
    same = files.read_files(spark, [str(folder / "in" / n) for n in ("a.txt", "c.rtf")])
    assert {r.text for r in same.collect()} == {got["a.txt"][0], got["c.rtf"][0]}


def test_a_stream_takes_each_file_once(spark, folder):
    def run():
        stream = spark.readStream.format("transcripts").load(str(folder / "in"))
        q = stream.writeStream.foreachBatch(lambda b, n: seen.extend(r.source_name for r in b.collect()))
        q = q.option("checkpointLocation", str(folder / "cp")).trigger(once=True).start()
        assert q.awaitTermination(60)

    seen = []
    run()
    assert sorted(seen) == ["a.txt", "b.DOCX", "bad.docx", "c.rtf"]
    (folder / "in" / "later.md").write_text("Dee: five")
    os.utime(folder / "in" / "later.md", (2e9, 2e9))
    seen.clear()
    run()
    assert seen == ["later.md"]


def test_reports_are_written_line_by_line(spark, folder):
    said = "Ann: frost killed the early tomatoes, \"all\" of them.\nBob: a heated frame would save tomatoes from late frost."
    rows = [(c, 0, f"{c}.txt", said + f" {c} said so again today.") for c in ("a/b", "c", "d e")] + [("none", 0, "n", "short")]
    docs = spark.createDataFrame(rows, "corpus_id string, doc_pos int, source_name string, text string")
    result = analysis.analyze(docs, Settings(theme_count=2))
    for fmt, suffix in (("markdown", ".md"), ("csv", ".csv"), ("json", ".json")):
        out = folder / fmt
        lines = datasource.report_lines(result, fmt)
        for mode in ("append", "overwrite"):
            lines.write.format("transcript_reports").option("suffix", suffix).mode(mode).save(str(out))
        want = {r.corpus_id: r.report for r in reports.FORMATS[fmt](result).collect()}
        names = {"a/b": "a%2Fb", "c": "c", "d e": "d e", "none": "none"}
        assert {c: (out / f"{names[c]}{suffix}").read_bytes().decode() for c in want} == want
        assert sorted(os.listdir(out)) == sorted(n + suffix for n in names.values())
    # a run without the third corpus leaves no file of it
    few = datasource.report_lines(result.where(F.col("corpus_id") != "c"))
    few.write.format("transcript_reports").mode("overwrite").save(str(folder / "markdown"))
    assert sorted(os.listdir(folder / "markdown")) == ["a%2Fb.md", "d e.md", "none.md"]
    analysis.release(result)

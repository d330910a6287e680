"""Segments, clusters, codebook, whole analyses and reports on small transcripts."""

import csv
import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.cli import main
from glosswork.operators import cluster, segment, vectors as vec
from glosswork.plans import analysis, catalog
from glosswork.settings import Settings
from glosswork.sources import files, reports

GARDEN = """
Gardener A: The north beds stayed wet until May. Nobody could plant seedlings before the drain was dug.
Gardener A: Shared compost bins saved money, since neighbours brought kitchen peelings twice a week.
Gardener B: Slugs ate my lettuce during the rainy fortnight and copper tape stopped them.
Gardener B: A rota for watering would spare old members the long walk with heavy cans.
Gardener C: Selling surplus beans at the gate paid for new compost and a wheelbarrow.
Gardener C: Next spring somebody must repair the drain cover behind the shed.
""".strip()
CAMP = """
Aunt: Our nephew was diagnosed with autism last winter, yet 4-H camp became his favourite week.
Organiser: Training for the volunteers covered short directions and printed rules for each table.
Teen: Cooking pancakes for the county show was the hands-on job nobody wanted to miss.
""".strip()


def docs(spark, *texts):
    return spark.createDataFrame(
        [("c", i, f"s{i}", t) for i, t in enumerate(texts)], "corpus_id string, doc_pos int, source_name string, text string"
    )


def test_segments(spark):
    text = "intro line\nsecond line\n\nAnn B.: hello there\nand more\n\nno label now\nurl: http://x y\nhttp://x stays here\nP1: a. P2: b"
    rows = segment.segments(docs(spark, text, " \n\t ")).orderBy("seg_pos").collect()
    assert [(r.speaker, r.text, r.source_line) for r in rows] == [
        ("Unknown", "intro line second line", 1),
        ("Ann B.", "hello there and more", 4),
        ("Unknown", "no label now", 7),
        ("url", "http://x y http://x stays here", 8),
        ("P1", "a. P2: b", 10),
    ]


def test_quotes_are_numbered_through_documents(spark):
    rows = segment.quote_units(
        docs(spark, "A: one two three four. too short now", "B: five six seven eight nine")
    ).orderBy("quote_idx").collect()
    assert [(r.quote_id, r.source_name, r.word_count) for r in rows] == [("Q0001", "s0", 4), ("Q0002", "s1", 5)]
    assert segment.quote_units(docs(spark, "")).count() == 0


def test_idf_and_unit_vectors(spark):
    q = segment.quote_units(docs(spark, GARDEN))
    tf = vec.terms(q)
    idf = {r.term: (r.df, round(r.idf, 6)) for r in vec.idf(tf, q).collect()}
    assert idf["compost"] == (2, 1.980829)
    assert idf["slugs"] == (1, 2.386294)
    w = vec.weights(tf, vec.idf(tf, q)).toPandas()
    assert np.allclose((w.weight**2).groupby(w.quote_idx).sum(), 1)


def vectors_of(rows):
    return cluster.Vectors(
        [list(r) for r in rows], [np.array(list(r.values())) / np.sqrt(sum(v * v for v in r.values())) for r in rows]
    )


def test_clustering_ways():
    v = vectors_of([{"a": 1}, {"a": 1, "b": 0.1}, {"z": 1}, {"z": 1, "y": 0.1}, {"m": 1}])
    found, big = cluster.cluster(v, Settings(theme_count=3))
    assert found == [[0, 1], [2, 3], [4]] and not big
    found, big = cluster.cluster(v, Settings(theme_count=3, agglomerative_limit=2))
    assert sorted(sorted(c) for c in found) == [[0, 1], [2, 3], [4]] and big
    found, _ = cluster.cluster(v, Settings(theme_count=3, min_theme_size=2))
    assert found == [[0, 1, 4], [2, 3]]
    assert [sorted(c) for c in cluster.cluster(v, Settings(theme_count=0))[0]] == [[0, 1, 2, 3, 4]]


def test_seeds_agree_with_dataframe_steps(spark):
    q = segment.quote_units(docs(spark, GARDEN))
    tf = vec.terms(q)
    w = vec.weights(tf, vec.idf(tf, q))
    got = [r.quote_idx for r in cluster.farthest_seeds(w, q, 3).orderBy("step").collect()]
    rows = w.toPandas().sort_values(["quote_idx", "term"])
    v = cluster.Vectors(
        [list(g.term) for _, g in rows.groupby("quote_idx")], [list(g.weight) for _, g in rows.groupby("quote_idx")]
    )
    assert got == [s + 1 for s in cluster.seeds(v, 3)]


@pytest.fixture(scope="module")
def clustered(spark):
    return analysis.analyze_texts(
        spark, [("plots.txt", GARDEN)], Settings(theme_count=3, quotes_per_theme=1, central_theme="compost drain")
    ).persist()


def test_clustered_analysis(clustered):
    r = clustered.first()
    assert (r.document_count, r.quote_count) == (1, 7)
    assert sum(t.quote_count for t in r.themes) == 7
    assert all(
        t.id[
            0
        ] == "T" and 0 <= t.score <= 1 and t.validation.displayed_quote_count == 1 <= t.validation.evidence_count for t in r.themes
    )
    assert r.themes[0].validation.central_theme_alignment > 0
    assert r.notes[-1] == "Central theme priority used: compost drain."
    assert len(r.validation_summary) == 4


def test_reports(clustered, tmp_path):
    md = reports.markdown(clustered).first().report
    for part in (
        "# Qualitative Thematic Coding Report", "## Summary", "## Validation Framework", "### Quote Evidence",
        "## Color-Coded Transcript Evidence", "## Notes"
    ):
        assert part in md
    assert md.endswith(".\n") and not md.endswith("\n\n")
    data = json.loads(reports.json_text(clustered).first().report)
    assert list(data)[:3] == ["version", "document_count", "quote_count"] and data["quote_count"] == 7
    rows = list(csv.DictReader(io.StringIO(reports.csv_text(clustered).first().report)))
    assert len(rows) == 3 and rows[0]["source_file"] == "plots.txt" and len(rows[0]["relevance"]) == 5
    reports.save(clustered, str(tmp_path / "sub" / "r.json"))
    assert json.loads((tmp_path / "sub" / "r.json").read_text())["themes"]
    assert analysis.theme_list(clustered).count() == 3
    assert "Quote evidence" in analysis.theme_detail(clustered, 1).first().detail


def test_codebook_analysis(spark):
    r = analysis.analyze_texts(spark, [("camp.txt", CAMP)]).first()
    assert all(t.id[0] == "C" for t in r.themes)
    assert {
        "ASD shapes 4-H participation", "Leader training and accommodations", "Useful hands-on 4-H activities"
    } <= {t.name for t in r.themes}
    assert r.themes[0].quotes[0].relevance <= 1
    plain = analysis.analyze_texts(spark, [("x", CAMP.replace("4-H", "club"))]).first()
    assert all(t.id[0] == "T" for t in plain.themes)


def test_no_quotes(spark):
    r = analysis.analyze_transcript(spark, "too short").first()
    assert (r.document_count, r.quote_count, r.themes) == (1, 0, []) and r.notes[-1] == "No quote-length text units were found."


def test_entered_settings(monkeypatch):
    monkeypatch.setattr(analysis, "analyze", lambda documents, settings, **more: settings)
    got = analysis.analyze_entered(None, "0", -3, "  compost ")
    assert (got.theme_count, got.quotes_per_theme, got.central_theme) == (1, 0, "compost")


def test_reports_of_several_corpora(spark, tmp_path):
    rows = [(c, 0, c, t) for c, t in (("a", CAMP), ("b", CAMP[:100]))]
    docs_ = spark.createDataFrame(rows, "corpus_id string, doc_pos int, source_name string, text string")
    result = analysis.analyze(docs_, Settings(theme_count=2), cluster_rest=False).persist()
    reports.save(result, str(tmp_path / "r.json"))
    assert sorted(f.name for f in tmp_path.iterdir()) == ["r-1.json", "r-2.json"]
    text = (tmp_path / "r-1.json").read_text()
    assert text == json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n"
    none = result.withColumn("themes", F.transform("themes", lambda t: t.withField("color", F.lit(None).cast("string"))))
    rows = list(csv.reader(io.StringIO(reports.csv_text(none).where("corpus_id = 'a'").first().report)))
    assert {len(r) for r in rows} == {11} and {r[3] for r in rows[1:]} == {""}


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(
            "word/document.xml",
            f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'
        )
    return out.getvalue()


def test_decoders():
    assert files.decode("a.txt", b"\xef\xbb\xbfone\r\ntwo") == "one\ntwo"
    assert files.decode("a.csv", b"caf\xe9") == "café"
    assert files.decode("a.DOCX", docx("one  two", "", "three")) == "one two\nthree"
    rtf = rb"{\rtf1{\fonttbl{\f0 Times New Roman;}}{\colortbl;\red0;}{\*\generator x;}\b Ann: h\'e9llo\par next \{x\}\pard}"
    assert files.decode("a.rtf", rtf) == "Ann: héllo\nnext x\nd"


def test_files_and_cli(spark, tmp_path, capsys):
    (tmp_path / "b.txt").write_text("Ann: frost killed the early tomatoes in every open bed.")
    (tmp_path / "a.docx").write_bytes(docx("Bob: a heated frame would save tomatoes from late frost."))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = files.read_files(spark, [str(tmp_path / n) for n in ("b.txt", "a.docx", "bad.docx")]).orderBy("doc_pos").collect()
    assert [r.source_name for r in got] == [
        "b.txt", "a.docx", "bad.docx"
    ] and got[2].text is None and "BadZipFile" in got[2].error
    out = tmp_path / "o" / "report.md"
    assert main([str(tmp_path / "b.txt"), str(tmp_path / "a.docx"), "--out", str(out), "--central-theme", "frost"]) == 0
    assert "Documents analyzed: 2" in capsys.readouterr().out and "Source: a.docx" in out.read_text()


def test_scalable_clusters_keeps_the_default_features(monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "_vectors", lambda *a, **b: (None, None, None))
    monkeypatch.setattr(catalog.cluster, "scalable", lambda *a, **b: seen.append((len(a), b)))
    catalog.scalable_clusters(None, "")
    assert seen == [(3, {})]

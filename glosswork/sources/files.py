"""Transcript files: plain text, DOCX and RTF, as documents of one corpus.

Files are read by Spark's binaryFile source and decoded in an Arrow function, one file a row; a
file that can't be decoded gives a null text and an error, and does not fail the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# RTF groups that hold no text.
RTF_SKIPPED = ("fonttbl", "colortbl", "stylesheet", "info")
FILE_KINDS = ("*.txt", "*.md", "*.csv", "*.docx", "*.rtf")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def tidy(text: str) -> str:
    """Runs of spaces and tabs are one space; none at the ends."""
    return re.sub("[ \t]+", " ", text).strip()


def decode_plain(content: bytes) -> str:
    """UTF-8 with or without mark, else Windows-1252; line ends become newlines."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("cp1252", errors="replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def decode_docx(content: bytes) -> str:
    """One line for each paragraph of the main document that has text; tables are included."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    marks = {"tab": "\t", "br": "\n"}
    lines = []
    for paragraph in body.iter(f"{WORD}p"):
        parts = ((node.tag.rpartition("}")[2], node.text or "") for node in paragraph.iter())
        lines.append(tidy("".join(text if kind == "t" else marks.get(kind, "") for kind, text in parts)))
    return "\n".join(filter(None, lines))


def without_groups(raw: str, names: Sequence[str] = RTF_SKIPPED) -> str:
    """RTF without the named groups; each leaves a space.  Braces after a backslash don't count."""
    opening = re.compile(r"\{\\([A-Za-z]+)")
    brace = re.compile(r"(?<!\\)[{}]")
    out, at = [], 0
    for found in opening.finditer(raw):
        if found.start() < at or found.group(1).lower() not in names:
            continue
        out += [raw[at : found.start()], " "]
        depth, at = 0, len(raw)
        # the group's own brace counts even where a backslash stands before it
        for b in brace.finditer(raw, found.start()):
            depth += 1 if b.group() == "{" else -1
            if depth == 0:
                at = b.end()
                break
    return "".join([*out, raw[at:]])


def decode_rtf(content: bytes) -> str:
    """Plain lines of an RTF file; blank lines go, so a label carries on over them."""
    text = without_groups(content.decode("cp1252", errors="replace").replace("\r\n", "\n").replace("\r", "\n"))
    steps = (
        (r"\\par|\\line", "\n"),
        (r"\\'([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", errors="replace")),
        (r"\\\{", "{"), (r"\\\}", "}"), (r"\\\\", r"\\"),
        (r"\{\\\*[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", " "),
        (r"\\[a-zA-Z]+-?\d* ?", ""),
        (r"[{}]", " "),
    )
    for pattern, new in steps:
        text = re.sub(pattern, new, text)
    return "\n".join(filter(None, map(tidy, text.splitlines())))


def decode(path: str, content: bytes) -> str:
    kind = path.lower().rpartition(".")[2]
    return {"docx": decode_docx, "rtf": decode_rtf}.get(kind, decode_plain)(content)


def decoded(files: DataFrame) -> DataFrame:
    """files(path, content) with text and error."""

    @F.pandas_udf("text string, error string")
    def read(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for p, c in zip(path, content):
            try:
                rows.append((decode(p, bytes(c)), None))
            except Exception as e:  # one bad file is a row's error
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return files.withColumn("__r", read("path", "content")).select(*files.columns, "__r.text", "__r.error")


def read_files(spark: SparkSession, paths: Sequence[str], corpus_id: str = "corpus") -> DataFrame:
    """(corpus_id, doc_pos, source_name, text, error): files in the order given, named by basename.

    paths: absolute, or with a scheme; a file given twice is two documents.
    """
    scheme = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"
    named = [(i, p.rpartition("/")[2], re.sub(scheme, "", p)) for i, p in enumerate(paths)]
    order = spark.createDataFrame(named, "doc_pos int, source_name string, given string")
    files = spark.read.format("binaryFile").load(list(dict.fromkeys(paths))).select("path", "content")
    plain = F.url_decode(F.replace(F.regexp_replace("path", F.lit(scheme), F.lit("")), F.lit("+"), F.lit("%2B")))
    rows = decoded(files).withColumn("given", plain).join(order, "given")
    return rows.select(F.lit(corpus_id).alias("corpus_id"), "doc_pos", "source_name", "text", "error")


def read_folder(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """All files of a folder that match; each subfolder is a corpus; files in order of their paths."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    rows = decoded(files.select("path", "content"))
    parts = F.split("path", "/")
    rows = rows.withColumns({"corpus_id": F.element_at(parts, -2), "source_name": F.element_at(parts, -1)})
    pos = F.row_number().over(Window.partitionBy("corpus_id").orderBy("path"))
    return rows.select("corpus_id", pos.alias("doc_pos"), "source_name", "text", "error")

"""Transcripts and reports as Spark data sources.

    register(spark)
    spark.read.format("transcripts").load("/data/interviews")           # a file or a folder, any depth
    spark.readStream.format("transcripts").load("/data/incoming")       # each file once, as it arrives
    report_lines(result).write.format("transcript_reports").option("suffix", ".md").mode("append").save("/data/out")

Files are listed and opened by pyarrow.fs in the tasks (local paths, and the URIs it knows: hdfs, s3,
gs); stores that only Spark's own readers reach are read by files.read_folder.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote as url_quote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)

from . import files, reports

#: Bytes of files that one task reads, about.
SPLIT = 64 << 20
SCHEMA = "path string, source_name string, modified timestamp, size bigint, text string, error string"


def opened(path: str):
    """(file system, path on it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


class Files(InputPartition):
    def __init__(self, paths):
        super().__init__(tuple(paths))
        self.paths = tuple(paths)


def listed(path: str, kinds: tuple[str, ...]):
    """(path, modification in ns, size) of the files of a kind below a folder, or of one file, in order."""
    from pyarrow import fs

    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    found = [f for f in found if f.type == fs.FileType.File and (not kinds or f.path.lower().endswith(kinds))]
    return sorted((f.path, f.mtime_ns or 0, f.size or 0) for f in found)


def planned(found, split: int = SPLIT) -> list[Files]:
    """Files in partitions of about `split` bytes; a larger file has its own."""
    out, held, size = [], [], 0
    for f in found:
        if held and size + f[2] > split:
            out.append(Files(held))
            held, size = [], 0
        held.append(f)
        size += f[2]
    return [*out, Files(held)] if held else out


def texts(root: str, partition: Files) -> Iterator[tuple]:
    """Rows of SCHEMA; a file that can't be read or decoded is a row's error."""
    import datetime as dt

    store, _ = opened(root)
    for path, modified, size in partition.paths:
        text = error = None
        try:
            with store.open_input_stream(path) as f:
                text = files.decode(path, f.read())
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        yield path, posixpath.basename(path), dt.datetime.fromtimestamp(modified / 1e9), size, text, error


class Transcripts(DataSource):
    """Options: path; kinds (suffixes, comma-joined; default those of transcripts); split (bytes a task)."""

    @classmethod
    def name(cls):
        return "transcripts"

    def schema(self):
        return SCHEMA

    def settings(self):
        kinds = self.options.get("kinds", ",".join(k[1:] for k in files.FILE_KINDS))
        return self.options["path"], tuple(k.strip().lower() for k in kinds.split(",") if k.strip()), int(self.options.get("split", SPLIT))

    def reader(self, schema):
        return Reader(*self.settings())

    def streamReader(self, schema):
        return StreamReader(*self.settings())


@dataclass
class Reader(DataSourceReader):
    path: str
    kinds: tuple
    split: int

    def partitions(self):
        return planned(listed(self.path, self.kinds), self.split)

    def read(self, partition):
        return texts(self.path, partition)


@dataclass
class StreamReader(DataSourceStreamReader):
    """New files by time of change; an offset is the last (time, path) that was taken, so files whose time is
    not after it are not seen again."""

    path: str
    kinds: tuple
    split: int

    def initialOffset(self):
        return {"modified": -1, "path": ""}

    def latestOffset(self):
        found = [(m, p) for p, m, _ in listed(self.path, self.kinds)]
        return dict(zip(("modified", "path"), max(found))) if found else self.initialOffset()

    def partitions(self, start, end):
        at = lambda o: (int(o["modified"]), o["path"])
        return planned([f for f in listed(self.path, self.kinds) if at(start) < (f[1], f[0]) <= at(end)], self.split)

    def read(self, partition):
        return texts(self.path, partition)


# --- reports


def report_lines(result: DataFrame, fmt: str = "markdown") -> DataFrame:
    """(corpus_id, line) of every corpus's report, each corpus in one partition and in order."""
    if fmt == "markdown":
        rows = reports.markdown_lines(result)
    elif fmt == "csv":
        rows = reports.csv_lines(result)
    else:
        lines = F.split(F.rtrim(F.col("report"), F.lit("\n")), "\n")
        rows = reports.json_text(result).select("corpus_id", F.posexplode(lines).alias("line_no", "line"))
    return rows.repartition("corpus_id").sortWithinPartitions("corpus_id", "line_no").select("corpus_id", "line")


@dataclass
class Written(WriterCommitMessage):
    files: list


class Reports(DataSource):
    """Options: path, a folder; suffix of the files (default .md)."""

    @classmethod
    def name(cls):
        return "transcript_reports"

    def schema(self):
        return "corpus_id string, line string"

    def writer(self, schema, overwrite):
        return ReportWriter(self.options["path"], self.options.get("suffix", ".md"), overwrite)


@dataclass
class ReportWriter(DataSourceWriter):
    """One file a corpus, named by its id; lines are written as they come, under names of the task, which
    become the files' own once all tasks have succeeded."""

    path: str
    suffix: str
    overwrite: bool

    def write(self, iterator):
        import uuid

        store, root = opened(self.path)
        folder = f"{root}/_temporary"
        store.create_dir(folder)
        done, out, now, blank = [], None, None, 0
        try:
            for row in iterator:
                if out is None or row.corpus_id != now:
                    if out is not None:
                        out.close()
                    now, blank = row.corpus_id, 0
                    name = url_quote(now or "", safe=" ") or "_"
                    done.append((f"{folder}/{uuid.uuid4().hex}", f"{root}/{name}{self.suffix}"))
                    out = store.open_output_stream(done[-1][0])
                if row.line.strip():  # blank lines wait, as none stand at a report's end
                    out.write(("\n" * blank + row.line + "\n").encode())
                    blank = 0
                else:
                    blank += 1
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages):
        from pyarrow import fs

        store, root = opened(self.path)
        made = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            keep = {name for _, name in made}
            for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.type == fs.FileType.File and f.path.endswith(self.suffix) and f.path not in keep:
                    store.delete_file(f.path)
        for temporary, name in made:
            store.move(temporary, name)
        self._clear(store, root)

    def abort(self, messages):
        self._clear(*opened(self.path))

    def _clear(self, store, root):
        from pyarrow import fs

        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")


def register(spark: SparkSession) -> None:
    for source in (Transcripts, Reports):
        spark.dataSource.register(source)

"""Helpers of the operators: reliable checkpoints, packed exchanges, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of an Arrow batch: whole documents go to Python, so batches are kept small.
ARROW_ROWS = 200


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting for the jobs that run inside; the session's own comes back, also after an error."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settled(spark: SparkSession):
    """Small Arrow batches for the jobs that run inside, as rows hold whole texts or packed blocks."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextlib.contextmanager
def scratch():
    """A list of tables of written() that are deleted at the end, also after an error."""
    tables: list[DataFrame] = []
    try:
        yield tables
    finally:
        discard(*tables)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local run (as in tests) gets a temporary folder; on a cluster that is
    an error, as each executor would write to its own disk."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have and (found := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        have = found.get()
    if not have:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(have)
    return have


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, clean: bool = False) -> DataFrame:
    """Computes df once into a Parquet table of the shared folder; for wide rows.

    clean: its shuffle files go when the job ends.  Only for plans all of whose stages are read to
    the end: Spark would also take the files from a stage that still runs when a limit is reached
    or a join turns out empty.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", str(clean).lower()):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that no result reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, text, rest): its other columns are the struct rest's c0, c1, ..., so that none
    clashes with an operator's own names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)] or [F.lit(0).alias("none")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("rest"))


def column_of(docs: DataFrame):
    """A function (batch, name) that gives a column of docs from an Arrow batch of packed(docs)."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return lambda batch, name: batch.column("rest").field(others.index(name)) if name in others else batch.column(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- packed exchanges -----------------------------------------------------------------
# Billions of small records (a hash and where it came from) are packed by the sender into
# one binary block per target, so that the shuffle moves bytes, not rows.

PACKED = "part int, block binary"


def hashed_int(x: int, seed: int = 42) -> int:
    """Spark's hash of an int (Murmur3, x86, 32 bits)."""
    m = 0xFFFFFFFF
    k = (x * 0xCC9E2D51) & m
    k = ((k << 15 | k >> 17) & m) * 0x1B873593 & m
    h = seed ^ k
    h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def part_keys(n: int) -> np.ndarray:
    """For each of n shuffle partitions, an int that Spark deals to it."""
    out, left, x = np.full(n, -1, np.int64), n, 0
    while left:
        p = hashed_int(x) % n
        if out[p] < 0:
            out[p], left = x, left - 1
        x += 1
    return out


def part_of(h, n):
    """A part 0..n-1 from the upper bits of 64-bit hashes."""
    return (((h >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)).astype(np.int64)


def pack(part, columns, n_parts):
    """(part, columns) of each part that has entries, in their order."""
    order = np.argsort(part.astype(np.uint16) if n_parts <= 1 << 16 else part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=n_parts))
    moved = [c[order] for c in columns]
    at = 0
    for p in np.flatnonzero(np.diff(ends, prepend=0)):
        to = int(ends[p])
        yield int(p), [c[at:to] for c in moved]
        at = to


def runs(x):
    """Starts and lengths of the runs of equal values."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    return start, np.diff(np.append(start, len(x)))


def dense(x):
    """Numbers of the runs of equal values."""
    return np.cumsum(np.append(False, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def block(arrays):
    """bytes: the length of every array, then the arrays."""
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unblock(data, kinds):
    n = np.frombuffer(data, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for k, kind in zip(n, kinds):
        out.append(np.frombuffer(data, kind, int(k), at))
        at += int(k) * np.dtype(kind).itemsize
    return out


def packed_batch(parts, blocks):
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])


def dealt(df: DataFrame, n: int) -> DataFrame:
    """The blocks of a part together in one task."""
    return df.repartition(n, "part")


def by_part(batches):
    """The blocks of a task, by part."""
    held: dict[int, list] = {}
    for batch in batches:
        for p, b in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(p, []).append(b.as_py())
    while held:
        yield held.popitem()


# --- connected components ------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: pairs of long ids; loops, repeats and either order are allowed.  Returns
    (node, component) for every node of an edge, component being the smallest id that can be
    reached.  A star step needs only a minimum per node (aggregated before the shuffle) and an
    equi-join that can be split where a node is hot; no neighbourhood is collected.
    """
    spark = edges.sparkSession
    pairs = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    last, n = None, partitions(spark)
    while True:
        # large star: every larger neighbour of u links to the smallest id near u
        both = pairs.select("u", "v").union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        least = least.repartition(n)  # apart from the sums, so that the join can split the hub of a star
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = cut(small)
        found = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == last:
            break
        last = found
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )

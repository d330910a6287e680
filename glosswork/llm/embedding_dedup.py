"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, components.

Vectors are compared within their label.  Equal vectors are one class first, so copies cost one
row.  In each of several tables a class is hashed to the signs of random projections; classes
that share a bucket are compared exactly, in double precision, by blocked matrix products, and a
pair that meets in several tables counts in the first only.  The number of signs follows the
number of classes, so that a bucket of unrelated vectors holds about FILL of them at any size; the
number of tables follows from it, so that a pair at the threshold, whose signs agree with
probability 1 - angle / pi each, is missed by all tables with probability MISS at most.  Buckets
are cut into blocks of about 4 * sqrt(n) classes, and pairs of blocks are compared in different
tasks.  Of a pair of blocks come one count per linked class and a spanning forest of its links, not
all pairs; distributed connected components then join the forests.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows with
null label, link with nothing; vectors of different length do not link; a null vec_id is kept,
links with nothing and has no component; repeated rows are classes of equal vectors; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import shared

THRESHOLD = 0.98
FILL, MISS = 32, 5e-4
BLOCK_LEAST, BLOCK_MOST = 128, 2048
SEED = 20240


def shape(classes: int, threshold=THRESHOLD) -> tuple[int, int]:
    """(signs, tables) for so many classes of a label."""
    bits = int(np.clip(np.ceil(np.log2(max(classes, 1) / FILL)), 6, 40))
    meet = (1 - np.arccos(threshold) / np.pi) ** bits
    return bits, int(np.ceil(np.log(MISS) / np.log1p(-meet)))


def planes(dim, bits, tables):
    return np.random.default_rng(SEED + dim).standard_normal((dim, bits * tables))


def signatures(x, bits, tables):
    """(rows, tables) bucket numbers of unit vectors."""
    on = (x @ planes(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return on.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def unit(x):
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column):
    """A list column whose rows have one length as a double matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def forest(a, b, ids):
    """A spanning forest of links (places a[i], b[i]) as pairs of ids."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(ids[i]), int(ids[j])))
    return out


def link(vectors: DataFrame, threshold=THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label)."""
    with shared.settled(vectors.sparkSession), shared.scratch() as tables:
        return _linked(vectors, threshold, tables)


def _linked(vectors, threshold, scratch):
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = F.exists("x", lambda c: c != 0.0)
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & some, F.lit(False))
    v = v.withColumn("x", F.when(good, F.transform("x", lambda c: c + F.lit(0.0))))
    member = v.select(
        "vec_id", "label", F.when(good, F.struct(F.xxhash64("x").alias("a"), F.xxhash64(F.lit(7), "x").alias("b"))).alias("h"),
        "x"
    )
    classes = shared.cut(
        member.where("h is not null").groupBy("label", "h").agg(
            F.min("vec_id").alias("cls"), F.count("*").alias("size"), F.first("x").alias("x"), F.size(F.first("x")).alias("dim")
        )
    )
    most = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = shape(most, threshold)

    def keys(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                x = matrix(own.column("x"))
                sig = signatures(unit(x), bits, tables)
                n = len(x)
                pick = pa.array(np.tile(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays(
                    [own.column(c).take(pick) for c in ("label", "cls", "size", "dim")]
                    + [
                        pa.array(np.repeat(np.arange(tables), n).astype(np.int32)), pa.array(sig.T.ravel()),
                        kernel_binary(x).take(pick)
                    ],
                    ["label", "cls", "size", "dim", "t", "sig", "x"],
                )

    def kernel_binary(x):
        return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())

    label = dict(classes.dtypes)["label"]
    hashed = classes.select("label", "cls", "size", "dim", "x").mapInArrow(
        keys, f"label {label}, cls long, size long, dim int, t int, sig long, x binary"
    )
    hashed = shared.written(hashed)
    scratch.append(hashed)
    bucket = ["label", "dim", "t", "sig"]
    full = hashed.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    block = F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_MOST), 4 * F.sqrt("n")))
    full = full.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = hashed.join(full, bucket)
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    rows = rows.withColumn("task", F.pmod(F.xxhash64(*bucket, "p", "q"), F.lit(1 << 20)).cast("int"))

    def compare(batches):
        """Groups arrive sorted, whole, one after the other."""
        held, now = [], None
        for batch in batches:
            k = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "dim", "t", "sig", "p", "q")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in k], axis=0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                key = tuple(c[a] for c in k)
                if key != now and held:
                    yield from compared(pa.Table.from_batches(held), now)
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from compared(pa.Table.from_batches(held), now)

    def compared(table, key):
        _, dim, t, _, p, q = key
        ids, size, own = (table.column(c).to_numpy() for c in ("cls", "size", "own"))
        if len(ids) < 2:
            return
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(len(ids), -1)
        norm = np.sqrt((x * x).sum(axis=1))
        left = np.flatnonzero(own == p)
        right = left if p == q else np.flatnonzero(own == q)
        links, a, b = np.zeros(len(ids), np.int64), [], []
        sig = None
        for at in range(0, len(left), 500):
            rows = left[at : at + 500]
            cos = (x[rows] @ x[right].T) / (norm[rows][:, None] * norm[right][None, :])
            i, j = np.nonzero(cos >= threshold)
            i, j = rows[i], right[j]
            if p == q:
                i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]
            if t and len(i):  # a pair counts in the first table where it meets
                sig = signatures(unit(x), bits, tables)[:, :t] if sig is None else sig
                new = ~(sig[i] == sig[j]).any(axis=1)
                i, j = i[new], j[new]
            links += np.bincount(i, size[j], len(ids)).astype(np.int64) + np.bincount(j, size[i], len(ids)).astype(np.int64)
            a.append(i)
            b.append(j)
        if not links.any():
            return
        tree = forest(np.concatenate(a), np.concatenate(b), ids)
        some = np.flatnonzero(links)
        one = [int(v) for v in ids[some]] + [e[0] for e in tree]
        other = [None] * len(some) + [e[1] for e in tree]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(one, pa.int64()), pa.array(other, pa.int64()),
                pa.array(links[some].tolist() + [0] * len(tree), pa.int64())
            ], ["a", "b", "n"]
        )

    order = ["task", "label", "dim", "t", "sig", "p", "q"]
    found = rows.select(
        *order, "own", "cls", "size", "x"
    ).repartition(shared.partitions(spark), "task").sortWithinPartitions(*order)
    found = shared.cut(found.mapInArrow(compare, "a long, b long, n long"))
    n = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    comp = shared.cut(shared.components(found.where("b is not null").select("a", "b")))
    known = classes.join(n, "cls", "left").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    known = known.select(
        "label", "h", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "cls").alias("component_id")
    )
    out = member.select("vec_id", "label", "h").join(known, ["label", "h"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(
            "component_id", "vec_id"
        ).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

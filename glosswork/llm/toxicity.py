"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, binary: its words (A-Z lower-cased), their first four and five bytes (which
stand for inflected forms), word pairs and word pairs with one word between, hashed to 2**bits
buckets.  FTRL-proximal (per-coordinate rates, L1) is fitted on
a bounded sample of the labelled rows; L1 leaves a sparse weight vector, which goes to the
executors as index and value arrays of at most 2**bits entries.

Defined cases: a null or empty text has the intercept's score; rows whose doc_id or label is
null are not learned from; repeated rows are scored alike; an empty table gives no rows; without
labelled rows every score is 0.  Other columns are passed through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import kernel, shared

#: Rows of the learning sample: the labelled rows with the smallest hash of doc_id, half of them
#: toxic where there are as many.
SAMPLE_ROWS = 5_000
#: Features of the sample at most, 4 bytes each on the driver.  Parts of the sample are read one by one, by id
#: within a part, until it is full; the rows behind are left out, of whichever label (one row is always taken).
SAMPLE_FEATURES = 25_000_000
BITS = 20
CHUNK = 2 << 20
STEMS = (4, 5)


def beginnings(words, n):
    """Hash of the first n bytes of every word."""
    out = np.full(len(words.start), n, kernel.U)
    for k in range(n):
        at = words.start + k
        out = out * kernel.U(257) + np.where(
            at < words.end, words.data[np.minimum(at, len(words.data) - 1)], 0
        ).astype(kernel.U)
    return kernel.mix(out)


def features(array, bits):
    """(row, bucket) of every distinct feature of each row."""
    words = kernel.Words(array, lower=True)
    h, rows, row = words.hash, words.rows, words.row_of()
    pair_ok, skip_ok = kernel.window_rows(rows, 2), kernel.window_rows(rows, 3)
    shift = kernel.U(64 - bits)
    pair = kernel.mix(h[:-1] * kernel.U(3) + h[1:] * kernel.U(5))[pair_ok] >> shift
    skip = kernel.mix(h[:-2] * kernel.U(7) + h[2:] * kernel.U(11))[skip_ok] >> shift
    stems = [beginnings(words, n) >> shift for n in STEMS]
    key = np.concatenate([h >> shift, *stems, pair, skip]).astype(np.int64)
    row = np.concatenate([row] * (1 + len(stems)) + [row[: len(pair_ok)][pair_ok], row[: len(skip_ok)][skip_ok]])
    return row, key


class Ftrl:
    """FTRL-proximal with logistic loss; one pass is one update per example."""

    def __init__(self, bits=BITS, alpha=0.3, beta=1.0, l1=4.0, l2=1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at):
        z, n = self.z[at], self.n[at]
        return np.where(
            np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        )

    def learn(self, at, y):
        """at: distinct buckets; the last bucket is the intercept."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g

    def sparse(self):
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at].astype(np.float32)


def sample_of(labels: DataFrame, label: str, keep, rows: int, halves=False) -> DataFrame:
    """A bounded sample of labelled rows: those with the smallest hash of their id; with halves,
    at most half as many of either label."""
    picked = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
    picked = picked.where(F.col("__id").isNotNull() & F.col("__y").isNotNull())
    if keep is not None:
        picked = picked.where(keep(F.col("__id")))
    order = [F.xxhash64("__id"), "__id", "__y"]
    if not halves:
        return picked.orderBy(*order).limit(rows)
    one, other = (picked.where(F.col("__y") == y).orderBy(*order).limit(rows // 2) for y in (0, 1))
    return one.unionByName(other)


def fit(docs: DataFrame, labels: DataFrame, label="toxic", keep=None, rows=SAMPLE_ROWS, bits=BITS, passes=6):
    """Sparse weights (index, value).  keep: which doc_id may be learned from."""

    def run(batches):
        for batch in kernel.chunks(batches, "text", CHUNK):
            row, key = features(batch.column("text"), bits)
            both = np.unique((row << bits) | key)
            cut = np.searchsorted(both >> bits, np.arange(batch.num_rows + 1))
            keys = (both & ((1 << bits) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__y"), kernel.binary([keys[i:j].tobytes() for i, j in zip(cut, cut[1:])])],
                ["id", "y", "keys"],
            )

    some = docs.select(F.col("doc_id").alias("__id"), "text").join(
        F.broadcast(sample_of(labels, label, keep, rows, True)), "__id"
    )
    found = some.mapInArrow(run, "id long, y int, keys binary").repartition(16, "id")
    found = found.sortWithinPartitions("id", "y", "keys")
    got, size = [], 0
    for r in found.toLocalIterator():  # one part at a time, until the sample is full
        size += len(r["keys"]) // 4
        if got and size > SAMPLE_FEATURES:
            break
        got.append((r.id, r.y, bytes(r["keys"])))
    got.sort()
    order = np.random.default_rng(0).permutation(len(got))
    model, bias = Ftrl(bits), np.array([1 << bits])
    for _ in range(passes):
        for i in order:
            model.learn(np.concatenate([np.frombuffer(got[i][2], np.int32), bias]), got[i][1])
    return model.sparse()


def score(docs: DataFrame, weights, bits=BITS, column="score") -> DataFrame:
    """docs with a double column in 0..1; every text is read whole."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != column] + [T.StructField(column, T.DoubleType())])
    names, own = [f.name for f in schema.fields[:-1]], shared.column_of(docs)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        at, values = sent.value
        dense = np.zeros((1 << bits) + 1, np.float32)
        dense[at] = values
        used = dense != 0
        for batch in kernel.chunks(batches, "text", CHUNK):
            row, key = features(batch.column("text"), bits)
            hit = used[key]
            both = np.unique((row[hit] << bits) | key[hit])
            total = np.bincount(both >> bits, dense[both & ((1 << bits) - 1)], batch.num_rows) + float(dense[-1])
            out = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([own(batch, n) for n in names] + [pa.array(out)], names + [column])

    return shared.packed(docs).mapInArrow(run, schema)

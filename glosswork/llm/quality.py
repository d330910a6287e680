"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes hashed counts of its words (A-Z lower-cased) and of their last three bytes, and the
counts of words that repeat the one before and of words without a letter, weighted log(1+tf)*idf,
projected on the leading singular directions of a bounded labelled sample, and scaled to unit
length.  The document frequencies behind idf are counted over all documents.  The sample's vectors and labels are sent to the executors
(rows * dims values, both parameters); each block of documents is compared with all of them by
one matrix product, and the nearest vote with weight cosine**power.

Defined cases: a null or empty text, or one with no known feature, gets the sample's mean label;
rows with null doc_id or label are not learned from; ties of similarity go to the earlier sample
row; an empty table gives no rows; without labelled rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import kernel, shared
from .toxicity import sample_of

SAMPLE_ROWS = 3_000
DIMS = 64
WORD_BITS, END_BITS = 12, 10
#: Buckets of repeated and of letterless words, which weigh GAIN times as much.
REPEATED, LETTERLESS = (1 << WORD_BITS) + (1 << END_BITS), (1 << WORD_BITS) + (1 << END_BITS) + 1
WIDTH = LETTERLESS + 1
GAIN = 4
NEAREST = 15
POWER = 4.0
CHUNK = 2 << 20
BLOCK = 64


def counted(array):
    """(row, bucket) of every word and word end, as one flat key row * WIDTH + bucket."""
    words = kernel.Words(array, lower=True)
    row = words.row_of()
    end = words.end
    tail = np.zeros(len(end), kernel.U)
    for k in (3, 2, 1):
        at = end - k
        ok = at >= words.start
        tail = tail * kernel.U(257) + np.where(ok, words.data[np.maximum(at, 0)], 0).astype(kernel.U)
    tail = (kernel.mix(tail + kernel.U(1)) >> kernel.U(64 - END_BITS)).astype(np.int64) + (1 << WORD_BITS)
    key = (words.hash >> kernel.U(64 - WORD_BITS)).astype(np.int64)
    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])) + 1
    letters = np.concatenate([[0], np.cumsum(words.data >= 65)])
    bare = np.flatnonzero(letters[words.end] == letters[words.start])
    return np.concatenate([row * WIDTH + key, row * WIDTH + tail, row[same] * WIDTH + REPEATED, row[bare] * WIDTH + LETTERLESS])


def tables(array):
    """Dense count blocks of BLOCK rows at most."""
    keys = counted(array)
    row = keys // WIDTH
    for at in range(0, len(array), BLOCK):
        to = min(len(array), at + BLOCK)
        own = keys[(row >= at) & (row < to)] - at * WIDTH
        yield np.bincount(own, minlength=(to - at) * WIDTH).reshape(to - at, WIDTH)


def nearest(near, k):
    """(rows, k) columns of the k largest values of each row; of equal ones the first."""
    least = np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]
    more, same = near > least, near == least
    more |= same & (np.cumsum(same, axis=1) <= k - more.sum(axis=1, keepdims=True))
    return np.nonzero(more)[1].reshape(len(near), k)


class Model:
    def __init__(self, idf, basis, vectors, labels):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    @staticmethod
    def scaled(x):
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)

    def embed(self, table):
        return self.scaled((self.scaled(np.log1p(table, dtype=np.float32) * self.idf)) @ self.basis)

    def vote(self, table):
        base = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(table), base)
        mine = self.embed(table)
        near = mine @ self.vectors.T
        best = nearest(near, min(NEAREST, near.shape[1]))
        weight = np.clip(np.take_along_axis(near, best, 1), 0, 1).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        out = (weight * self.labels[best]).sum(axis=1)
        return np.where(total > 1e-12, np.divide(out, total, out=np.zeros_like(out), where=total > 1e-12), base)


def frequencies(docs: DataFrame):
    """The number of rows with a text, and for each bucket the number of those that have it."""

    def run(batches):
        rows, total = 0, np.zeros(WIDTH, np.int64)
        for batch in kernel.chunks(batches, "text", CHUNK):
            rows += batch.num_rows
            keys = np.sort(counted(batch.column("text")))
            total += np.bincount(keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]] % WIDTH, minlength=WIDTH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["bucket", "n"])

    texts = docs.select("text").where("text is not null")
    got = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = {r.bucket: r.n for r in got}
    return n.get(-1, 0), np.array([n.get(i, 0) for i in range(WIDTH)], np.int64)


def fit(docs: DataFrame, labels: DataFrame, label="quality", keep=None, rows=SAMPLE_ROWS, dims=DIMS) -> Model:

    def run(batches):
        for batch in kernel.chunks(batches, "text", CHUNK):
            got = [t for table in tables(batch.column("text")) for t in table]
            at = [np.flatnonzero(t).astype(np.int32) for t in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"), batch.column("__y"),
                    kernel.binary([shared.block([i, t[i].astype(np.int32)]) for i, t in zip(at, got)])
                ],
                ["id", "y", "counts"],
            )

    some = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(sample_of(labels, label, keep, rows)), "__id")
    got = sorted((r.id, r.y, bytes(r["counts"])) for r in some.mapInArrow(run, "id long, y int, counts binary").collect())
    y = np.array([g[1] for g in got], np.float64)
    x = np.zeros((len(got), WIDTH), np.float32)
    for i, g in enumerate(got):
        at, n = shared.unblock(g[2], (np.int32, np.int32))
        x[i, at] = n
    if not len(got):
        return Model(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y)
    n, df = frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    idf[[REPEATED, LETTERLESS]] *= GAIN
    weighted = Model.scaled(np.log1p(x) * idf)
    # leading right singular vectors by subspace iteration from a fixed start
    basis = np.random.default_rng(7).standard_normal((WIDTH, min(dims + 8, len(got), WIDTH))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, turn = np.linalg.svd(weighted @ basis, full_matrices=False)
    basis = np.ascontiguousarray((basis @ turn.T)[:, :dims])
    model = Model(idf, basis, None, y)
    model.vectors = model.scaled(weighted @ basis)
    return model


def score(docs: DataFrame, model: Model, column="score") -> DataFrame:
    """docs with a double column in 0..1; every text is read whole."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != column] + [T.StructField(column, T.DoubleType())])
    names, own = [f.name for f in schema.fields[:-1]], shared.column_of(docs)
    sent = docs.sparkSession.sparkContext.broadcast((model.idf, model.basis, model.vectors, model.labels))

    def run(batches):
        model = Model(*sent.value)
        for batch in kernel.chunks(batches, "text", CHUNK):
            out = np.concatenate([model.vote(t) for t in tables(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([own(batch, n) for n in names] + [pa.array(out)], names + [column])

    return shared.packed(docs).mapInArrow(run, schema)

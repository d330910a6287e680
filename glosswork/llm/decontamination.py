"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are taken as in kernel.Words, A-Z lower-cased.  Seeds are all word n-grams of the test
items: which of them an edit leaves intact can't be told from their frequencies, so none is cut.
A fixed-size Bloom filter of seeds lets the scan of the corpus skip everything else; hits that
lie close together form a passage, which is joined with the items by an exact equi-join on seeds
and aligned to each of them by Smith-Waterman on words (match 2, mismatch -1, gap -1, local).
One seed is enough.  A passage reaches as far on both sides of its hits as an alignment that
reaches the threshold can: m words of an item match at most, so it has 2 * m * (1 - threshold)
errors and (3 - 2 * threshold) * m words at most.
score = alignment / (2 * words of the item), 1 for a verbatim copy.

Defined cases: null or empty texts and items match nothing; an item of fewer than n words is one
seed, its whole sequence; null ids are dropped, as they can't be reported; repeated documents or
items give one row for each pair of ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel, shared

N = 3
#: Bits of the Bloom filter; its size, 2 MB, does not depend on the data.
BLOOM_BITS = 24
GAP = 48
THRESHOLD = 0.5
CHUNK = 2 << 20


def grams(words, n):
    """(hash of every n-gram, its first word, its row); shorter rows give their whole sequence."""
    h, rows = words.hash, words.rows
    ok = kernel.window_rows(rows, n)
    first = np.flatnonzero(ok)
    out = kernel.windows(h, n)[first]
    row = np.searchsorted(rows, first, "right") - 1
    count = np.diff(rows)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        sums = kernel.prefix(h, kernel.BASE_WORDS)
        out = np.concatenate([out, kernel.ranges(sums, rows[short], rows[short] + count[short], kernel.BASE_WORDS)])
        first, row = np.concatenate([first, rows[short]]), np.concatenate([row, short])
    return out, first, row


def items_of(benchmark: DataFrame, n=N) -> DataFrame:
    """(item_id, words as packed hashes, seeds): one row for each item with words."""

    def run(batches):
        for batch in kernel.chunks(batches, "text", CHUNK):
            words = kernel.Words(batch.column("text"), lower=True)
            h, _, row = grams(words, n)
            own = [h[row == i].view(np.int64) for i in range(batch.num_rows)]
            packed = [words.hash[a:b].tobytes() for a, b in zip(words.rows, words.rows[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id"), kernel.binary(packed), pa.array(own, pa.list_(pa.int64()))
                ], ["item_id", "words", "seeds"]
            )

    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").dropDuplicates()
    return rows.mapInArrow(run, "item_id long, words binary, seeds array<long>").where("size(seeds) > 0")


def bloom(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of two probes for each hash; at most 2**BLOOM_BITS / 64 rows come to the driver."""
    mask = (1 << BLOOM_BITS) - 1
    at = hashes.select(
        F.explode(F.array(F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, 32).bitwiseAND(mask))).alias("p")
    )
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    got = words.toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def probe(bits, h):
    mask = kernel.U((1 << BLOOM_BITS) - 1)
    return (bits[(h & mask).astype(np.int64)] & bits[((h >> kernel.U(32)) & mask).astype(np.int64)]).astype(bool)


def align(passage, item):
    """Best local alignments of pairs: (score, first and last word of the passage's part).

    passage, item: lists of hash arrays, padded here; rows of the dynamic program are vectors
    over passage words and pairs.
    """
    n, m = max(map(len, passage)), max(map(len, item))
    p, q = np.zeros((len(passage), n), kernel.U), np.ones((len(item), m), kernel.U)
    for i, (a, b) in enumerate(zip(passage, item)):
        p[i, : len(a)], q[i, : len(b)] = a, b
    h, s = np.zeros((len(p), n + 1), np.int32), np.tile(np.arange(n + 1), (len(p), 1))
    best, first, last = np.zeros(len(p), np.int32), np.zeros(len(p), np.int64), np.full(len(p), -1, np.int64)
    ramp, every = np.arange(n + 1, dtype=np.int32), np.arange(len(p))
    for j in range(m):
        diag = h[:, :-1] + np.where(p == q[:, j : j + 1], 2, -1)
        up = h[:, 1:] - 1
        t, ts = np.zeros_like(h), np.tile(np.arange(n + 1), (len(p), 1))
        t[:, 1:], ts[:, 1:] = np.maximum(diag, up), np.where(diag >= up, s[:, :-1], s[:, 1:])
        ts = np.where(t > 0, ts, ramp)
        t = np.maximum(t, 0)
        # a gap in the item: the best start to the left, one less a word
        lead = t + ramp
        run = np.maximum.accumulate(lead, axis=1)
        source = np.maximum.accumulate(np.where(lead == run, ramp, 0), axis=1)
        h, s = run - ramp, np.take_along_axis(ts, source, 1)
        at = h.argmax(axis=1)
        top = h[every, at]
        more = top > best
        best, first, last = np.where(more, top, best), np.where(more, s[every, at], first), np.where(more, at - 1, last)
    return best, first, last


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold=THRESHOLD, n=N) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): the best alignment of each pair of ids
    whose score reaches the threshold; word numbers count from 0 in the document."""
    spark = docs.sparkSession
    with shared.settled(spark):
        items = shared.cut(items_of(benchmark, n))
        longest = items.agg(F.max(F.length("words"))).first()[0] or 0
        pad = int(np.ceil((longest // 8) * max(1.0, 3 - 2 * threshold)))
        seeds = shared.cut(items.select("item_id", F.explode("seeds").alias("h")).distinct())
        seed_bits = spark.sparkContext.broadcast(np.packbits(bloom(seeds, "h")))
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")

    def passages(batches):
        bits = np.unpackbits(seed_bits.value)
        for batch in kernel.chunks(batches, "text", CHUNK):
            words = kernel.Words(batch.column("text"), lower=True)
            h, first, row = grams(words, n)
            hit = np.flatnonzero(probe(bits, h))
            hit = hit[np.argsort(first[hit], kind="stable")]
            h, first, row = h[hit], first[hit], row[hit]
            new = np.ones(len(h), bool)
            new[1:] = (row[1:] != row[:-1]) | (first[1:] - first[:-1] > GAP)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(h))
            if not len(begin):
                continue
            low = np.maximum(words.rows[row[begin]], first[begin] - pad)
            high = np.minimum(words.rows[row[begin] + 1], first[end - 1] + n + pad)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row[begin])),
                    pa.array(low - words.rows[row[begin]]),
                    kernel.binary([words.hash[a:b].tobytes() for a, b in zip(low, high)]),
                    pa.array([np.unique(h[a:b]).view(np.int64) for a, b in zip(begin, end)], pa.list_(pa.int64())),
                ],
                ["doc_id", "low", "passage", "hits"],
            )

    with shared.settled(spark):
        hit = texts.mapInArrow(passages, "doc_id long, low long, passage binary, hits array<long>")
        found = shared.cut(hit.withColumn("at", F.xxhash64("passage")))
    key = ["doc_id", "low", "at"]
    links = found.select(*key, F.explode("hits").alias("h")).join(seeds, "h").select(*key, "item_id").distinct()
    sizes = items.select("item_id", "words")
    pairs = links.join(sizes, "item_id").join(found.select(*key, "passage").dropDuplicates(key), key)

    def score(batches):
        for batch in batches:
            a = [np.frombuffer(x.as_py(), kernel.U) for x in batch.column("passage")]
            b = [np.frombuffer(x.as_py(), kernel.U) for x in batch.column("words")]
            size = np.array([len(x) for x in a], np.int64)
            order = np.argsort(size, kind="stable")
            best, first, last = (np.zeros(len(a), np.int64) for _ in range(3))
            at = 0
            while at < len(order):
                to = at + max(1, min(128, (1 << 18) // int(size[order[min(at + 127, len(order) - 1)]] + 1)))
                own = order[at:to]
                best[own], first[own], last[own] = align([a[i] for i in own], [b[i] for i in own])
                at = to
            need = np.array([2 * len(x) for x in b])
            low = batch.column("low").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("item_id"), pa.array(best / np.maximum(need, 1)),
                    pa.array(low + first), pa.array(low + last)
                ],
                ["doc_id", "item_id", "score", "first_word", "last_word"],
            )

    scored = pairs.select("doc_id", "item_id", "low", "passage", "words").mapInArrow(
        score, "doc_id long, item_id long, score double, first_word long, last_word long"
    )
    best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), F.col("last_word").alias("l"))).alias("b")
    out = scored.where(F.col("score") >= threshold).groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "b.score", (-F.col("b.f")).alias("first_word"), F.col("b.l").alias("last_word"))

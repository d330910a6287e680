"""Windows of a sequence that occur earlier in a corpus: difference-cover anchors, then buckets.

Shared by the byte-wise and the word-wise operator.  A row's text is a sequence of units; a
window is `width` consecutive units.  The result is, for every row, the starts of the windows
that also start earlier.

1. Anchors.  A difference cover D modulo v has, for any two places i and j, a shift s < v such
   that i+s and j+s both lie in D modulo v.  So two equal windows share an aligned anchor: an
   equal run of width-v+1 units that starts at a cover place of both rows.  Only anchors at
   cover places are hashed and grouped; an anchor alone in its group rules windows out.
2. Buckets.  Windows that hold an anchor with company extend it: their whole content is hashed
   (64 bits) and grouped, one bucket of the hash range at a time, so that a bucket's entries are
   all that is on disk; in each group the earliest start stays, the others are reported.

Entries travel as packed blocks (see shared); nothing is emitted per pair.  A chunk decides what it
can by itself before anything is sent: of an anchor that has company within the chunk one entry
goes to the anchor's task, and of a window only the chunk's earliest; the others are known, and go
straight to their row's task.  So a passage that a third of all rows hold sends one entry a chunk,
not one a row, to the task of its hash.  The number of tasks follows the size of the texts.

Windows are compared by 64 bits of a polynomial hash and rows are identified by a 64-bit hash of
(order key, text): equal rows have equal results and count once.  Among m different candidate
windows about m * m / 4e19 pairs are taken for equal by chance: none expected below some 1e9 of
them, about 3 among 1e10.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel, shared

CHUNK = 1 << 20
#: Bytes of text for each task.
TASK_BYTES = 16 << 20
NO_ID = (1 << 63) - 1


class Bytes:
    """Units are the UTF-8 bytes."""

    base = kernel.BASE_BYTES

    @staticmethod
    def units(array):
        data, offsets = kernel.text_buffer(array)
        return data.astype(kernel.U) + kernel.U(1), offsets


class WordUnits:
    """Units are the words, by their hashes."""

    base = kernel.BASE_WORDS

    @staticmethod
    def units(array):
        words = kernel.Words(array)
        return words.hash, words.rows


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __rid and __ord; null ids come after all others."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.withColumns({"__ord": order, "__rid": F.xxhash64(order, "text")})


def split_runs(row, pos):
    """Runs of entries of one row and one stretch of 65,536 places: (first entries, lengths, the
    places' upper halves by run, their lower halves by entry)."""
    start, count = shared.runs((row.astype(np.int64) << 16) | (pos >> 16))
    return start, count.astype(np.uint32), (pos[start] >> 16).astype(np.uint32), (pos & 0xFFFF).astype(np.uint16)


def joined(high, count, low):
    return (np.repeat(high, count) << np.uint32(16)) | low


def ranked(rid, count):
    """Distinct rows of runs, and the number of its row for each entry."""
    distinct, which = np.unique(rid, return_inverse=True)
    return distinct, np.repeat(which.astype(kernel.U), count)


def returned(distinct, row, pos, n, keys):
    """Blocks of (row, places) dealt by row; row: numbers among the distinct ones."""
    both = np.sort((row << kernel.U(32)) | pos)
    row, pos = (both >> kernel.U(32)).astype(np.int64), both & kernel.U(0xFFFFFFFF)
    part = shared.part_of(kernel.mix(distinct.view(kernel.U)), n)[row]
    parts, blocks = [], []
    for p, (r, q) in shared.pack(part, [row, pos.astype(np.uint32)], n):
        at, count, high, low = split_runs(r, q)
        parts.append(keys[p])
        blocks.append(shared.block([distinct[r[at]], count, high, low]))
    return shared.packed_batch(parts, blocks)


def collected(blocks):
    """(row, place) of returned blocks, sorted."""
    got = [shared.unblock(b, (np.int64, np.uint32, np.uint32, np.uint16)) for b in blocks]
    distinct, row = ranked(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
    both = (row << kernel.U(32)) | np.concatenate([joined(h, c, q) for _, c, h, q in got])
    both.sort()
    return distinct[(both >> kernel.U(32)).astype(np.int64)], (both & kernel.U(0xFFFFFFFF)).astype(np.uint32)


def by_row(blocks_df: DataFrame, n: int, bitmap: bool) -> DataFrame:
    """(__rid, __places): all places of a row, as uint32 or as a bitmap."""

    def run(batches):
        for _, blocks in shared.by_part(batches):
            rid, pos = collected(blocks)
            at, count = shared.runs(rid)
            for i in range(0, len(at), 2000):
                own = list(zip(at[i : i + 2000].tolist(), count[i : i + 2000].tolist()))
                out = []
                for a, c in own:
                    p = pos[a : a + c]
                    if bitmap:
                        bits = np.zeros(int(p[-1]) + 1, bool)
                        bits[p] = True
                        out.append(np.packbits(bits).tobytes())
                    else:
                        out.append(p.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rid[at[i : i + 2000]]), kernel.binary(out)], ["__rid", "__places"])

    return shared.dealt(blocks_df, n).mapInArrow(run, "__rid long, __places binary")


def earlier(docs: DataFrame, unit, width: int, v: int, cover, across_only: bool, buckets: int) -> DataFrame:
    """(__rid, __starts): lists of bitmaps of the window starts that occur earlier.

    docs: as of keyed().  Earlier is a smaller __ord, or, unless across_only, a smaller start in
    the same row.
    """
    spark = docs.sparkSession
    with shared.settled(spark), shared.scratch() as tables:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(shared.partitions(spark), -(-size // TASK_BYTES))
        return _earlier(docs, unit, width, v, cover, across_only, buckets, n, tables)


def _earlier(docs, unit, width, v, cover, across_only, buckets, n, tables):
    keys = shared.part_keys(n)
    short = width - v + 1
    in_cover = np.zeros(v, bool)
    in_cover[list(cover)] = True
    texts = docs.select("__rid", "__ord", "text").where("text is not null")
    own = (np.int64, np.uint32, np.uint32, np.uint16)

    def sent(part, row, place, rid, more, ask, tell, order=None):
        """Blocks of entries: those of the mask ask for the tasks of their hashes, with the columns
        of more, and the places of the mask tell for the tasks of their rows."""
        out = {}
        for p, (r, q, *c) in shared.pack(part[ask], [row[ask], place[ask], *[x[ask] for x in more]], n):
            start, count, high, low = split_runs(r, q)
            out[p] = [rid[r[start]], count, high, low, *([] if order is None else [order[r[start]]]), *c]
        empty = [np.zeros(0, x) for x in own] + [np.zeros(0, np.int64)] * (order is not None) + [
            np.zeros(0, x.dtype) for x in more
        ]
        passed = {}
        for p, (r, q) in shared.pack(shared.part_of(kernel.mix(rid.view(kernel.U)), n)[row[tell]], [row[tell], place[tell]], n):
            start, count, high, low = split_runs(r, q)
            passed[p] = [rid[r[start]], count, high, low]
        none = [np.zeros(0, x) for x in own]
        parts = sorted(out.keys() | passed.keys())
        return shared.packed_batch(
            [keys[p] for p in parts], [shared.block([*out.get(p, empty), *passed.get(p, none)]) for p in parts]
        )

    def entries(got):
        """(distinct rids, rid of each entry, place of each entry) of arrays as in own."""
        rid, count, high, low = (np.concatenate([g[i] for g in got]) for i in range(4))
        distinct, row = ranked(rid, count)
        return distinct, row, joined(high, count, low)

    def answered(distinct, row, place, passed):
        """Blocks of found entries and of those that chunks passed on."""
        more, row2, place2 = passed
        both = np.concatenate([distinct, more])
        row, place = np.concatenate([row, row2 + kernel.U(len(distinct))]), np.concatenate([place, place2])
        if len(row):
            yield returned(both, row, place, n, keys)

    def anchors(batches):
        for batch in kernel.chunks(batches, "text", CHUNK):
            seq, rows = unit.units(batch.column("text"))
            size = np.diff(rows)
            place = np.arange(len(seq)) - np.repeat(rows[:-1], size)
            ok = in_cover[place % v]
            ok &= place + short <= np.repeat(np.where(size >= width, size, 0), size)
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            h = kernel.ranges(kernel.prefix(seq, unit.base), at, at + short, unit.base)
            row = np.searchsorted(rows, at, "right") - 1
            rid = batch.column("__rid").to_numpy()
            order = np.argsort(h, kind="stable")
            start, count = shared.runs(h[order])
            mine = rid[row[order]]
            met = np.minimum.reduceat(mine, start) != np.maximum.reduceat(mine, start) if across_only else count > 1
            ask, tell = np.empty(len(h), bool), np.empty(len(h), bool)
            tell[order] = np.repeat(met, count)
            ask[order] = ~tell[order]
            ask[order[start]] = True  # one entry asks for all that have met
            low = (h & kernel.U(0xFFFFFFFF)).astype(np.uint32)
            yield sent(shared.part_of(h, n), row.astype(np.int32), place[at].astype(np.uint32), rid, [low], ask, tell)

    def company(batches):
        for _, blocks in shared.by_part(batches):
            got = [shared.unblock(b, (*own, np.uint32, *own)) for b in blocks]
            distinct, rid, pos = entries([g[:4] for g in got])
            key, passed = np.concatenate([g[4] for g in got]), entries([g[5:] for g in got])
            packed = np.sort((key.astype(kernel.U) << kernel.U(32)) | np.arange(len(key), dtype=kernel.U))
            order, key = (packed & kernel.U(0xFFFFFFFF)).astype(np.int64), packed >> kernel.U(32)
            del packed, got
            same = key[1:] == key[:-1]
            if across_only:  # a group within one row has no company
                differs = same & (rid[order[1:]] != rid[order[:-1]])
                start, count = shared.runs(key)
                mixed = np.add.reduceat(np.append(differs, False), start) > 0 if len(start) else np.zeros(0, bool)
                kept = order[np.repeat(mixed, count)]
            else:
                alone = np.ones(len(key), bool)
                alone[1:] &= ~same
                alone[:-1] &= ~same
                kept = order[~alone]
            yield from answered(distinct, rid[kept], pos[kept], passed)

    def exchanged(df, send, receive):
        return shared.dealt(df.mapInArrow(send, shared.PACKED), n).mapInArrow(receive, shared.PACKED)

    flags = shared.written(by_row(exchanged(texts.select("__rid", "text"), anchors, company), n, False), clean=True)
    tables.append(flags)
    if flags.isEmpty():
        return docs.sparkSession.createDataFrame([], "__rid long, __starts array<binary>")
    # a merge join at every size: texts and flags both grow with the input
    some = shared.written(texts.join(flags.hint("merge"), "__rid").dropDuplicates(["__rid"]), clean=True)
    tables.append(some)

    def windows(bucket):
        def run(batches):
            for batch in kernel.chunks(batches, "text", CHUNK):
                seq, rows = unit.units(batch.column("text"))
                size = np.diff(rows)
                marks = [np.frombuffer(b.as_py(), np.uint32) for b in batch.column("__places")]
                q = np.concatenate([m.astype(np.int64) + a for m, a in zip(marks, rows)])
                row = np.repeat(np.arange(len(size)), [len(m) for m in marks])
                low = np.maximum(q - v + 1, rows[row])
                change = np.bincount(low, minlength=len(seq) + 1) - np.bincount(q + 1, minlength=len(seq) + 1)[: len(seq) + 1]
                ok = np.cumsum(change)[: len(seq)] > 0
                place = np.arange(len(seq)) - np.repeat(rows[:-1], size)
                ok &= place + width <= np.repeat(size, size)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                h = kernel.ranges(kernel.prefix(seq, unit.base), at, at + width, unit.base)
                if buckets > 1:
                    mine = (h & kernel.U(0xFF)) * kernel.U(buckets) >> kernel.U(8) == kernel.U(bucket)
                    h, at = h[mine], at[mine]
                row = np.searchsorted(rows, at, "right") - 1
                rid, ord_ = batch.column("__rid").to_numpy(), batch.column("__ord").to_numpy()
                order = np.argsort(h, kind="stable")
                start, count = shared.runs(h[order])
                when = ord_[row[order]]
                late = when > np.repeat(np.minimum.reduceat(when, start), count)
                if not across_only:  # a row's entries are together and in order
                    late[1:] |= (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
                tell = np.empty(len(h), bool)
                tell[order] = late
                yield sent(shared.part_of(h, n), row.astype(np.int32), place[at].astype(np.uint32), rid, [h], ~tell, tell, ord_)

        return run

    def later(batches):
        for _, blocks in shared.by_part(batches):
            got = [shared.unblock(b, (*own, np.int64, kernel.U, *own)) for b in blocks]
            distinct, rid, pos = entries([g[:4] for g in got])
            ord_ = np.concatenate([np.repeat(g[4], g[1]) for g in got])
            key, passed = np.concatenate([g[5] for g in got]), entries([g[6:] for g in got])
            del got
            order = np.argsort(key)
            key, rid, pos, ord_ = key[order], rid[order], pos[order], ord_[order]
            start, count = shared.runs(key)
            out = ord_ > np.repeat(np.minimum.reduceat(ord_, start), count) if len(key) else np.zeros(0, bool)
            yield from answered(distinct, rid[out], pos[out], passed)

    parts = []
    try:
        for b in range(buckets):
            parts.append(shared.written(by_row(exchanged(some, windows(b), later), n, True), clean=True))
    except BaseException:
        shared.discard(*parts)
        raise
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("__rid").agg(F.collect_list("__places").alias("__starts"))


def covered(starts, size: int, width: int) -> np.ndarray:
    """A mask of the units that the windows at these starts cover; starts: bitmaps or None."""
    change = np.zeros(size + width + 1, np.int32)
    for bits in starts or ():
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
        change[at] += 1
        change[at + width] -= 1
    return np.cumsum(change)[:size] > 0

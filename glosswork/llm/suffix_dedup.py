"""Suffix-array dedup: bytes of 50-byte strings that also start in an earlier document.

What is built is not a suffix array: suffixes are brought together by a 64-bit hash of their first
WIDTH bytes, not put in order, and no ranks are made.  A difference cover of period 31 (six places of
31) is sampled first: cover-sample strings are grouped globally, which settles every suffix whose
aligned sample has no company in another document.  The suffixes that are left are then grouped
one range of hashes at a time, and only one range's suffixes are on disk together.

Defined cases: null text counts as empty; texts are judged as UTF-8 bytes and matches never cross
documents; documents with equal ids don't remove from each other; a null doc_id comes after all
others; an empty table gives no rows; other columns are passed through, but for those named like
an added one, which it replaces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import kernel, repeats, shared

WIDTH = 50
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
BUCKETS = 3


def with_starts(docs: DataFrame, unit, width, period, cover, across, buckets):
    """shared.packed(docs) with __starts."""
    keyed = repeats.keyed(shared.packed(docs))
    starts = repeats.earlier(keyed, unit, width, period, cover, across, buckets)
    return keyed.join(starts.hint("merge"), "__rid", "left")


def dedup(docs: DataFrame, width=WIDTH, buckets=BUCKETS) -> DataFrame:
    """docs with kept (binary), n_bytes, n_removed, n_spans and kept_sha256."""
    marked = with_starts(docs, repeats.Bytes, width, PERIOD, COVER, True, buckets)
    added = [
        T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    ]
    own = {f.name for f in added}
    names = [f.name for f in docs.schema.fields if f.name not in own]
    schema = T.StructType([docs.schema[n] for n in names] + added)

    def run(batches):
        for batch in kernel.chunks(batches, "text", repeats.CHUNK):
            data, offsets = kernel.text_buffer(batch.column("text"))
            kept, removed, spans, sha = [], [], [], []
            for starts, a, b in zip(batch.column("__starts"), offsets, offsets[1:]):
                text = data[a:b]
                if starts.is_valid:
                    mask = repeats.covered(starts.as_py(), len(text), width)
                    removed.append(int(mask.sum()))
                    spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                    text = text[~mask]
                else:
                    removed.append(0)
                    spans.append(0)
                kept.append(text.tobytes())
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column(batch, n) for n in names] + [
                    kernel.binary(kept), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                    pa.array(sha)
                ],
                names + [f.name for f in added],
            )

    column = shared.column_of(docs)
    return marked.select("doc_id", "text", "rest", "__starts").mapInArrow(run, schema)

"""Substring dedup: words of 20-word windows that also start earlier.

Difference-cover anchors: eight-word runs are hashed only at cover places {0, 1, 3, 9} modulo 13;
any match of 20 words shares an aligned anchor.  Anchors with company are extended to whole
windows, which are grouped by their content; the earliest start stays.

Defined cases: null text has no words; texts of fewer than 20 words lose nothing; documents with
equal ids and different texts don't remove from each other, equal rows have equal results; a null
doc_id comes after all others; an empty table gives no rows; other columns are passed through, but
dedup() replaces those named like a column it adds, and strip() adapts n_chars.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import kernel, repeats, shared
from .suffix_dedup import with_starts

WIDTH = 20
PERIOD, COVER = 13, (0, 1, 3, 9)


def dedup(docs: DataFrame, width=WIDTH) -> DataFrame:
    """docs with kept (string), n_words, n_removed and kept_sha256."""
    marked = with_starts(docs, repeats.WordUnits, width, PERIOD, COVER, False, 1)
    added = [
        T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
    own = {f.name for f in added}
    names = [f.name for f in docs.schema.fields if f.name not in own]
    schema = T.StructType([docs.schema[n] for n in names] + added)

    def run(batches):
        for batch in kernel.chunks(batches, "text", repeats.CHUNK):
            text = [x.as_py() or "" for x in batch.column("text")]
            kept, total, removed, sha = [], [], [], []
            for starts, t in zip(batch.column("__starts"), text):
                words = t.encode().split()
                total.append(len(words))
                if starts.is_valid:
                    mask = repeats.covered(starts.as_py(), len(words), width)
                    words = [w for w, out in zip(words, mask.tolist()) if not out]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column(batch, n) for n in names]
                + [
                    pa.array([k.decode() for k in kept], pa.string()), pa.array(total, pa.int64()),
                    pa.array(removed, pa.int64()), pa.array(sha)
                ],
                names + [f.name for f in added],
            )

    column = shared.column_of(docs)
    return marked.select("doc_id", "text", "rest", "__starts").mapInArrow(run, schema)


def strip(docs: DataFrame, width=WIDTH) -> DataFrame:
    """docs without the repeated words; texts that lose none are unchanged."""
    marked = with_starts(docs, repeats.WordUnits, width, PERIOD, COVER, False, 1)
    column, names, schema = shared.column_of(docs), docs.columns, docs.schema

    def run(batches):
        for batch in kernel.chunks(batches, "text", repeats.CHUNK):
            text = batch.column("text").to_pylist()
            changed = [i for i, starts in enumerate(batch.column("__starts")) if starts.is_valid]
            sizes = batch.column("rest").field(others.index("n_chars")).to_pylist() if "n_chars" in others else None
            for i in changed:
                words = text[i].encode().split()
                mask = repeats.covered(batch.column("__starts")[i].as_py(), len(words), width).tolist()
                if any(mask):
                    text[i] = b" ".join([w for w, out in zip(words, mask) if not out]).decode()
                    if sizes:
                        sizes[i] = len(text[i])
            own = {"text": pa.array(text, batch.column("text").type)}
            if sizes:
                own["n_chars"] = pa.array(sizes, column(batch, "n_chars").type)
            yield pa.RecordBatch.from_arrays([own[n] if n in own else column(batch, n) for n in names], names)

    others = [c for c in names if c not in ("doc_id", "text")]
    return marked.select("doc_id", "text", "rest", "__starts").mapInArrow(run, schema)

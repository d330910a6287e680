"""Periodic runs of words: stretches that repeat one block of words several times in a row.

Every run is periodic in a block that is smaller than all its rotations, in one of the two
directions of the words' order (the direction in which the word behind the run is smaller than
the word one period before it).  From each place inside the run where this block begins, the next
smaller suffix starts one block later.  So the next smaller suffixes of both directions (a Lyndon
array each) give all runs: no suffix array, no hash of a word or window is made, words are only
compared with each other.

Next smaller suffixes are found from right to left on the chain of those already known.  How far
two suffixes agree is never counted twice: along the chain, agreement with one suffix tells the
agreement with the next; and for each distance the last agreement is kept, so that a later
comparison over the same distance stops where the earlier one began.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared

#: A run has at least this many words, and at least this many times its period.
MIN_LENGTH, MIN_EXPONENT = 6, 4

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def next_smaller(s, less):
    """For each place of s the start of the next smaller suffix (len(s) if none) and how many
    items the two suffixes have in common."""
    n = len(s)
    jump, same = [n] * (n + 1), [0] * (n + 1)
    begun, agreed = {}, {}  # by distance: the last place compared, and the agreement there
    for i in range(n - 2, -1, -1):
        j, k = i + 1, 0
        while j + k < n:  # at the end, the suffix j is a beginning of i, so it is smaller
            here, there = s[i + k], s[j + k]
            if here == there:
                d = j - i
                known = begun.get(d, n)
                k += 1
                while j + k < n:
                    if i + k == known:
                        k += agreed[d]
                        break
                    if s[i + k] != s[j + k]:
                        break
                    k += 1
                begun[d], agreed[d] = i, k
                if j + k == n:
                    break
                here, there = s[i + k], s[j + k]
            if less(there, here):
                break
            # i is smaller than j, so the next smaller suffix of j is tried
            m = same[j]
            while m > k:  # it differs from i where j does, and in the same way
                j = jump[j]
                m = same[j]
            j = jump[j]
            if m < k:  # it differs from j, and so from i, before j differs from i
                k = m
                break
        jump[i] = j
        same[i] = k if j < n else 0
    return jump, same


def runs(s, min_length=MIN_LENGTH, min_exponent=MIN_EXPONENT):
    """All (start, length, period) of maximal runs of s by start, then period."""
    n, least, out = len(s), max(2, min_exponent), set()
    for less in (operator.lt, operator.gt):
        jump, same = next_smaller(s, less)
        jump, same = np.array(jump[:n], np.int64), np.array(same[:n], np.int64)
        period = jump - np.arange(n)
        # a run's first block begins less than a period behind the run's start
        found = np.flatnonzero((jump < n) & (same > (least - 2) * period))
        for i in found.tolist():
            p, more = int(period[i]), int(same[i])
            if i >= p and jump[i - p] == i and same[i - p] == more + p:
                continue  # not the first block of its run
            left = 0
            while left < i and s[i - left - 1] == s[i - left - 1 + p]:
                left += 1
            length = left + p + more
            if length >= max(min_length, min_exponent * p):
                out.add((i - left, length, p))
    return sorted(out)


def repeated(found, n):
    """A mask of n words: those that some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


def find(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with n_words, runs and collapsed, of the words between ASCII white space of each whole text.

    runs: every maximal stretch with smallest period p of at least min_length words and
    min_exponent * p words (min_exponent: 2 at least), as (start, length, period) from word 0, by
    start, then period.  collapsed: the words that no run contains after its first period, one
    space between them.  A text that is null has no words, no runs and a null collapsed; an empty
    one an empty collapsed.  Rows are judged one by one, within their row: repeated rows and null
    ids have results like others, and nothing is shuffled.  Columns of the same names (in any
    case) are replaced; all others are kept as they are.
    """

    @F.arrow_udf(f"struct<n_words: bigint, runs: {RUNS}, collapsed: string>")
    def judge(texts: pa.Array) -> pa.Array:
        counts, listed, kept = [], [], []
        for text in texts:
            words = (text.as_py() or "").encode().split()  # bytes: only ASCII white space splits
            found = runs(words, min_length, min_exponent)
            counts.append(len(words))
            listed.append([{"start": a, "length": b, "period": c} for a, b, c in found])
            if found:
                words = [w for w, out in zip(words, repeated(found, len(words)).tolist()) if not out]
            kept.append(b" ".join(words).decode() if text.is_valid else None)
        item = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(listed, pa.list_(item)), pa.array(kept, pa.string())],
            ["n_words", "runs", "collapsed"],
        )

    added = ("n_words", "runs", "collapsed")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    own = shared.own_name(docs, "__runs")
    rows = docs.withColumn(own, judge(F.col("text")))
    return rows.select(*others, *[F.col(own)[name].alias(name) for name in added])


def strongest(found):
    """Of an array of runs that with the greatest length / period, compared exactly; of equals the
    first; null without runs."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(found, F.get(found, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))

"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams, the most frequent first.
A document's most frequent n-grams are ranked in the same way; its distance to a language is the
sum, over its n-grams, of how far each is out of place: the difference of the two ranks, or the
profile's length where the profile lacks it.  The nearest language is the answer.

n-grams are of one to three characters of lower-case words (runs of letters) with a space before
and behind them; they are counted exactly, as packed code points, and equal counts are ranked by
code points.  Counts of languages cover all rows that may be learned from; documents are counted
in their row, whole.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import kernel, shared

#: n-grams of a profile, of languages and of documents.
PROFILE = 400
#: Languages whose profiles are sent to the executors at a time: at most LANGS * PROFILE n-grams of
#: 8 bytes and four bytes of rank for each of LANGS, 27 MB if no two languages share one.
LANGS = 128
#: Characters that are counted at a time; a longer text is counted alone.
CHUNK = 1 << 20
UNKNOWN = "und"
SPACE, BITS = 32, 21  # a code point has 21 bits, so three of them make an exact 63-bit number


def counted(texts, group):
    """(group, n-gram, count) of the n-grams of each group of texts, by group and n-gram.

    group: a number for each text, which may be null.  An n-gram is packed as three code points, 0
    behind its end.  A space may open or close an n-gram, but not be one, nor stand inside.
    """
    # a zero cannot be part of a word, so two of them part the texts
    texts = [f" {t.lower()} ".replace("\0", " ") + "\0\0" if t else "" for t in texts]
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(sys.maxunicode + 1, bool)
    seen[flat] = True
    kinds = np.flatnonzero(seen)
    kinds = kinds[[chr(c).isalpha() for c in kinds]] if len(kinds) else kinds
    number = np.ones(len(seen), np.int32)  # all but letters are space
    number[0] = 0
    number[kinds] = np.arange(2, len(kinds) + 2)
    code = number[flat]
    letter = code > 1
    keep = letter | (code == 0)
    keep[:-1] |= letter[1:]
    keep[1:] |= letter[:-1]
    code = code[keep].astype(np.int64)
    owner = np.repeat(np.asarray(group, np.int64), [len(t) for t in texts])[keep]
    bits = int(len(kinds) + 2).bit_length()
    keys = np.zeros(len(code), np.int64)
    keys[:-2] = (code[:-2] << bits | code[1:-1]) << bits | code[2:]
    owner, keys = owner[code > 0], keys[code > 0]
    if 3 * bits + int(max(group, default=0)).bit_length() < 63:
        both = np.sort(owner << 3 * bits | keys)
        owner, keys = both >> 3 * bits, both & ((1 << 3 * bits) - 1)
    else:
        order = np.lexsort((keys, owner))
        owner, keys = owner[order], keys[order]
    first = changes(owner, keys)
    n = np.diff(np.append(first, len(keys)))
    owner, keys = owner[first], keys[first]
    real, mask = np.append([0, SPACE], kinds), (1 << bits) - 1
    a, b, c = keys >> 2 * bits, keys >> bits & mask, keys & mask
    out = []
    # the counts of shorter n-grams are sums over those that they begin
    for packed, some in (
        (real[a] << 2 * BITS, a > 1),
        ((real[a] << BITS | real[b]) << BITS, (b > 0) & ((a > 1) | (b > 1))),
        ((real[a] << BITS | real[b]) << BITS | real[c], (b > 1) & (c > 0)),
    ):
        whose, gram, count = owner[some], packed[some], n[some]
        start = changes(whose, gram)
        out.append((whose[start], gram[start], np.add.reduceat(count, start) if len(start) else count))
    return [np.concatenate(x) for x in zip(*out)]


def changes(*columns):
    """Where a row of the columns differs from the one before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def ranked(owner, grams, counts, most):
    """The `most` most frequent n-grams of each owner, with their ranks from 0; of equals the least first."""
    order = np.lexsort((grams, -counts, owner))
    owner, grams = owner[order], grams[order]
    start = changes(owner)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    few = rank < most
    return owner[few], grams[few], rank[few]


def profiles(docs: DataFrame, keep=None, most: int = PROFILE) -> DataFrame:
    """(lang, gram, rank, n): the `most` n-grams that are most frequent in all texts of a language.

    docs: doc_id, text, lang; keep: which doc_id may be learned from.  Rows without lang or text
    teach nothing.  gram is the packed n-gram.
    """
    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    some = some.where(keep(F.col("doc_id"))) if keep else some

    def run(batches):
        for batch in kernel.chunks(batches, "text", CHUNK):
            names = batch.column("lang").dictionary_encode()
            owner, grams, counts = counted(batch.column("text").to_pylist(), np.asarray(names.indices, np.int64))
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(owner)), pa.array(grams), pa.array(counts, pa.int64())], ["lang", "gram", "n"]
            )

    parts = some.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    total = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = total.withColumn("rank", (F.row_number().over(order) - 1).cast("int")).where(F.col("rank") < most)
    return best.select("lang", "gram", "rank", "n")


def nearest(text, table, most=PROFILE):
    """The two nearest languages of a text, as an array of (distance, lang), the nearest first.

    table: a broadcast of (langs, grams in order, ranks by language and gram, -1 where it lacks it).  A distance
    is in 0..1; of equal ones the first language by name counts.  Texts that are null or have no letter have an empty array.
    """

    @F.arrow_udf("array<struct<distance: double, lang: string>>")
    def judge(texts: pa.Array) -> pa.Array:
        langs, known, ranks = table.value
        out = [[] for _ in texts]
        rows = pa.RecordBatch.from_arrays([texts, pa.array(np.arange(len(texts)))], ["text", "at"])
        for part in kernel.chunks([rows], "text", CHUNK):
            owner, grams, place = ranked(*counted(part.column("text").to_pylist(), np.arange(part.num_rows)), most)
            if not len(owner):
                continue
            start = changes(owner)
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            here = known[at] == grams
            sums = np.empty((len(start), len(langs)))
            for k in range(len(langs)):  # one language at a time, as a chunk can hold many short texts
                rank = ranks[k, at]
                sums[:, k] = np.add.reduceat(np.where(here & (rank >= 0), np.abs(rank - place), most), start)
            sums /= (most * np.diff(np.append(start, len(owner))))[:, None]
            order = np.argsort(sums, axis=1, kind="stable")[:, :2]
            first = part.column("at").to_numpy()
            for k, i in enumerate(owner[start].tolist()):
                out[first[i]] = [{"distance": float(sums[k, b]), "lang": langs[b]} for b in order[k].tolist()]
        return pa.array(out, pa.list_(pa.struct([("distance", pa.float64()), ("lang", pa.string())])))

    return judge(text)


def tables(learned: DataFrame, most=PROFILE, langs=LANGS):
    """The profiles as tables to broadcast, of `langs` languages each, in order of names."""
    names = [r.lang for r in learned.select("lang").distinct().orderBy("lang").collect()]
    for i in range(0, len(names), langs):
        some = names[i : i + langs]
        rows = learned.where(F.col("lang").between(some[0], some[-1])).select("lang", "gram", "rank").toArrow()
        known, at = np.unique(rows.column("gram").to_numpy(), return_inverse=True)
        number = {lang: k for k, lang in enumerate(some)}
        ranks = np.full((len(some), len(known)), -1, np.int32)
        ranks[[number[x] for x in rows.column("lang").to_pylist()], at] = rows.column("rank").to_numpy()
        yield some, known, ranks


def predict(docs: DataFrame, learned: DataFrame, most: int = PROFILE, langs: int = LANGS) -> DataFrame:
    """docs with lang_pred and score, of every whole text, by the profiles in `learned`.

    lang_pred: the language of least out-of-place distance; of equals the first by name; `und` for
    texts that are null or have no letter, and where no profile was learned.  score, 0 to 1: how
    much nearer it is than the second (1 - d1 / d2, where one language only was learned against the
    greatest distance, 1); 0 for `und`.  Rows are judged one by one; repeated rows and null ids
    are like others.  Columns of the same names (in any case) are replaced.
    """
    spark = docs.sparkSession
    found = [F.array().cast("array<struct<distance: double, lang: string>>")]
    with shared.scratch() as held:
        held.append(shared.written(learned))
        for table in tables(held[0], most, langs):
            found.append(nearest(F.col("text"), spark.sparkContext.broadcast(table), most))
    best = F.slice(F.array_sort(F.concat(*found)), 1, 2)
    added = ("lang_pred", "score")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    own = shared.own_name(docs, "__nearest")
    rows = docs.withColumn(own, best)
    first, second = F.get(own, F.lit(0)), F.get(own, F.lit(1))
    beyond = F.coalesce(second["distance"], F.lit(1.0))
    score = F.when(beyond > 0, 1 - first["distance"] / beyond).otherwise(0.0)
    return rows.select(
        *others, F.coalesce(first["lang"], F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(score, F.lit(0.0)).alias("score")
    )

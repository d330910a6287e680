"""Bounded clustering of a corpus of any size: the same clusters as cluster.bounded(), without one group.

Each quote joins the centroid that is nearest by then, so the order decides.  The corpus is cut into
blocks of quotes, and each block starts from the sums that the one before it leaves: a chain of steps, each of
which takes one block of every corpus.  (Blocks that chose at once, from sums that were guessed, took as many
rounds as there were blocks to settle on the same choices, and each round ran all of them.)

A block needs the sums of its own terms only.  It sends them, after its choices, to the next block that has the
term, so each sum is written once and read once, and no task sees a whole corpus or vocabulary.  The
centroids' lengths are carried as 2 * sum * added + added**2; a term of a single quote adds to these only.
All else (frequencies, weights, seeds) is done for all blocks at once.  Terms are only compared, so 64-bit hashes
stand for them, which are not checked again.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .. import stages
from ..functions import text as tx
from . import vectors as vec

#: Cells of a block's matrix of sums (quotes x terms of a quote x clusters), about.
CELLS = 1 << 24
TERMS = 64
#: Blocks of a corpus that a step takes, as a block needs the sums that the one before it leaves.
FIRST = 1
KEY = ["corpus_id", "block"]
PACKED = "corpus_id string, block int, quote_idx int, terms array<long>, weights array<double>, l1 double, lone double"
STATE = "corpus_id string, to int, kind int, id long, k int, place long, sums array<double>"
#: Kinds of STATE: sums of a term, lengths and sizes of the clusters (k: the block behind which); of the seeds their sums, lengths and quotes; a choice.
SUMS, LENGTHS, SEED_SUMS, SEED_LENGTHS, SEED, CHOICE = range(6)
#: Where choices, the sums behind the last block, and lengths for the next step are sent.
CHOICES, BEHIND, NEXT = -1, -2, -3


def block_size(target: int) -> int:
    return max(16, min(65536, CELLS // (TERMS * target)))


def counted(quotes: DataFrame, focus: str = "") -> DataFrame:
    """(corpus_id, quote_idx, terms, tf, total): each quote's hashed terms and their counts, and the corpus's quotes."""
    every = F.transform(tx.vector_terms(tx.focus_augmented(F.col("text"), focus)), lambda t: F.xxhash64(t))
    rows = stages.spread(quotes).select("corpus_id", "quote_idx", tx.bound(every, vec.counted).alias("t"))
    rows = rows.select("corpus_id", "quote_idx", F.col("t.term").alias("terms"), F.col("t.tf").cast("array<double>").alias("values"))
    total = quotes.groupBy("corpus_id").agg(F.count("*").alias("total"))
    return stages.write(rows.join(F.broadcast(total), "corpus_id"))


def listed(quotes: DataFrame, vectors: DataFrame) -> DataFrame:
    """counted() of vectors that have weights already: total is null."""
    rows = vectors.groupBy("corpus_id", "quote_idx").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "weight")).alias("v"))
    rows = quotes.select("corpus_id", "quote_idx").join(rows, ["corpus_id", "quote_idx"], "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return stages.write(
        rows.select(
            "corpus_id", "quote_idx", none(F.col("v.t"), "long").alias("terms"), none(F.col("v.weight"), "double").alias("values"),
            F.lit(None).cast("long").alias("total")
        )
    )


def frequencies(rows: DataFrame, block: int) -> DataFrame:
    """(corpus_id, block, term, df, next) of counted(): the terms of more than one quote in each block that has them;
    next is the block that has them next, else BEHIND."""
    at = rows.select("corpus_id", _block(block), F.explode("terms").alias("term"))
    # dealt by term once, for the counts of blocks and for those of the corpus
    n = at.repartition("corpus_id", "term").groupBy("corpus_id", "term", "block").agg(F.count("*").alias("n"))
    listed = F.sort_array(F.collect_list("block")).alias("blocks")
    several = n.groupBy("corpus_id", "term").agg(F.sum("n").alias("df"), listed).where("df > 1")
    several = several.select("corpus_id", "term", "df", "blocks", F.posexplode("blocks").alias("p", "block"))
    return several.select("corpus_id", "block", "term", "df", F.coalesce(F.get("blocks", F.col("p") + 1), F.lit(BEHIND)).alias("next"))


def _block(block: int):
    return F.floor((F.col("quote_idx") - 1) / block).cast("int").alias("block")


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list begins (and the last ends)."""
    c = table[name].combine_chunks()
    c = c if isinstance(c, pa.ListArray) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], table.schema.field(name).type)
    return c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _as_lists(values: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))


def _found(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value is in have, which is sorted, and whether it is there."""
    if not len(have):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
    return at, have[at] == wanted


def packed(rows: DataFrame, block: int) -> DataFrame:
    """PACKED, a table by block: each quote's weights of terms that other quotes have too; l1 of all, lone is the
    squared weight of the others.  Row 0 of a block lists its terms, in order, with the blocks that have them next."""

    def run(quotes: pa.Table, known: pa.Table) -> pa.Table:
        if not quotes.num_rows:
            return table("", 0, [], [], np.zeros(1), [], [], [])
        terms, edges = _lists(quotes, "terms")
        values = _lists(quotes, "values")[0].astype(np.float64)
        row = np.repeat(np.arange(quotes.num_rows), np.diff(edges))
        order = np.argsort(_column(known, "term"))
        have, df, after = (_column(known, c)[order] for c in ("term", "df", "next"))
        at, shared = _found(have, terms)
        total = quotes["total"][0].as_py()
        size = lambda v, of=slice(None): np.bincount(row[of], v[of], quotes.num_rows)
        if total is not None:
            values = values * (np.log((1 + total) / (1 + np.where(shared, df[at] if len(df) else 1, 1))) + 1)
            norm = np.sqrt(size(values * values))
            values = values / norm[row]
        lone, l1 = size(values * values, ~shared), size(np.abs(values))
        own = np.concatenate([[0], np.cumsum(np.bincount(row[shared], minlength=quotes.num_rows))])
        return table(
            quotes["corpus_id"][0].as_py(), quotes["block"][0].as_py(), np.concatenate([[0], _column(quotes, "quote_idx")]),
            np.concatenate([have, terms[shared]]), np.concatenate([[0], own + len(have)]), np.concatenate([after.astype(np.float64), values[shared]]),
            np.concatenate([[0.0], l1]), np.concatenate([[0.0], lone])
        )

    def table(corpus, number, ids, terms, edges, weights, l1, lone):
        ids, terms, weights = np.asarray(ids, np.int32), np.asarray(terms, np.int64), np.asarray(weights, np.float64)
        return pa.table({
            "corpus_id": pa.array([corpus] * len(ids), pa.string()), "block": np.full(len(ids), number, np.int32), "quote_idx": ids,
            "terms": _as_lists(terms, edges), "weights": _as_lists(weights, edges), "l1": np.asarray(l1, np.float64), "lone": np.asarray(lone, np.float64)
        })

    quotes = rows.select("corpus_id", _block(block), "quote_idx", "terms", "values", "total")
    known = frequencies(rows, block).toDF("corpus", "part", "term", "df", "next")  # own names: both sides come from one table
    found = quotes.groupBy(*KEY).cogroup(known.groupBy("corpus", "part")).applyInArrow(run, PACKED)
    return stages.write_by(found, "block")


def seeds(rows: DataFrame, target: int) -> list[tuple]:
    """(corpus_id, k, quote_idx, terms, weights, lone) of packed(): heavy and mutually distant quotes.

    The heaviest, then the farthest from all chosen so far; of equals the first.  Each step reads the rows once; a
    task keeps the best of each corpus.  Only the seeds themselves, theme_count of a large corpus, come to the driver."""
    chosen = {}

    def run(batches):
        for batch in batches:
            quotes = pa.Table.from_batches([batch])
            code = quotes["corpus_id"].combine_chunks().dictionary_encode()
            code = code if isinstance(code, pa.DictionaryArray) else code.chunk(0)
            ids, l1 = _column(quotes, "quote_idx"), _column(quotes, "l1")
            (terms, edges), weights = _lists(quotes, "terms"), _lists(quotes, "weights")[0]
            row, which = np.repeat(np.arange(len(ids)), np.diff(edges)), code.indices.to_numpy()
            best = []
            for c, corpus in enumerate(code.dictionary.to_pylist()):
                mine, had = which == c, chosen.get(corpus, [])
                gain = np.round(l1, 10)
                if had:
                    near = np.zeros(len(ids))
                    for _, seed, seed_weights, _ in had:
                        at, shared = _found(seed, terms)
                        near = np.maximum(near, np.bincount(row[shared], weights[shared] * seed_weights[at[shared]], len(ids)))
                    gain = np.round(1 - near + np.minimum(0.25, l1 / 20), 10)
                    mine = mine & ~np.isin(ids, [h[0] for h in had])
                at = np.flatnonzero(mine)
                if len(at):
                    best.append(at[np.lexsort((ids[at], -gain[at]))[0]])
                    gains.append(gain[best[-1]])
            if best:
                yield quotes.select(["corpus_id", "quote_idx", "terms", "weights", "lone"]).take(best).append_column("gain", pa.array(gains, pa.float64())).combine_chunks().to_batches()[0]
            gains.clear()

    gains = []
    schema = "corpus_id string, quote_idx int, terms array<long>, weights array<double>, lone double, gain double"
    for _ in range(target):
        found = rows.where("quote_idx > 0").select("corpus_id", "quote_idx", "terms", "weights", "l1", "lone").mapInArrow(run, schema)
        order = F.struct("gain", -F.col("quote_idx"))
        best = found.groupBy("corpus_id").agg(F.max_by(F.struct("quote_idx", "terms", "weights", "lone"), order).alias("b")).collect()
        for corpus, b in best:
            terms, weights = np.array(b.terms, np.int64), np.array(b.weights, np.float64)
            order = np.argsort(terms)
            chosen.setdefault(corpus, []).append((b.quote_idx, terms[order], weights[order], b.lone))
    return [(corpus, k, *seed) for corpus, found in chosen.items() for k, seed in enumerate(found)]


def _seed_states(found: list[tuple], target: int) -> list[tuple]:
    """STATE of seeds(): where every term and cluster begins."""
    out, lengths, sums = [], {}, {}
    for corpus, k, quote, terms, weights, lone in found:
        out.append((corpus, CHOICES, SEED, int(quote), k, 1, None))
        lengths.setdefault(corpus, [0.0] * target)[k] = float(weights @ weights + lone)
        for t, w in zip(terms.tolist(), weights.tolist()):
            sums.setdefault((corpus, t), [0.0] * target)[k] = w
    out += [(c, CHOICES, SEED_LENGTHS, 0, 0, 0, [*x, *[1.0] * target]) for c, x in lengths.items()]
    return out + [(c, CHOICES, SEED_SUMS, t, 0, 0, x) for (c, t), x in sums.items()]


def _choices(rows: DataFrame, states: DataFrame, target: int) -> DataFrame:
    """STATE behind a block of each corpus: its quotes in order join the nearest centroid; place counts the members.
    rows: a block's packed(); states: what was sent to it, and the seeds'."""

    def run(quotes: pa.Table, given: pa.Table) -> pa.Table:
        if not quotes.num_rows:  # none in this block: what is carried goes on to the next
            on = given.filter(pc.equal(given["kind"], LENGTHS))
            return pa.table([on["corpus"], *(on[c] for c in SCHEMA.names[1:])], schema=SCHEMA)
        corpus, block = quotes["corpus_id"][0].as_py(), quotes["block"][0].as_py()
        ids = _column(quotes, "quote_idx")
        (terms, edges), weights, lone = _lists(quotes, "terms"), _lists(quotes, "weights")[0], _column(quotes, "lone")
        first = int(ids.argmin())
        have, after = terms[edges[first] : edges[first + 1]], weights[edges[first] : edges[first + 1]].astype(np.int32)
        sums = np.zeros((len(have), target))
        kind, at = _column(given, "kind"), _column(given, "id")
        (values, begin), seeded = _lists(given, "sums"), set(at[kind == SEED].tolist())
        for part in (SEED_SUMS, SUMS):  # what was sent counts more than how the seeds began
            which = np.flatnonzero(kind == part)
            to, there = _found(have, at[which])
            if there.any():
                sums[to[there]] = values[begin[which[there]][:, None] + np.arange(target)]
        carried = np.flatnonzero(kind == (LENGTHS if (kind == LENGTHS).any() else SEED_LENGTHS))[0]
        carried = values[begin[carried] : begin[carried + 1]].tolist()
        lengths, counts = carried[:target], carried[target:]
        inverse = np.array([x**-0.5 if x > 1e-18 else 0.0 for x in lengths]) * 1e12
        where, flat = np.searchsorted(have, terms) * target, sums.reshape(-1)
        length = lone + np.bincount(np.repeat(np.arange(len(ids)), np.diff(edges)), weights * weights, len(ids))
        chosen, places, order = [], [], [i for i in np.argsort(ids).tolist() if i != first and int(ids[i]) not in seeded]
        edges, length, number = edges.tolist(), length.tolist(), np.arange(target)
        for i in order:
            a, b = edges[i], edges[i + 1]
            own, w = where[a:b], weights[a:b]
            dots = w @ flat[own[:, None] + number]
            k = int(np.rint(dots * inverse).argmax())
            lengths[k] += 2 * float(dots[k]) + length[i]
            inverse[k] = lengths[k] ** -0.5 * 1e12 if lengths[k] > 1e-18 else 0.0
            flat[own + k] += w
            counts[k] += 1
            chosen.append(k)
            places.append(counts[k])
        n, m = len(order), len(have)
        full = lambda *parts: np.concatenate([np.full(c, v) for c, v in zip((n, m, 1), parts)])
        return pa.table(
            [
                pa.array([corpus] * (n + m + 1)), np.concatenate([full(CHOICES)[:n], after, [NEXT]]).astype(np.int32),
                full(CHOICE, SUMS, LENGTHS).astype(np.int32), np.concatenate([ids[order], have, [0]]).astype(np.int64),
                np.concatenate([chosen, np.zeros(m), [block]]).astype(np.int32), np.concatenate([places, np.zeros(m + 1)]).astype(np.int64),
                _as_lists(
                    np.concatenate([flat, lengths, counts]),
                    np.concatenate([np.zeros(n, np.int64), np.arange(m + 1) * target, [(m + 2) * target]])
                )
            ],
            schema=SCHEMA
        )

    states = states.select(*SCHEMA.names).withColumnRenamed("corpus_id", "corpus")  # own name: both sides come from one table
    return rows.groupBy("corpus_id").cogroup(states.groupBy("corpus")).applyInArrow(run, STATE)


SCHEMA = pa.schema([
    ("corpus_id", pa.string()), ("to", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("k", pa.int32()), ("place", pa.int64()),
    ("sums", pa.list_(pa.float64()))
])


def choose(quotes: DataFrame, vectors: DataFrame, target: int, block: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(seeds, choices, rounds): choices has corpus_id, quote_idx, k, place, block of all quotes but the seeds; rounds
    counts the seeds' and one for each block.

    Every corpus must have more than target quotes; k is 0 for the first seed's cluster.
    """
    block = block or block_size(target)
    first, sent, rounds = chain(packed(listed(quotes, vectors), block), target)
    return first, _choices_of(sent).withColumn("block", _block(block)), rounds


def _choices_of(sent: DataFrame) -> DataFrame:
    return sent.where(F.col("kind") == CHOICE).select("corpus_id", F.col("id").cast("int").alias("quote_idx"), "k", "place")


def chain(rows: DataFrame, target: int) -> tuple[DataFrame, DataFrame, int]:
    """(seeds, sent, rounds) of packed(): sent is STATE, all that was chosen and sent on, a table by `to`."""
    spark = rows.sparkSession
    start = stages.write(spark.createDataFrame(_seed_states(seeds(rows, target), target), STATE).coalesce(1))
    steps = [r[0] for r in rows.select("block").distinct().orderBy("block").collect()]
    sent, states = stages.Chain(spark, "to", STATE), start
    for step in steps:
        if sent.steps:
            states = start.unionByName(sent.part(step)).unionByName(sent.part(NEXT, sent.steps - 1))
        sent.add(_choices(rows.where(F.col("block") == step), states, target))
    first = start.where(F.col("kind") == SEED).select("corpus_id", F.col("id").cast("int").alias("quote_idx"), "k")
    return first, sent.all(), 1 + len(steps)


def assignments(quotes: DataFrame, vectors: DataFrame, target: int, least: int, block: int | None = None) -> DataFrame:
    """(corpus_id, cluster_pos, member_pos, quote_idx): the clusters of cluster.bounded(), small ones merged.

    A cluster's members are its seed, then the others in order, then those of clusters that it took in.
    """
    first, sent, _ = chain(packed(listed(quotes, vectors), block or block_size(target)), target)
    return _assigned(first, sent, target, least)


class Weighed(NamedTuple):
    """Of clustered quotes: idf has corpus_id, term (hashed) and idf, cosines what vectors.relevance() has."""

    idf: DataFrame
    cosines: DataFrame


def of_quotes(quotes: DataFrame, target: int, least: int, focus: str = "") -> tuple[DataFrame, Weighed | None]:
    """assignments() of quotes with their text: weights are made within blocks.  Where no clusters are merged, cosines come
    from the blocks, too."""
    block, terms = block_size(target), counted(quotes, focus)
    rows = packed(terms, block)
    first, sent, _ = chain(rows, target)
    found = _assigned(first, sent, target, least)
    if least > 1:
        return found, None
    df = terms.select("corpus_id", "total", F.explode("terms").alias("term")).groupBy("corpus_id", "term")
    df = df.agg(F.count("*").alias("df"), F.first("total").alias("total"))
    idf = df.select("corpus_id", "term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    place = found.select("corpus_id", "cluster_pos", "quote_idx")
    return found, Weighed(idf, place.join(_cosines(rows, first, sent, target, block), ["corpus_id", "quote_idx"]))


def _cosines(rows: DataFrame, first: DataFrame, sent: DataFrame, target: int, block: int) -> DataFrame:
    """(corpus_id, quote_idx, cos): each quote's cosine with its centroid as it is in the end, block by block."""

    def run(quotes: pa.Table, given: pa.Table) -> pa.Table:
        kind, at = _column(given, "kind"), _column(given, "id")
        values, begin = _lists(given, "sums")
        quotes = quotes.filter(pc.greater(quotes["quote_idx"], 0))
        ids, lone = _column(quotes, "quote_idx"), _column(quotes, "lone")
        (terms, edges), weights = _lists(quotes, "terms"), _lists(quotes, "weights")[0]
        row = np.repeat(np.arange(len(ids)), np.diff(edges))
        which, chosen = np.flatnonzero(kind == SUMS), np.flatnonzero(kind == CHOICE)
        which, chosen = which[np.argsort(at[which])], chosen[np.argsort(at[chosen])]
        k = _column(given, "k")[chosen[np.searchsorted(at[chosen], ids)]]
        sums = values[begin[which[np.searchsorted(at[which], terms)]] + k[row]]
        lengths = values[begin[np.flatnonzero(kind == LENGTHS)[0]] + np.arange(target)]
        dots, norm = np.bincount(row, weights * sums, len(ids)) + lone, np.sqrt(np.maximum(lengths, 0))[k]
        cos = np.divide(dots, norm, out=np.zeros(len(ids)), where=norm > 0)
        return pa.table({"corpus_id": quotes["corpus_id"], "quote_idx": ids.astype(np.int32), "cos": cos})

    # own names: both sides come from one table
    at = rows.where("quote_idx = 0").select(F.col("corpus_id").alias("corpus"), F.col("block").alias("part"), "terms")
    sums = sent.where((F.col("to") == BEHIND) & (F.col("kind") == SUMS)).select(F.col("corpus_id").alias("corpus"), "id", "sums")
    none, number = F.lit(None).cast("array<double>").alias("sums"), lambda n: F.lit(n).alias("kind")
    terms = at.select("corpus", "part", F.explode("terms").alias("id")).join(sums, ["corpus", "id"])
    terms = terms.select("corpus", "part", number(SUMS), "id", F.lit(0).alias("k"), "sums")
    own = _choices_of(sent).select("corpus_id", "quote_idx", "k").unionByName(first)
    own = own.select(F.col("corpus_id").alias("corpus"), _block(block).alias("part"), number(CHOICE), F.col("quote_idx").cast("long").alias("id"), "k", none)
    ends = _lengths(sent, target).select(F.col("corpus_id").alias("corpus"), F.col("lengths").alias("sums"))
    ends = at.select("corpus", "part").join(ends, "corpus").select("corpus", "part", number(LENGTHS), F.lit(0).cast("long").alias("id"), F.lit(0).alias("k"), "sums")
    given = terms.unionByName(own).unionByName(ends)
    return rows.groupBy(*KEY).cogroup(given.groupBy("corpus", "part")).applyInArrow(run, "corpus_id string, quote_idx int, cos double")


def _assigned(first: DataFrame, sent: DataFrame, target: int, least: int) -> DataFrame:
    from .cluster import merged_order

    members = _choices_of(sent).select("corpus_id", "quote_idx", "k", (F.col("place")).alias("at"))
    members = members.unionByName(first.withColumn("at", F.lit(1).cast("long")))
    size = members.groupBy("corpus_id", "k").agg(F.count("*").alias("n"), F.min("quote_idx").alias("low"))
    if least > 1:  # only then are the clusters' products needed
        product = _products(sent, target).groupBy("corpus_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("l", "dot"))).alias("dots"))
        size = size.join(product, ["corpus_id", "k"], "left")
    else:
        size = size.withColumn("dots", F.lit(None).cast("map<int,double>"))

    def order(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("k", ignore_index=True)
        dots = np.zeros((len(frame), len(frame)))
        for i, row in enumerate(frame["dots"]):
            for j, x in (dict(row) if row is not None else {}).items():
                dots[i, j] = x
        rows = merged_order(frame["n"].tolist(), frame["low"].tolist(), dots, least)
        out = pd.DataFrame(rows, columns=["k", "cluster_pos", "offset"])
        out.insert(0, "corpus_id", str(frame["corpus_id"].iloc[0]))
        return out

    # at most target rows a corpus
    place = stages.write(size.groupBy("corpus_id").applyInPandas(order, "corpus_id string, k int, cluster_pos int, offset long"))
    out = members.join(F.broadcast(place), ["corpus_id", "k"])
    return out.select("corpus_id", "cluster_pos", (F.col("offset") + F.col("at")).cast("int").alias("member_pos"), "quote_idx")


def _products(sent: DataFrame, target: int) -> DataFrame:
    """(corpus_id, k, l, dot): products of the clusters' sums; lengths are the last that were carried."""

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            corpus, sums = np.array(rows["corpus_id"].to_pylist(), object), _lists(rows, "sums")[0].reshape(-1, target)
            for c in sorted(set(corpus)):
                mine = sums[corpus == c]
                k, l = (x.reshape(-1) for x in np.indices((target, target)))  # noqa: E741
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(k)), pa.array(k, pa.int32()), pa.array(l, pa.int32()), pa.array((mine.T @ mine).reshape(-1))], ["corpus_id", "k", "l", "dot"]
                )

    sums = sent.where((F.col("to") == BEHIND) & (F.col("kind") == SUMS)).select("corpus_id", "sums")
    dots = sums.mapInArrow(run, "corpus_id string, k int, l int, dot double").groupBy("corpus_id", "k", "l").agg(F.sum("dot").alias("dot"))
    last = _lengths(sent, target).select("corpus_id", F.posexplode("lengths").alias("k", "dot"))
    return dots.where("k <> l").unionByName(last.select("corpus_id", "k", F.col("k").alias("l"), "dot"))


def _lengths(sent: DataFrame, target: int) -> DataFrame:
    """(corpus_id, lengths): squared lengths of the clusters' sums."""
    last = sent.where(F.col("kind") == LENGTHS).groupBy("corpus_id").agg(F.max_by("sums", "k").alias("s"))
    return last.select("corpus_id", F.slice("s", 1, target).alias("lengths"))

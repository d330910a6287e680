"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get numbers 0..N-1; a keyed permutation of 0..N-1 gives every row its place p, and p mod
shards and p div shards are its shard and slot.  So shard sizes differ by one row at most, slots
have no gaps, and shard and slot of any row number can be computed alone.

The permutation is an alternating Feistel network on a*b >= N places (a and b near sqrt(N)):
rounds add a function of one half to the other, modulo a or b; places >= N walk on along their
cycle.  At most a*b - N < a places lie outside, so a walk is short.

Global row numbers need no single sorted partition.  Rows that agree in doc_id, checksum and size
are interchangeable and are counted together first, so a row that comes often is one entry.
Entries are dealt by their hash into buckets of about BUCKET rows, whatever N is; running sums
over buckets (by runs of RUN, then over runs) and within a bucket number them, and an entry's
numbers are spelled out again, those of a frequent one by several tasks.  Numbers depend on the
rows alone, not on partitions, so the shuffle is reproducible.

All of it is DataFrame functions.  Defined cases: null doc_ids are rows like others; rows that
agree in doc_id, checksum and size share their numbers in any order; null text counts 0 bytes and
checksum 0; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shared

BUCKET = 20_000
RUN = 4096
ROUNDS = 6
PRIME = 2147483647
#: Multipliers and offsets of the round function, one pair a round.
KEYS = [(48271, 11), (69621, 1013), (40692, 70001), (1103515, 52711), (279470, 900001), (39373, 123457)]
WALK = 64


def sides(n: int) -> tuple[int, int]:
    a = 1
    while a * a < n:
        a = a * 2 if a * a * 4 < n else a + 1
    return a, max(1, -(-n // a))


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, row_number), and N; the text is read once."""
    key = ["doc_id", "size", "text_crc32"]
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    entries = shared.cut(rows.groupBy(*key).agg(F.count("*").alias("n")))
    total = entries.agg(F.sum("n")).first()[0] or 0
    if not total:
        return entries.select(*key, F.lit(0).cast("long").alias("row_number")), 0
    buckets = -(-total // BUCKET)
    entries = entries.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))

    def before(*by):
        return Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column, window):
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    sizes = entries.groupBy("bucket").agg(F.sum("n").alias("b")).withColumn("run", F.floor(F.col("bucket") / RUN))
    runs = sizes.groupBy("run").agg(F.sum("b").alias("r")).withColumn(
        "runs_before", so_far("r", before().orderBy("run"))
    ).drop("r")
    sizes = sizes.withColumn("buckets_before", so_far("b", before("run").orderBy("bucket"))).join(runs, "run")
    offsets = sizes.select("bucket", (F.col("runs_before") + F.col("buckets_before")).alias("start"))
    own = entries.withColumn("own", so_far("n", before("bucket").orderBy(*key))).join(offsets, "bucket")
    own = own.select(*key, "n", (F.col("start") + F.col("own")).alias("start"))
    last = F.col("start") + F.col("n") - 1
    few = own.where(F.col("n") <= BUCKET).select(*key, F.explode(F.sequence("start", last)).alias("row_number"))
    parts = own.where(F.col("n") > BUCKET).select(
        *key, F.explode(F.sequence("start", last, F.lit(BUCKET).cast("long"))).alias("low"), last.alias("last")
    )
    parts = parts.repartition("low")  # the parts of a frequent entry, over several tasks
    many = parts.select(*key, F.explode(F.sequence("low", F.least(F.col("low") + (BUCKET - 1), "last"))).alias("row_number"))
    return few.unionByName(many), total


def step(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over a place; halves are x mod a and x div a."""
    keys = F.array(
        *[
            F.struct(
                F.lit(m).cast("long").alias("m"), F.lit((c + seed) % PRIME).cast("long").alias("c"),
                F.lit(i % 2 == 0).alias("left")
            ) for i,
            (m, c) in enumerate(KEYS[:ROUNDS])
        ]
    )

    def turn(s, k):
        other = F.when(k["left"], s["r"]).otherwise(s["l"])
        t = F.pmod(F.pmod(other + k["c"], F.lit(PRIME)) * k["m"] + k["c"], F.lit(PRIME))
        t = F.pmod(t * t, F.lit(PRIME))
        return F.struct(
            F.when(k["left"], F.pmod(s["l"] + t, F.lit(a).cast("long"))).otherwise(s["l"]).alias("l"),
            F.when(k["left"], s["r"]).otherwise(F.pmod(s["r"] + t, F.lit(b).cast("long"))).alias("r"),
        )

    start = F.struct(F.pmod(x, F.lit(a).cast("long")).alias("l"), F.floor(x / a).cast("long").alias("r"))
    start = F.struct(F.pmod(x, F.lit(a).cast("long")).alias("l"), F.expr("0L").alias("r")) if b == 1 else start
    return F.aggregate(keys, start, turn, lambda s: s["r"] * a + s["l"])


def permuted(x: Column, n: int, seed=0) -> Column:
    """The place of row number x among n, by cycle walking."""
    a, b = sides(n)
    walk = min(WALK, a * b - n)
    first = step(x, a, b, seed)
    if not walk:
        return first
    out = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), first, lambda p, _: F.when(p < n, p).otherwise(step(p, a, b, seed)))
    return out if walk == a * b - n else F.when(out < n, out).otherwise(
        F.raise_error(F.lit("a walk left its bound; choose another seed")).cast("long")
    )


def shard(docs: DataFrame, shards=8, seed=0) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, place, shard, slot)"""
    rows, n = numbered(docs)
    rows = rows.withColumn("place", permuted(F.col("row_number"), n, seed) if n else F.col("row_number"))
    return rows.withColumns({"shard": F.pmod("place", F.lit(shards)).cast("int"), "slot": F.expr(f"place div {shards}")})

"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A list has rows (host, path, verdict); an entry fits its host and all subdomains, if the URL's
path starts with the entry's, and the longest fitting entry decides.  The canonical forms that a
URL can match are its host suffixes joined with its path prefixes, only of as many labels and of
such lengths as the list has.  Each form is looked up in a blocked Bloom filter (one block of
four 64-bit words a key, joined by block number); what passes goes to an exact equi-join with
the list, which removes false positives.  Everything is DataFrame functions.

The filter has BITS_PER_KEY bits for each entry, so it rules out as much of a long list as of a
short one.  Up to BLOCKS blocks it is broadcast; a larger one is joined by block number like any
table.  Distinct (host, path) pairs are judged
once and joined back, so a URL repeated in a third of the rows is judged once.

Defined cases: a null URL or one without "://" has empty host and path and gets the default
verdict; entries with an empty or null host are ignored; equal entries with different verdicts:
the greater string ("block") wins; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Blocks of 256 bits, 40 bytes a row, that are broadcast: 2.6 MB.
BLOCKS = 1 << 16
BITS_PER_KEY = 16
PROBES = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; A-Z lower-cased; else empty."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.locate("://", url) > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def masks(key: Column) -> list[Column]:
    """The four words of a key's bits within its block."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = [F.shiftrightunsigned(h, 8 * i).bitwiseAND(255) for i in range(PROBES)]

    def word(w):
        out = F.lit(0).cast("long")
        for b in bit:
            one = F.expr("1L")
            on = F.call_function("shiftleft", one, b.bitwiseAND(63).cast("int"))
            out = out.bitwiseOR(F.when(F.shiftright(b, 6) == w, on).otherwise(F.lit(0).cast("long")))
        return out

    return [word(w) for w in range(4)]


def blocked_bloom(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, w0..w3): bits are set by a partial and a final bit_or, never gathered."""
    m = masks(F.col(column))
    cols = [F.bit_or(m[w]).alias(f"w{w}") for w in range(4)]
    return keys.groupBy(block_of(F.col(column), blocks).alias("block")).agg(*cols)


def may_contain(keys: DataFrame, column: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows of keys that the filter can't rule out."""
    m = masks(F.col(column))
    probe = keys.withColumn("block", block_of(F.col(column), blocks))
    hit = None
    for w in range(4):
        own = F.col(f"w{w}").bitwiseAND(m[w]) == m[w]
        hit = own if hit is None else hit & own
    bloom = F.broadcast(bloom) if blocks <= BLOCKS else bloom
    return probe.join(bloom, "block").where(hit).select(*keys.columns)


def judge(pages: DataFrame, listed: DataFrame, default="allow") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, listed): the longest fitting entry of each URL."""
    rules = listed.select(
        F.translate(
            "host", UPPER, LOWER
        ).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host <> ''")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    rules = rules.withColumn("key", F.concat("r_host", F.lit("\n"), "r_path"))
    shape = rules.agg(
        F.max(
            F.size(F.split("r_host", r"\."))
        ).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"), F.count("*").alias("n")
    ).first()
    sized = 1 << max(4, (shape.n * BITS_PER_KEY // 256).bit_length())

    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    distinct = parsed.select("host", "path").where("host <> ''").distinct()
    hosts = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, (shape.labels or 1) + 1)]))
    paths = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shape.lengths) or [0]])
    forms = distinct.select("host", "path", F.explode(hosts).alias("f_host"), paths.alias("paths"))
    forms = forms.select("host", "path", "f_host", F.explode("paths").alias("f_path")).where("f_path is not null")
    forms = forms.select("host", "path", F.concat("f_host", F.lit("\n"), "f_path").alias("key"))
    passed = may_contain(forms, "key", blocked_bloom(rules, "key", sized), sized)
    fits = passed.join(rules, "key").select("host", "path", F.concat("r_host", "r_path").alias("rule"), "r_verdict")
    longest = F.max(F.struct(F.length("rule").alias("n"), "rule", "r_verdict")).alias("best")
    best = fits.groupBy("host", "path").agg(longest).select("host", "path", "best.rule", "best.r_verdict")
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce(
            "r_verdict", F.lit(default)
        ).alias("verdict"), F.col("rule").isNotNull().alias("listed")
    )

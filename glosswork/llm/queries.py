"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontamination,
    embedding_dedup,
    language_id,
    ngram_join,
    periodic_runs,
    prefix_trie,
    quality,
    segmentation,
    sharding,
    shared,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filter,
)

#: The list of the URL query: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id, modulus: int, rest: int):
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))


def op1_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_benchmark_decontamination(spark, sf_dir):
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return segmentation.encode(docs, check=True).select("doc_id", "n_pieces", "pieces", "lossless")


def toxic_scores(docs, labels, keep=None):
    return toxicity.score(docs, toxicity.fit(docs, labels, keep=keep))


def op4_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    scored = toxic_scores(docs, labels, lambda c: ~held_out(c, 4, 2))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op5_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.link(read(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels, keep=lambda c: ~held_out(c, 3, 1)))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_sharding(spark, sf_dir):
    out = sharding.shard(read(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard")
    )


def op8_suffix_array_dedup(spark, sf_dir):
    out = suffix_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_substring_dedup(spark, sf_dir):
    out = substring_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join(read(spark, sf_dir, "documents"))


def with_periods(docs):
    """documents, as the query of op11 has them: with h = crc32 of the id, in the documents with h % 10 = 0 the n words from
    word a = g % n on repeat the first p of these, g being floor(h / 10) and p = 1 + floor((n - a) / (3 + g % 8))."""
    word = r"[^\x20\x09-\x0D]+"
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.withColumn("ws", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(word), F.lit(0))))
    n, g = F.size("ws").cast("long"), F.floor(h / 10)
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("ws", at(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    docs = with_periods(read(spark, sf_dir, "documents").select("doc_id", "text"))
    out = periodic_runs.find(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256")
    )


def grafted(turns: DataFrame) -> DataFrame:
    """Numbered turns as the query of op12 has them: a conversation c begins with the first h turns of
    c - c % 5, h being crc32(c) % 9, and goes on with its own turns from the one behind its first h."""
    h = lambda c: (F.crc32(c.cast("string")) % 9).cast("int")
    convs = turns.where("pos = 0").select("conv_id", "total", (F.col("conv_id") - F.col("conv_id") % 5).alias("donor"))
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("total").alias("have"))
    lent = F.least(h(F.col("conv_id")), F.coalesce("have", F.lit(0))).alias("lent")
    convs = convs.join(donors, "donor", "left").select("conv_id", "donor", lent)
    given = turns.where((F.col("conv_id") % 5 == 0) & (F.col("pos") < 8)).withColumnRenamed("conv_id", "donor")
    given = given.join(convs, "donor").where("pos < lent").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "token", "size"
    )
    # where the donor has all h turns, own turns keep their places; others are few and moved up
    short = convs.where(F.col("lent") < h(F.col("conv_id"))).select(
        "conv_id", (h(F.col("conv_id")) - F.col("lent")).alias("up")
    )
    own = turns.where(F.col("pos") >= h(F.col("conv_id"))).join(short, "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") + 1 - F.coalesce("up", F.lit(0))).alias("depth"), "token", "size")
    exists = convs.select("conv_id", *[F.lit(None).cast(kind).alias(name) for name, kind in own.dtypes[1:]])
    return exists.unionByName(given).unionByName(own)


def op12_conversation_prefix_trie(spark, sf_dir):
    with shared.scratch() as held:
        held.append(shared.written(prefix_trie.numbered(read(spark, sf_dir, "conversations"))))
        return prefix_trie.nodes(grafted(held[0]))


def op13_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = language_id.profiles(docs, keep=lambda c: ~held_out(c, 3, 1))
    out = language_id.predict(docs, learned)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_benchmark_decontamination,
        op3_sentencepiece,
        op4_toxicity,
        op5_embedding_near_dedup,
        op6_quality_classifier,
        op7_sharding,
        op8_suffix_array_dedup,
        op9_substring_dedup,
        op10_ngram_jaccard_join,
        op11_periodic_runs,
        op12_conversation_prefix_trie,
        op13_language_id,
    )
}

HOST = "CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
PATH = "CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

# DuckDB has no crc32: bit by bit over the bytes of a decimal id, as Spark's crc32 of that text
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda s: ascii(s))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]),
           lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

SQL = {
    "op1_url_filters": f"""
        WITH u AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages),
             r(h, p, v) AS (VALUES {RULES}),
             d AS (SELECT DISTINCT host, path FROM u),
             b AS (SELECT host, path, max((length(h || p), h || p, v)) AS best FROM d JOIN r
                   ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
        SELECT page_id, u.host, u.path, best[2] AS rule, coalesce(best[3], 'allow') AS verdict
        FROM u LEFT JOIN b ON u.host = b.host AND u.path = b.path""",
    # 20-word windows by their words, joined by a space: words hold none
    "op9_substring_dedup": r"""
        WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
             p AS (SELECT doc_id, unnest(ws[1:greatest(0, len(ws) - 19)]) AS x, generate_subscripts(ws[1:greatest(0, len(ws) - 19)], 1) AS i FROM w),
             g AS (SELECT p.doc_id, i, list_aggregate(ws[i:i + 19], 'string_agg', ' ') AS k FROM p JOIN w ON p.doc_id = w.doc_id),
             f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g),
             s AS (SELECT doc_id, list(i ORDER BY i) AS starts FROM f WHERE n > 1 GROUP BY doc_id),
             m AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE n > 1),
             a AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS j FROM w),
             k AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY a.j) AS kept, count(*) AS n FROM a ANTI JOIN m ON a.doc_id = m.doc_id AND a.j = m.j GROUP BY a.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    # pairs of equal words p apart; islands of such pairs are runs, the smallest period of a stretch counts
    "op11_periodic_runs": rf"""
        WITH w0 AS (SELECT doc_id, {CRC32.format("doc_id")} AS h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
             w1 AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM w0),
             w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1),
             w AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws
                   ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws FROM w2),
             s AS (SELECT doc_id, n, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS i FROM w),
             e AS (SELECT l.doc_id, r.i - l.i AS p, l.i FROM s l JOIN s r ON l.doc_id = r.doc_id AND l.x = r.x AND l.i < r.i AND 4 * (r.i - l.i) <= l.n),
             b AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e),
             m AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM b GROUP BY doc_id, p, island),
             u AS (SELECT doc_id, start, length, min(p) AS period FROM m WHERE length >= greatest(6, 4 * p) GROUP BY doc_id, start, length),
             v AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM u GROUP BY doc_id),
             t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS k FROM u),
             d AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
             k AS (SELECT s.doc_id, string_agg(x, ' ' ORDER BY s.i) AS kept FROM s ANTI JOIN d ON s.doc_id = d.doc_id AND s.i = d.i GROUP BY s.doc_id)
        SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length,
               CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
               sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM w LEFT JOIN v ON w.doc_id = v.doc_id LEFT JOIN t ON w.doc_id = t.doc_id AND k = 1 LEFT JOIN k ON w.doc_id = k.doc_id""",
    # a node is named by the digest of its beginning, built turn by turn
    "op12_conversation_prefix_trie": rf"""
        WITH RECURSIVE
             o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, {CRC32.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
             q AS (SELECT c.conv_id, role, text, pos FROM c JOIN o ON o.conv_id = donor WHERE pos < h
                   UNION ALL SELECT c.conv_id, role, text, pos FROM c JOIN o ON o.conv_id = c.conv_id WHERE pos >= h),
             t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM q),
             p AS (SELECT conv_id, 0 AS depth, '' AS node, '' AS up, 0 AS size, conv_id AS c FROM c
                   UNION ALL SELECT t.conv_id, t.depth, sha256(p.node || length(role) || ':' || role || text), p.node, strlen(text), p.c
                   FROM p JOIN t ON t.conv_id = p.conv_id AND t.depth = p.depth + 1),
             n AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY node),
             k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
             f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.node),
             s AS (SELECT p.node, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * f.size) AS saved_tokens
                   FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.node),
             l AS (SELECT conv_id, max_by(node, depth) AS node FROM p GROUP BY conv_id),
             e AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM l GROUP BY node)
        SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
               CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM f JOIN s ON f.node = s.node LEFT JOIN e ON f.node = e.node LEFT JOIN f u ON f.depth > 0 AND u.node = f.up""",
    # n-grams of one to three characters of lower-case words between spaces, by word
    "op13_language_id": rf"""
        WITH d AS (SELECT doc_id, lang, {CRC32.format("doc_id")} % 3 = 1 AS held_out, text FROM documents),
             w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS word FROM d),
             c AS (SELECT doc_id, ' ' || word || ' ' AS word, count(*) AS n FROM w GROUP BY ALL),
             g AS (SELECT doc_id, substr(word, i, k) AS gram, sum(n) AS n
                   FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM c), (VALUES (1), (2), (3)) v(k)
                   WHERE i + k - 1 <= length(word) AND substr(word, i, k) <> ' ' GROUP BY ALL),
             x AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS r
                   FROM g JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY r < {language_id.PROFILE}),
             y AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) - 1 AS r FROM g QUALIFY r < {language_id.PROFILE}),
             m AS (SELECT doc_id, count(*) AS m FROM y GROUP BY doc_id),
             a AS (SELECT doc_id, lang, sum({language_id.PROFILE} - abs(y.r - x.r)) AS saved FROM y JOIN x USING (gram) GROUP BY doc_id, lang),
             z AS (SELECT m.doc_id, l.lang, ({language_id.PROFILE} * m - coalesce(saved, 0)) / ({language_id.PROFILE} * m) AS dist
                   FROM m CROSS JOIN (SELECT DISTINCT lang FROM x) l LEFT JOIN a ON a.doc_id = m.doc_id AND a.lang = l.lang),
             b AS (SELECT doc_id, list((dist, lang) ORDER BY dist, lang) AS near FROM z GROUP BY doc_id)
        SELECT d.doc_id, held_out, coalesce(near[1][2], 'und') AS lang_pred,
               CASE WHEN near IS NULL OR coalesce(near[2][1], 1) = 0 THEN 0.0 ELSE 1 - near[1][1] / coalesce(near[2][1], 1) END AS score
        FROM d LEFT JOIN b ON d.doc_id = b.doc_id""",
}

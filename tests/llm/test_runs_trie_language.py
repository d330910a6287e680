"""Periodic runs, the prefix trie of conversations and language identification: against brute force and SQL,
and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from glosswork.llm import language_id, periodic_runs, prefix_trie, queries

SF = "/root/testdata/sf0.001"


# --- periodic runs


def brute_runs(s, min_length, min_exponent):
    """Islands of places where s[i] == s[i + p], for each p; the smallest p of a stretch."""
    found = {}
    for p in range(1, len(s)):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j - i + p >= max(min_length, min_exponent * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((a, n, p) for (a, n), p in found.items())


def test_runs_are_those_of_brute_force():
    rng = random.Random(3)
    for _ in range(4000):
        n, letters = rng.randint(0, 50), rng.choice((1, 2, 3, 6))
        s = [rng.randrange(letters) for _ in range(n)]
        if n > 8 and rng.random() < 0.6:  # a periodic end, and one word of it changed
            a, p = rng.randrange(n // 2), rng.randint(1, 5)
            s = [s[i] if i < a else s[a + (i - a) % p] for i in range(n)]
            if rng.random() < 0.5:
                s[rng.randrange(n)] = 9
        limits = rng.choice(((2, 2), (6, 4), (1, 3)))
        assert periodic_runs.runs(s, *limits) == brute_runs(s, *limits), s


@pytest.mark.parametrize("block", [[1], [1, 2, 3], [2, 1, 1, 2, 1], None])
def test_next_smaller_suffixes_compare_each_agreement_once(block):
    class Word(int):
        seen = 0

        def __eq__(self, other):
            Word.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    n = 4000
    if block is None:  # a Fibonacci word
        a, block = [1], [1, 2]
        while len(block) < n:
            a, block = block, block + a
    s = [Word(block[i % len(block)]) for i in range(n)]
    for less in (int.__lt__, int.__gt__):
        Word.seen = 0
        jump, same = periodic_runs.next_smaller(s, less)
        assert Word.seen < 12 * n
    plain = [int(x) for x in s[-60:]]
    jump, same = periodic_runs.next_smaller(plain, int.__lt__)
    for i in range(60):
        j = next((j for j in range(i + 1, 60) if plain[j:] < plain[i:]), 60)
        assert jump[i] == j


def test_runs_of_odd_rows(spark):
    long = "a b " * 50_000
    rows = [
        (1, "x y " * 4, "kept"), (1, "x y " * 4, "kept"), (None, "z " * 6, None), (2, None, "n"), (3, "", "e"), (4, " \t\n", "s"),
        (5, long, "l"), (6, "  " * 6 + "ä", "u"), (7, "A a " * 4, "case")
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Runs string").withColumn("a.b", F.lit(1)).withColumn("__runs", F.lit(2))
    out = periodic_runs.find(docs)
    assert set(out.columns) == {"doc_id", "text", "a.b", "__runs", "n_words", "runs", "collapsed"}
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
    assert got == sorted(
        [
            (1, 8, [(0, 8, 2)], "x y"), (1, 8, [(0, 8, 2)], "x y"), (0, 6, [(0, 6, 1)], "z"), (2, 0, [], None), (3, 0, [], ""),
            (4, 0, [], ""), (5, 100_000, [(0, 100_000, 2)], "a b"), (6, 7, [(0, 6, 1)], "  ä"), (7, 8, [(0, 8, 2)], "A a")
        ],
        key=str
    )
    assert periodic_runs.find(docs.limit(0)).count() == 0
    best = spark.createDataFrame([([(0, 9, 2), (3, 18, 4), (40, 9, 2)],)], f"runs {periodic_runs.RUNS}")
    assert tuple(best.select(periodic_runs.strongest(F.col("runs")).alias("b")).first().b) == (0, 9, 2)


# --- the prefix trie


def brute_trie(seqs):
    members, ends, kids = defaultdict(list), defaultdict(list), Counter()
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(ends[k]))
        for k, m in members.items()
    )


def by_node(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def conversations(seed, n):
    """Conversations of which many share beginnings, and a third are copies of one."""
    rng, turns = random.Random(seed), [("u", "a"), ("u", "bb"), ("x", "é"), ("", ""), ("ua", "")]
    seqs = {}
    for c in rng.sample(range(-20, 3000), n):
        s = [rng.choice(turns) for _ in range(rng.choice((0, 1, 2, 3, 9, 14)))]
        if seqs and rng.random() < 0.5:
            s = rng.choice(list(seqs.values()))[: rng.randint(0, 12)] + s[: rng.randint(0, 3)]
        seqs[c] = [turns[0]] * 5 if rng.random() < 0.33 else s
    return seqs


@pytest.mark.parametrize("seed, block, part, least", [(1, 256, 1 << 20, 1 << 12), (2, 256, 30, 20), (3, 4, 30, 20), (4, 2, 1 << 20, 10)])
def test_trie_is_that_of_brute_force(spark, seed, block, part, least):
    seqs = conversations(seed, 90)
    rows = [(c, i, role, text) for c, s in seqs.items() for i, (role, text) in enumerate(s)]
    turns = prefix_trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    turns = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "token", "size")
    exists = spark.createDataFrame([(c,) for c in seqs], "conv_id long")
    exists = exists.select("conv_id", *[F.lit(None).cast(kind).alias(name) for name, kind in turns.dtypes[1:]])
    assert by_node(prefix_trie.nodes(turns.unionByName(exists), block, part, least)) == brute_trie(seqs)


def test_merging_looks_at_no_shared_token_twice():
    """Runs whose conversations share a long beginning: the tokens that are compared grow with what differs."""
    rng = random.Random(1)
    token = lambda x: hashlib.sha256(str(x).encode()).digest()[: prefix_trie.TOKEN]
    start = b"".join(map(token, range(200)))
    runs, seen, count = [], 0, prefix_trie.common
    for r in range(8):
        items = sorted((start + token(rng.random()), r * 100 + i, [0] * 201, 0, 0, 0) for i in range(50))
        shares = [0] + [prefix_trie.common(a[0], b[0]) for a, b in zip(items, items[1:])]
        runs.append(prefix_trie.coded(items, shares))

    def counted(a, b, k=0):
        nonlocal seen
        out = count(a, b, k)
        seen += out - k + 1
        return out

    prefix_trie.common = counted
    try:
        got = [(key, conv) for key, conv, *_ in prefix_trie.merged(runs)]
    finally:
        prefix_trie.common = count
    assert got == sorted(got) and len(got) == 400
    assert seen < 8 * 201 + 400 * 4  # each run's head once in full, then only what differs


def test_numbered_turns_of_odd_rows(spark):
    rows = [(1, None, "u", "first"), (1, 5, None, None), (1, 5, None, None), (1, -3, "u", "é"), (None, 1, "u", "gone"), (2, 70_000, "u", "b"), (2, 1, "u", "a")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.pos, r.total, r.size) for r in prefix_trie.numbered(t).collect())
    assert got == [(1, 0, 4, 5), (1, 1, 4, 2), (1, 2, 4, 0), (1, 3, 4, 0), (2, 0, 2, 1), (2, 1, 2, 1)]
    none = prefix_trie.numbered(t.limit(0)).select("conv_id", F.col("pos").alias("depth"), "token", "size")
    assert prefix_trie.nodes(none).count() == 0


# --- language identification


def brute_grams(text):
    words = [f" {w} " for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    return Counter(g for w in words for k in (1, 2, 3) for g in (w[i : i + k] for i in range(len(w) - k + 1)) if g != " ")


def brute_languages(rows, keep, most):
    total = defaultdict(Counter)
    for d, text, lang in rows:
        if lang is not None and keep(d):
            total[lang].update(brute_grams(text))
    best = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:most]]
    ranks = {lang: {g: r for r, g in enumerate(best(c))} for lang, c in total.items() if c}
    out = []
    for d, text, _ in rows:
        mine = best(brute_grams(text))
        apart = sorted((sum(abs(t[g] - r) if g in t else most for r, g in enumerate(mine)) / (most * max(1, len(mine))), x) for x, t in ranks.items())
        out.append((d, apart[0][1] if mine and apart else "und"))
    return out


@pytest.mark.parametrize("langs", [language_id.LANGS, 2])
def test_languages_are_those_of_brute_force(spark, langs):
    rng = random.Random(2)
    alphabets = {"aa": "abcdeé", "bb": "bcdfgß", "cc": "cdghİi", "": "한국어가나", "dd": "abcfg"}
    rows = [
        (i, "".join(rng.choice(a) if rng.random() < 0.8 else rng.choice(" ,.\n1_") for _ in range(rng.randint(1, 300))), lang)
        for i, (lang, a) in enumerate(list(alphabets.items()) * 12)
    ]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 !?\0", "cc"), (103, "abc", None), (104, "Abc ABC", "aa"), (104, "Abc ABC", "aa"), (None, "ceg", "cc"), (105, "é" * 300_000, "aa"), (106, "a\0b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("Score", F.lit("x")).withColumn("__nearest", F.lit(1)).repartition(3)
    learned = language_id.profiles(docs, keep=lambda c: F.coalesce(c % 3 != 1, F.lit(True)), most=60)
    out = language_id.predict(docs, learned, 60, langs)
    assert set(out.columns) == {"doc_id", "text", "lang", "__nearest", "lang_pred", "score"}
    got = Counter((r.doc_id, r.lang_pred) for r in out.collect())
    assert got == Counter(brute_languages(rows, lambda d: d is None or d % 3 != 1, 60))
    assert all(0 <= r.score <= 1 for r in out.collect())
    nothing = language_id.predict(docs, learned.limit(0), 60, langs)
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert language_id.predict(docs.limit(0), learned, 60, langs).count() == 0


# --- the queries against their SQL, over whole tables


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_conversation_prefix_trie", "op13_language_id"])
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == want.columns
    plain = lambda r: tuple(round(x, 12) if isinstance(x, float) else x for x in r)
    assert Counter(plain(r) for r in got.collect()) == Counter(plain(r) for r in want.fetchall())


def test_language_is_found_on_held_out_documents(spark):
    out = queries.op13_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = out.join(docs, "doc_id").where("lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98

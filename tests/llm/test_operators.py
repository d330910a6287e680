"""Every operator against a brute-force version, and on nulls, empty texts, ties, repeats, empty
tables and clashing column names."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glosswork.llm import (
    decontamination, embedding_dedup, kernel, ngram_join, quality, queries, segmentation, shared, sharding, substring_dedup, suffix_dedup, toxicity, url_filter,
)

DOC = "doc_id long, text string"
RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(t, share, rng=RNG):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in t.split())


def corpus():
    """Unique texts, exact and near copies, shared passages, and odd rows."""
    passage, base = text(60), text(120)
    rows = [text(RNG.randint(1, 150)) for _ in range(40)]
    rows += [text(30) + " " + passage + " " + text(30) for _ in range(6)]
    rows += [edited(base, s) for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)]
    rows += [
        text(40) + "\n" + rows[0], passage + " " + passage, "é" * 80, "é" * 80, "", None, " \t\n ", "a", "A", "a b c d",
        "x " * 200, "ünïcode  " * 30
    ]
    out = list(enumerate(rows))
    return out + [out[3], (None, rows[41]), (None, None), (3, "another text with the same id")]


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).persist()


def order(doc_id):
    return doc_id if doc_id is not None else repeats_no_id


repeats_no_id = (1 << 63) - 1


def test_words_and_hashes():
    t = ["a  b\tc", "", None, " x ", "a\x0bb\x0c\x1cz"]
    w = kernel.Words(pa.array(t))
    assert w.counts().tolist() == [3, 0, 0, 1, 3]
    found = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
    assert found == [x for s in t for x in (s or "").encode().split()]
    assert w.hash[0] == w.hash[4] and len(set(w.hash.tolist())) == len(set(found))
    v = kernel.Words(pa.array(["a b a b"]))
    pairs = kernel.windows(v.hash, 2)
    assert pairs[0] == pairs[2] != pairs[1]


def test_part_keys_reach_every_partition(spark):
    keys = shared.part_keys(7)
    got = spark.createDataFrame([(int(k),) for k in keys], "part int").repartition(7, "part").select(
        F.spark_partition_id().alias("p"), "part"
    ).collect()
    assert {r.p: r.part for r in got} == dict(enumerate(keys.tolist()))


def test_components(spark):
    edges = [
        (5, 3), (3, 9), (9, 9), (9, 5), (20, 21), (21, 22), (22, 23), (23, 24), (1, 2)
    ] + [(100, 101 + i) for i in range(50)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert [got[i] for i in (3, 5, 9, 24, 2, 150)] == [3, 3, 3, 20, 1, 100]
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1


def brute_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_url_filter(spark):
    urls = [
        "http://a.example.net/fr/x", "https://EXAMPLE.net/en/1?x=/de/", "http://example.com/de/", "http://x.example.com/de", "http://b.org/fr/#t", "ftp://org/fr/a", "http://net", "http://net/", "http://xnet/",
        "http://a.net?q=1://b", "no scheme", None, "", "://", "://net/en/", "http://Ünet/", "http://a.b.c.d.e.example.net/en/", "http://example.net./en/", "http://net:80/",
    ]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "y"), (None, urls[1], None)]
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string"), rules).collect()
    want = Counter((i, *brute_rule(u, queries.URL_RULES)) for i, u, _ in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == want
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert {
        r.verdict for r in url_filter.judge(
            spark.createDataFrame(rows, "page_id long, url string, z string"), rules.limit(0)
        ).collect()
    } == {"allow"}


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("host/"), "id").alias("key"))
    bloom = url_filter.blocked_bloom(keys, "key", 256)
    assert url_filter.may_contain(keys, "key", bloom, 256).count() == 3000
    others = spark.range(3000).select(F.concat(F.lit("other/"), "id").alias("key"))
    assert url_filter.may_contain(others, "key", bloom, 256).count() < 600


# --- 2


def test_decontamination(spark):
    items = [(i, text(40)) for i in range(5)] + [(5, "tiny"), (6, ""), (7, None), (None, text(20))]
    para = items[1][1].split()
    para[5] = para[13] = para[27] = "changed"
    del para[20]
    rows = [
        (0, text(200)), (1, text(50) + " " + items[0][1].upper() + " " + text(50)), (2, text(80) + " " + " ".join(para)),
        (3, None), (4, ""), (5, items[0][1]), (5, items[0][1]), (None, items[0][1]),
        (6, " ".join(items[2][1].split()[:10]) + " " + text(90))
    ]
    rows += [(100 + i, text(150)) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(frame(spark, rows), bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (5, 0)}
    assert got[1, 0].score == 1.0 and (got[1, 0].first_word, got[1, 0].last_word) == (50, 89)
    assert 0.5 < got[2, 1].score < 1.0
    assert decontamination.contaminated(frame(spark, []), bench).count() == 0
    assert decontamination.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_a_copy_whose_surviving_trigrams_are_common(spark):
    words = text(26).split()
    copy = list(words)
    for i in (2, 5, 8, 11, 14):
        copy[i] = "changed"
    rows = [(i, " ".join(copy)) for i in range(30)] + [(100, " ".join(words)), (101, text(60))]
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontamination.contaminated(frame(spark, rows), bench).collect()}
    assert got == {i: (2 * 21 - 5) / 52 for i in range(30)} | {100: 1.0}


def test_decontamination_with_one_intact_trigram(spark):
    short, long = "a b c d e f g h", text(60).split()
    far = long[:30] + [f"x{i}" for i in range(55)] + long[30:]  # the gap parts the hits: two passages
    thin = [  # its only trigrams are at the end
        x for i, w in enumerate(long) for x in ([w, f"y{i}"] if i < 56 and i % 2 else [w])
    ]
    rows = [(0, "a b c X e f Y h"), (1, text(30) + " a b c X e f Y h " + text(30)), (2, " ".join(far)), (3, " ".join(thin))]
    bench = spark.createDataFrame([(0, short), (1, " ".join(long))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(0, 0): 10 / 16, (1, 0): 10 / 16, (2, 1): 65 / 120, (3, 1): 92 / 120}


def brute_align(p, q):
    h = np.zeros((len(q) + 1, len(p) + 1), int)
    for j in range(1, len(q) + 1):
        for i in range(1, len(p) + 1):
            h[j, i] = max(0, h[j - 1, i - 1] + (2 if p[i - 1] == q[j - 1] else -1), h[j - 1, i] - 1, h[j, i - 1] - 1)
    return h.max()


def test_alignment_scores():
    rng = np.random.default_rng(1)
    p = [rng.integers(2, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(40)]
    q = [rng.integers(2, 6, rng.integers(1, 15)).astype(np.uint64) for _ in range(40)]
    best, first, last = decontamination.align(p, q)
    assert best.tolist() == [brute_align(a, b) for a, b in zip(p, q)]
    for a, b, s, i, j in zip(p, q, best, first, last):
        assert s == 0 or brute_align(a[i : j + 1], b) == s


def test_decontamination_recall_over_edit_shares(spark):
    """Copies with edited, dropped and added words, against Smith-Waterman of every pair."""
    rng = random.Random(21)
    items = [(i, text(rng.choice([12, 25, 40]), rng)) for i in range(6)]
    rows = []
    for i in range(120):
        item = items[i % 6][1].split()
        share = rng.choice([0.1, 0.2, 0.3])
        copy = []
        for w in item:
            x = rng.random()
            copy += [w] if x >= share else [] if x < share / 4 else [w, f"n{i}"] if x < share / 2 else [f"m{i}{len(copy)}"]
        rows.append((i, text(15, rng) + " " + " ".join(copy) + " " + text(15, rng)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(frame(spark, rows), bench).collect()}
    number = {}
    code = lambda t: [number.setdefault(w, len(number)) for w in t.split()]
    want = {}
    for d, t in rows:
        for k, item in items:
            score = brute_align(code(t), code(item)) / (2 * len(item.split()))
            if score >= 0.5:
                want[d, k] = score
    assert len(want) > 90 and set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) >= 0.97 * len(want)


# --- 3


@pytest.fixture(scope="module")
def voc():
    return segmentation.Vocabulary()


def test_sampling_follows_the_lattice(voc):
    table = {}
    for i, w in zip(voc.ids, voc.weight):
        table.setdefault(voc.pieces[i], []).append((int(i), np.exp(w)))

    def all_ways(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            for i, w in table.get(s[:k], ()):
                for rest, v in all_ways(s[k:]):
                    yield (i, *rest), w * v

    ways = dict(all_ways(b"other"))
    total, n = sum(ways.values()), 40_000
    p, o = segmentation.encode_rows(pa.array(["other"] * n), np.arange(n).astype(np.uint64), segmentation.Lattices(voc), 3)
    seen = Counter(tuple(p[a:b].tolist()) for a, b in zip(o, o[1:]))
    assert set(seen) <= set(ways)
    for way, w in ways.items():
        assert abs(seen[way] / n - w / total) < 0.01


def test_segmentation_is_lossless_and_reproducible(spark, docs, rows):
    more = rows + [(900, "日本語 ▁ 梦 \n\n x\u0000y  "), (901, " " * 70), (902, "q" * 5000)]
    df = frame(spark, [(d, t, "n") for d, t in more], DOC + ", n_pieces string")
    got = segmentation.decode(segmentation.encode(df, check=True)).collect()
    assert len(got) == len(more) and all(r.lossless and r.decoded == r.text for r in got)
    assert all((r.pieces is None) == (r.text is None) for r in got)
    again = segmentation.encode(df.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.text, tuple(r.pieces or ()))
    assert Counter(map(key, got)) == Counter(map(key, again))
    assert Counter(map(key, got)) != Counter(map(key, segmentation.encode(df, seed=1).collect()))
    assert segmentation.encode(df.limit(0)).count() == 0


# --- 4 and 6


def labelled(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        bad, junk = rng.random() < 0.3, rng.random() < 0.3
        words = text(60, rng).split()
        for _ in range(4 * bad):
            words[rng.randrange(60)] = rng.choice(["nastyone", "nastytwo", "vileword"])
        rows.append((i, " ".join(w + "%%%" for w in words) if junk else " ".join(words)))
        labels.append((i, int(not junk), int(bad)))
    rows += [(1000, ""), (1001, None), (None, "nastyone nastytwo"), (0, rows[0][1])]
    return frame(spark, [(d, t, "x") for d, t in rows], DOC + ", score string"), spark.createDataFrame(
        labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"
    )


def held(i, m, r):
    return i is not None and zlib.crc32(str(i).encode()) % m == r


@pytest.mark.parametrize("module, label, m, r, least", [(toxicity, "toxic", 4, 2, 0.3), (quality, "quality", 3, 1, 0.5)])
def test_classifiers_on_held_out_rows(spark, module, label, m, r, least):
    df, labels = labelled(spark)
    model = module.fit(df, labels, keep=lambda c: ~queries.held_out(c, m, r))
    got = module.score(df, model).select("doc_id", "score").collect()
    truth = {x.doc_id: x[label] for x in labels.collect()}
    assert len(got) == 504 and all(0 <= x.score <= 1 for x in got)
    test = [
        (x.score >= least) == bool(truth[x.doc_id]) for x in got if held(x.doc_id, m, r) and truth.get(x.doc_id) is not None
    ]
    assert len(test) > 90 and np.mean(test) > 0.93
    assert module.score(df.limit(0), model).count() == 0
    none = module.score(df.limit(5), module.fit(df, labels.limit(0))).collect()
    assert len({x.score for x in none}) == 1


def test_ftrl_against_brute_force():
    """The update rules, one coordinate after the other."""
    rng = random.Random(4)
    rows = [(sorted(rng.sample(range(30), 6)) + [32], int(rng.random() < 0.4)) for _ in range(200)]
    model = toxicity.Ftrl(5, alpha=0.2, beta=0.5, l1=0.3, l2=0.1)
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= 0.3:
            return 0.0
        return -(z[i] - (0.3 if z[i] > 0 else -0.3)) / ((0.5 + n[i] ** 0.5) / 0.2 + 0.1)

    for at, y in rows:
        model.learn(np.array(at), y)
        w = {i: weight(i) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in at:
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.2
            z[i] += g - sigma * w[i]
            n[i] += g * g
    at, values = model.sparse()
    want = {i: weight(i) for i in range(33) if weight(i)}
    assert set(at.tolist()) == set(want) and 5 < len(want) < 33
    assert np.allclose([want[i] for i in at.tolist()], values, rtol=1e-5)


def test_toxicity_features_and_scores(spark, docs, rows):
    texts = [t for _, t in rows]
    row, key = toxicity.features(pa.array(texts), 50)
    got = Counter(r for r, _ in set(zip(row.tolist(), key.tolist())))
    for i, t in enumerate(texts):
        low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
        w = (t or "").encode().translate(low).split()
        stems = {(k, x[:k].ljust(k, b"\0")) for x in w for k in toxicity.STEMS}
        assert got[i] == len({*w}) + len(stems) + len(set(zip(w, w[1:]))) + len(set(zip(w, w[2:])))
    rng = np.random.default_rng(1)
    at = rng.choice(1 << 10, 300, replace=False).astype(np.int32)
    weights = (np.append(at, 1 << 10).astype(np.int32), rng.standard_normal(301).astype(np.float32))
    table = dict(zip(weights[0].tolist(), weights[1].tolist()))
    row, key = toxicity.features(pa.array(texts), 10)
    total = Counter()
    for r, k in set(zip(row.tolist(), key.tolist())):
        total[r] += table.get(k, 0.0)
    want = sorted(1 / (1 + np.exp(-np.clip(total[i] + table[1 << 10], -35, 35))) for i in range(len(texts)))
    assert np.allclose(sorted(r.score for r in toxicity.score(docs, weights, bits=10).collect()), want, rtol=1e-4)


def test_votes_against_brute_force():
    rng = np.random.default_rng(9)
    x = rng.integers(-2, 3, (150, 5)).astype(np.float32)  # few values: many ties
    x[:3] = 0
    vectors, labels = quality.Model.scaled(x), rng.integers(0, 2, 150).astype(np.float64)
    model = quality.Model(np.ones(5, np.float32), np.eye(5, dtype=np.float32), vectors, labels)
    table = rng.integers(0, 4, (60, 5))
    table[0] = 0
    mine = model.embed(table)
    near = mine @ vectors.T
    for row, got in zip(near, model.vote(table)):
        best = sorted(range(150), key=lambda j: (-row[j], j))[: quality.NEAREST]
        weight = [max(0.0, min(1.0, float(row[j]))) ** quality.POWER for j in best]
        want = sum(w * labels[j] for w, j in zip(weight, best)) / sum(weight) if sum(weight) > 1e-12 else labels.mean()
        assert abs(got - want) < 1e-9
    assert quality.nearest(np.array([[1.0, 2, 2, 2, 0]]), 2).tolist() == [[1, 2]]


def test_idf_counts_all_documents(spark):
    rows = [(i, "good plain words") for i in range(10)] + [
        (i, "rare" + " 7 7" * (i % 2)) for i in range(10, 90)
    ] + [(90, None), (None, "rare"), (91, "")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame(spark, rows).repartition(3), labels)
    n = Counter(b for _, t in rows if t is not None for b in {int(k) for k in quality.counted(pa.array([t]))})
    want = np.log(93 / (1 + np.array([n[b] for b in range(quality.WIDTH)]))) + 1
    want[[quality.REPEATED, quality.LETTERLESS]] *= quality.GAIN
    assert n[quality.REPEATED] == 40 and np.allclose(model.idf, want, rtol=1e-5)


# --- 5


def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    x = np.concatenate(
        [
            base, base[:10] + 0.05 * rng.standard_normal((10, 16)), base[:10] + 0.02 * rng.standard_normal((10, 16)),
            np.tile(base[0], (5, 1)), base[1:2] * 3
        ]
    )
    rows = [(int(i), [float(v) for v in r], int(i % 40 % 3)) for i, r in enumerate(x)]
    rows += [
        (900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1),
        (904, rows[0][1], None), (None, rows[0][1], 0), (905, [1.0, 2.0], 0), (906, [], 0), (0, rows[0][1], 0)
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.link(df).collect()
    assert len(got) == len(rows)
    good = [(i, np.array(np.float32(v), np.float64), b) for i, v, b in rows if i is not None and i < 900]
    links = {}
    for (i, a, la), (j, b, lb) in itertools.permutations(good, 2):
        if la == lb and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
            links.setdefault(i, []).append(j)
    by = {r.vec_id: r for r in got}
    for i in range(1, len(x)):
        assert by[i].n_links == len(links.get(i, [])), i
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert by[i].component_id == min(seen) and by[i].kept == (i == min(seen))
    assert all(by[i].n_links == 0 and by[i].component_id == i for i in (900, 901, 902, 903, 904, 905, 906))
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark, monkeypatch):
    """Pairs planted at a cosine just above 0.98 among unrelated vectors, with more signs than so few need."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((1500, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((1500, 24))
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.9801 * base + np.sqrt(1 - 0.9801**2) * other
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))] + [(9000, None, 1)]
    df = spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, label int"
    ).withColumn("n", F.lit("clash")).withColumn("cls", F.lit(0))
    x = np.concatenate([base, near])
    want = int((np.triu(x @ x.T, 1) >= 0.98).sum())
    for fill in (32, 0.05):
        monkeypatch.setattr(embedding_dedup, "FILL", fill)
        found = sum(r.n_links for r in embedding_dedup.link(df).collect()) // 2
        assert want >= 1500 and 0.995 * want <= found <= want


# --- 7


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 50, 97, 1000, 4099])
def test_feistel_is_a_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n))


def test_shards(spark, docs, rows, monkeypatch):
    got = sharding.shard(docs, 8).collect()
    size = Counter(r["shard"] for r in got)
    assert max(size.values()) - min(size.values()) <= 1 and len(got) == len(rows)
    for s in size:
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(size[s]))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    key = lambda r: (r.doc_id, r.size, r.text_crc32, r["shard"], r.slot)
    again = sharding.shard(docs.withColumn("shard", F.lit("x")).repartition(7), 8).collect()
    assert Counter(map(key, again)) == Counter(map(key, got))
    assert sharding.shard(docs.limit(0)).count() == 0
    monkeypatch.setattr(sharding, "BUCKET", 7)  # many buckets and runs, and a frequent row in parts
    monkeypatch.setattr(sharding, "RUN", 3)
    same = sharding.shard(frame(spark, [(7, "a")] * 300 + [(None, None)] * 9 + [(i, "b") for i in range(200)])).collect()
    assert sorted(r.row_number for r in same) == list(range(509))
    assert max(Counter(r["shard"] for r in same).values()) == 64


# --- 8 and 9


def test_cover_shares_an_aligned_place():
    for v, d in ((suffix_dedup.PERIOD, suffix_dedup.COVER), (substring_dedup.PERIOD, substring_dedup.COVER)):
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def brute_repeats(rows, units, width, across):
    first, own = {}, {}
    for d, t in rows:
        u = units(t)
        for i in range(len(u) - width + 1):
            w = tuple(u[i : i + width])
            first[w] = min(first.get(w, repeats_no_id), order(d))
    out = []
    for d, t in rows:
        u = units(t)
        mask, seen = [False] * len(u), set()
        for i in range(len(u) - width + 1):
            w = tuple(u[i : i + width])
            if first[w] < order(d) or (not across and w in seen):
                mask[i : i + width] = [True] * width
            seen.add(w)
        out.append((d, u, mask))
    return out


def test_suffix_dedup(spark, docs, rows):
    got = suffix_dedup.dedup(docs.withColumn("kept", F.lit(1)), buckets=3).collect()
    want = []
    for d, u, mask in brute_repeats(rows, lambda t: (t or "").encode(), 50, True):
        kept = bytes(b for b, m in zip(u, mask) if not m)
        want.append((d, len(u), sum(mask), sum(k for k, _ in itertools.groupby(mask)), hashlib.sha256(kept).hexdigest()))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(want)
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_substring_dedup(spark, docs, rows):
    got = substring_dedup.dedup(docs).collect()
    want = []
    for d, u, mask in brute_repeats(rows, lambda t: (t or "").encode().split(), 20, False):
        kept = b" ".join(w for w, m in zip(u, mask) if not m)
        want.append((d, len(u), sum(mask), hashlib.sha256(kept).hexdigest()))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(want)
    assert substring_dedup.dedup(docs.limit(0)).count() == 0
    stripped = substring_dedup.strip(docs.withColumn("kept", F.lit("own")))
    assert stripped.columns == ["doc_id", "text", "kept"] and {r.kept for r in stripped.collect()} == {"own"}


# --- 10


def brute_sets(rows):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    out = []
    for d, t in rows:
        w = (t or "").encode().translate(low).split()
        out.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    return out


def brute_groups(rows):
    sets = brute_sets(rows)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations([(d, s) for d, s in sets if d is not None and s], 2):
        if a != b and 100 * len(s & t) >= 80 * len(s | t):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return sets, find


def test_ngram_join(spark, docs, rows):
    rows = [r for r in rows if r != (3, "another text with the same id")]
    got = ngram_join.join(frame(spark, rows)).collect()
    sets, find = brute_groups(rows)
    want = Counter((d, len(s), find(d) if d is not None else None) for d, s in sets)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert ngram_join.join(docs.limit(0)).count() == 0


def test_ngram_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(8)
    base = text(100, rng)
    rows = [
        (i, edited(base, rng.choice([0.005, 0.02, 0.03, 0.04]), rng)) for i in range(160)
    ] + [(1000 + i, text(80, rng)) for i in range(40)]
    sets, find = brute_groups(rows)
    want = {d: find(d) for d, _ in sets}
    assert len(set(want.values())) > 45
    # the second: regions are split by new pivots and cut into blocks; the third: split whatever the
    # windows hold; the fourth: common shingles travel apart
    for large, block, growth, least in ((512, 128, 2, 256), (8, 4, 2, 256), (8, 4, 99, 256), (512, 128, 2, 20)):
        monkeypatch.setattr(ngram_join, "LARGE", large)
        monkeypatch.setattr(ngram_join, "BLOCK_LEAST", block)
        monkeypatch.setattr(ngram_join, "DEAL", block)
        monkeypatch.setattr(ngram_join, "GROWTH", growth)
        monkeypatch.setattr(ngram_join, "COMMON_LEAST", least)
        got = {r.doc_id: r.component_id for r in ngram_join.join(frame(spark, rows)).collect()}
        assert got == want


# --- the pipeline and the queries


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, "/root/testdata/sf0.001").collect(), docs.schema)
        assert left.columns == docs.columns
        kept.append(left.count())
    assert sorted(kept, reverse=True) == kept and kept[-1] > 0.5 * docs.count()
    last = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len(last) == kept[-1] and all(r.lossless for r in last)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.SQL) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    from test_entry import SF, TABLES, compare
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    compare(spark, c, queries.QUERIES[name], queries.SQL[name])

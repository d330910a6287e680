"""N-gram Jaccard join: an exact metric-space join of documents' shingle sets.

A document's set holds the hashes of its distinct runs of SHINGLE words (A-Z lower-cased); two
documents link when 100 * intersection >= 80 * union, that is, at Jaccard distance 0.2 or less.
Equal sets are one class, and classes are joined.

1. Shared shingles.  Every shingle is sent to the task of its hash and gets its document
   frequency over all classes; only those of two classes or more come back to their class.  A
   class in which more than a fifth has no company can't link and leaves.  Shingles of a large
   part of all documents are told apart beforehand, by counts that are combined chunk by chunk,
   and travel dealt by shingle and class, so that none of them meets in one task.
2. Pivots.  Unrelated documents are all at distance 1, so a pivot says nothing about those that
   share no shingle with it, and pivots are taken where documents meet: two linked classes have a
   shingle in common among each one's first floor(n/5)+1, rare ones first.  The pivot of such a
   shingle is the class of least hash among those that have it so early.  A region holds the
   classes that have a pivot in common; a class is replicated to the regions of all its pivots,
   so linked classes share a region.  Every member's distance to the pivot is computed; 0.2 or
   less is a link.
3. Recursion.  A region whose members are one component is closed.  In an open region of more
   than LARGE members, SPLIT new pivots create Voronoi regions: a member goes to its nearest
   pivot's region and, by the triangle inequality, to every other one whose pivot is at most
   2 * 0.2 farther, so linked members still share a region.  These regions are treated alike, until
   they are small or don't shrink.  Where all members are about equally far from each other the
   windows hold everything; a region that would grow more than GROWTH-fold by them isn't split.
4. Exact join of a region that isn't split, block by block: all intersections by products of
   incidence matrices, looked at where the components differ and the distances to the pivot
   differ by 0.2 at most.  What comes out is a spanning forest of the links, not the pairs.

All steps deal rows by (region, salt), so a large region is spread over many tasks.

Links become components by shared.components.  Links inside a component are not enumerated, so
neither they nor their number are returned; the components are exact.  Sets are compared by 48
bits of 64-bit hashes: two sets of a thousand agree by chance in one with probability 4e-9.

Defined cases: null or empty text has an empty set and links with nothing; fewer words than
SHINGLE give one shingle, the whole sequence; repeated rows and rows with equal ids count as one
node each by their set; rows with null doc_id link with nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel, shared

SHINGLE = 5
#: Link at this Jaccard distance or less.
RADIUS = 0.2
#: Regions of more members are split.
LARGE = 512
#: Pivots that split a region.
SPLIT = 8
#: A region that keeps more than this share of its parent doesn't shrink; one whose parts together are
#: more than GROWTH times its size isn't split.
SHRINK, GROWTH = 0.8, 2
#: Members compared with pivots, and least and most members of a block, in one task.
DEAL, BLOCK_LEAST, BLOCK_MOST = 128, 128, 4096
#: A shingle of this share of all documents (and of COMMON_LEAST of them) is common; at most COMMON_MOST
#: are listed, the others are treated like rare ones.
COMMON, COMMON_LEAST, COMMON_MOST = 1 / 256, 256, 1 << 16
#: Shingles that a task counts at once.
ENTRIES = 2_000_000
CHUNK = 1 << 20
LOW = kernel.U((1 << 48) - 1)
LAST = 255


def sets(array, width=SHINGLE):
    """Distinct shingle hashes of every row, ascending, and the rows' offsets."""
    words = kernel.Words(array, lower=True)
    h, rows = words.hash, words.rows
    count = np.diff(rows)
    first = np.flatnonzero(kernel.window_rows(rows, width))
    out = kernel.windows(h, width)[first]
    row = np.searchsorted(rows, first, "right") - 1
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        sums = kernel.prefix(h, kernel.BASE_WORDS)
        out = np.concatenate([out, kernel.ranges(sums, rows[short], rows[short] + count[short], kernel.BASE_WORDS)])
        row = np.concatenate([row, short])
    order = np.argsort(out, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint16) if len(array) < 1 << 16 else row[order], kind="stable")]
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(array) + 1))


def fingerprints(values, offsets):
    """A 64-bit hash of every row's set; the set's size is part of it."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros(len(offsets) - 1, kernel.U)
    if len(full):
        out[full] = np.add.reduceat(kernel.mix(values ^ kernel.U(kernel.MUL_A)), offsets[full])
    return kernel.mix(out + np.diff(offsets).astype(kernel.U) * kernel.U(kernel.MUL_A)).view(np.int64)


# --- shared shingles -------------------------------------------------------------------


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, content, node, n, common): every row's class of equal sets and its size, null where
    it is empty; content is a hash of the text.  The first row of a chunk also has the shingles
    of many of the chunk's rows, and how many."""

    def run(batches):
        for batch in kernel.chunks(batches, "text", CHUNK):
            values, offsets = sets(batch.column("text"))
            n = np.diff(offsets)
            key, count = np.unique(values & LOW, return_counts=True)
            often = count >= max(8, len(n) / 32)
            common = [None] * len(n)
            if often.any():
                common[0] = np.concatenate([key[often].view(np.int64), count[often]]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("content"), pa.array(fingerprints(values, offsets), mask=n == 0),
                    pa.array(n), pa.array(common, pa.binary())
                ],
                ["doc_id", "content", "node", "n", "common"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("content"), "text")
    return rows.mapInArrow(run, "doc_id long, content long, node long, n long, common binary")


def common_shingles(own: DataFrame) -> np.ndarray:
    """The most frequent shingles, COMMON_MOST at most; any choice gives right results."""

    def run(batches):
        for batch in batches:
            for packed in batch.column("common").drop_null():
                key, count = np.frombuffer(packed.as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["key", "count"])

    total = own.count()
    counted = own.where("common is not null").select("common").mapInArrow(run, "key long, count long").groupBy("key").agg(
        F.sum("count").alias("count")
    )
    often = counted.where(
        F.col("count") >= max(COMMON_LEAST, total * COMMON)
    ).orderBy(F.desc("count"), "key").limit(COMMON_MOST)
    return np.sort(np.array([r.key for r in often.select("key").collect()], np.int64)).view(kernel.U)


def low_high(key):
    return [(key & kernel.U(0xFFFFFFFF)).astype(np.uint32), (key >> kernel.U(32)).astype(np.uint16)]


def key_of(low, high):
    return (high.astype(kernel.U) << kernel.U(32)) | low


def is_in(x, ordered):
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def shared_sets(texts: DataFrame, common: np.ndarray, n_parts: int) -> DataFrame:
    """(node, n, lead, keys): of each class that can link, the shingles that another class has, too,
    rare ones first; lead of them are among the class's first n // 5 + 1."""
    spark = texts.sparkSession
    keys = shared.part_keys(n_parts)
    listed = spark.sparkContext.broadcast(common)
    kinds = (np.int64, np.uint32, np.uint32, np.uint32, np.uint16)

    def by_class(part, row, node, size, key, extra=()):
        """Blocks of the parts: the classes of runs of entries, and the entries."""
        out = {}
        for p, (r, k, *more) in shared.pack(part, [row, key, *extra], n_parts):
            start, count = shared.runs(r)
            out[p] = [node[r[start]], size[r[start]].astype(np.uint32), count.astype(np.uint32), *low_high(k), *more]
        return out

    def sent(batches):
        often = listed.value
        for batch in kernel.chunks(batches, "text", CHUNK):
            values, offsets = sets(batch.column("text"))
            size, node = np.diff(offsets), fingerprints(values, offsets)
            once = np.zeros(len(size), bool)
            once[np.unique(node, return_index=True)[1]] = True
            row = np.repeat(np.arange(len(size)), size)
            mine = once[row]
            values, row = values[mine], row[mine].astype(np.int32)
            key = values & LOW
            hot = is_in(key, often)
            rare = by_class(shared.part_of(values[~hot], n_parts), row[~hot], node, size, key[~hot])
            mixed = kernel.mix(key[hot] ^ node[row[hot]].view(kernel.U))
            frequent = by_class(shared.part_of(mixed, n_parts), row[hot], node, size, key[hot])
            none = [np.zeros(0, k) for k in kinds]
            parts = sorted(rare.keys() | frequent.keys())
            yield shared.packed_batch(
                [keys[p] for p in parts], [shared.block([*rare.get(p, none), *frequent.get(p, none)]) for p in parts]
            )

    def merged(got):
        node, size, count = (np.concatenate([g[i] for g in got]) for i in range(3))
        return node, size, np.repeat(np.arange(len(node)), count), key_of(
            np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got])
        )

    def distinct(key, run, node):
        order = np.lexsort((node[run], key))
        key, run = key[order], run[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[run[1:]] != node[run[:-1]])
        return key[new], run[new]

    def counted(batches):
        for _, blocks in shared.by_part(batches):
            got = [shared.unblock(b, kinds * 2) for b in blocks]
            node, size, run, key = merged([g[:5] for g in got])
            order = np.argsort(key)
            ordered = key[order]
            company = np.zeros(len(key), bool)
            same = ordered[1:] == ordered[:-1]
            company[1:] |= same
            company[:-1] |= same
            order = order[company]
            key, run = distinct(key[order], run[order], node)
            _, count = shared.runs(key)
            df = np.repeat(count, count)
            key, run, df = key[df > 1], run[df > 1], df[df > 1]
            level = np.minimum(2 * np.log2(df), LAST - 1).astype(np.uint8)
            node2, size2, run2, key2 = merged([g[5:] for g in got])
            key2, run2 = distinct(key2, run2, node2)
            run = np.concatenate([run, run2 + len(node)])
            node, size = np.concatenate([node, node2]), np.concatenate([size, size2])
            key, level = np.concatenate([key, key2]), np.concatenate([level, np.full(len(key2), LAST, np.uint8)])
            order = np.argsort(node[run], kind="stable")
            run, key, level = run[order], key[order], level[order]
            # runs of one class are one run, whatever blocks they came in
            first = np.searchsorted(np.sort(node), node[run])
            at = np.argsort(node, kind="stable")
            out = by_class(
                shared.part_of(kernel.mix(node[run].view(kernel.U)), n_parts), first, node[at], size[at], key, [level]
            )
            if out:
                yield shared.packed_batch([keys[p] for p in out], [shared.block(x) for x in out.values()])

    def gathered(batches):
        for _, blocks in shared.by_part(batches):
            got = [shared.unblock(b, (*kinds, np.uint8)) for b in blocks]
            node, size, run, key = merged([g[:5] for g in got])
            level = np.concatenate([g[5] for g in got])
            ids, which = np.unique(node, return_inverse=True)
            n = np.zeros(len(ids), np.int64)
            n[which] = size
            row = which[run]
            have = np.bincount(row, minlength=len(ids))
            can = have * 100 >= n * 80
            keep = can[row]
            row, key, level = row[keep], key[keep], level[keep]
            order = np.lexsort((kernel.mix(key), level, row))
            row, key = row[order], key[order]
            start, count = shared.runs(row)
            for i in range(0, len(start), 500):
                own = [(int(a), int(c)) for a, c in zip(start[i : i + 500], count[i : i + 500])]
                r = row[start[i : i + 500]]
                lead = n[r] // 5 + 1 - (n[r] - have[r])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[r]), pa.array(n[r]), pa.array(lead),
                        kernel.binary([shared.block(low_high(key[a : a + c])) for a, c in own])
                    ],
                    ["node", "n", "lead", "keys"],
                )

    found = shared.dealt(texts.select("text").mapInArrow(sent, shared.PACKED), n_parts).mapInArrow(counted, shared.PACKED)
    return shared.dealt(found, n_parts).mapInArrow(gathered, "node long, n long, lead long, keys binary")


def unpacked(keys):
    """Key sets of a column, in the order of their hashes."""
    return [np.sort(key_of(*shared.unblock(k.as_py(), (np.uint32, np.uint16)))) for k in keys]


# --- regions ---------------------------------------------------------------------------


def first_regions(sets_: DataFrame) -> DataFrame:
    """(region, node): the members of each pivot's region, without the pivot; region is the pivot."""

    def run(batches):
        for batch in batches:
            lead, got = batch.column("lead").to_numpy(), []
            for k, packed in zip(lead.tolist(), batch.column("keys")):
                low, high = shared.unblock(packed.as_py(), (np.uint32, np.uint16))
                got.append(key_of(low[:k], high[:k]).view(np.int64))
            if got:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(got)), pa.array(np.repeat(batch.column("node").to_numpy(), lead))],
                    ["shingle", "node"]
                )

    early = sets_.select("node", "lead", "keys").mapInArrow(run, "shingle long, node long")
    pivots = early.groupBy("shingle").agg(
        F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("p"), F.count("*").alias("c")
    ).where("c > 1")
    met = early.join(pivots.select("shingle", F.col("p.node").alias("region")), "shingle")
    return met.where("node <> region").select("region", "node").distinct()


def sized(members_: DataFrame) -> DataFrame:
    return members_.join(members_.groupBy("region").agg(F.count("*").alias("m")), "region")


def groups(batches, key):
    """(key, table) of runs of rows with equal key columns, over batches."""
    held, now = [], None
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in key]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(np.append(True, new[1:])) if batch.num_rows else []
        for a, b in zip(at, [*at[1:], batch.num_rows]):
            k = tuple(int(c[a]) for c in cols)
            if held and k != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = k
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def distances(members_: DataFrame, pivots: DataFrame, sets_: DataFrame, parts: int) -> DataFrame:
    """(region, node, pivot, n, pn, common) of each member and each pivot of its region.

    members_: (region, node, m), pivots: (region, pivot, m); a region's members are dealt over
    m / DEAL tasks, and its few pivots go to each of them.
    """
    salts = F.ceil(F.col("m") / DEAL).cast("int")
    own = members_.select(
        "region", F.pmod(F.xxhash64("node", F.lit(1)), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "node"
    )
    every = pivots.select(
        "region", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("pivot").alias("node")
    )
    rows = own.unionByName(every).join(sets_.select("node", "n", "keys").hint("merge"), "node")
    rows = rows.select(
        "region", "salt", "kind", "node", "n", "keys"
    ).repartition(parts, "region", "salt").sortWithinPartitions("region", "salt", "kind", "node")

    def run(batches):
        pivots_of, now = [], None
        for batch in batches:
            for (region, salt, kind), table in groups([batch], ["region", "salt", "kind"]):
                if (region, salt) != now:
                    pivots_of, now = [], (region, salt)
                node, n, keys = table.column("node").to_pylist(), table.column("n").to_numpy(), unpacked(table.column("keys"))
                if kind == 0:
                    pivots_of += list(zip(node, n.tolist(), keys))
                    continue
                flat, start = np.concatenate(keys), np.cumsum([0, *[len(k) for k in keys[:-1]]])
                for p, pn, k in pivots_of:
                    common = np.add.reduceat(is_in(flat, k).astype(np.int64), start)
                    full = [pa.array(np.full(len(node), x, np.int64)) for x in (region, p, pn)]
                    yield pa.RecordBatch.from_arrays(
                        [full[0], pa.array(node, pa.int64()), full[1], pa.array(n), full[2], pa.array(common)],
                        ["region", "node", "pivot", "n", "pn", "common"]
                    )

    got = rows.mapInArrow(run, "region long, node long, pivot long, n long, pn long, common long")
    total = F.col("n") + F.col("pn") - F.col("common")
    return got.select(
        "region", "node", "pivot", (1 - F.col("common") / total).alias("d"), (F.col("common") * 100 >= total * 80).alias("link")
    )


def forest(link, count):
    """(i, j) of a spanning forest of the links among count members."""
    a, b = link
    label = np.arange(count)
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (old == label).all():
            i = np.flatnonzero(label != np.arange(count))
            return i, label[i]


def common_counts(keys, left, right, width=2048):
    """Intersections of the sets of left and right (numbers into keys), by incidence matrices of
    width shingles at a time."""
    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate(keys)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row, column = row[count[column] > 1], column[count[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [a, a + width])
        part = np.zeros((len(keys), width), np.float32)
        part[row[x:y], column[x:y] - a] = 1
        out += part[left] @ part[right].T
    return out


def region_links(members_: DataFrame, sets_: DataFrame, parts: int) -> DataFrame:
    """(a, b): a spanning forest of the links in each region between different components.

    members_: (region, node, m, comp, d).  A region is cut into blocks of about 4 * sqrt(m) members,
    and each pair of blocks is joined by a task of its own.
    """
    block = F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_MOST), 4 * F.sqrt("m")))
    blocks = F.ceil(F.col("m") / block).cast("int")
    rows = members_.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node", F.lit(2)), blocks).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "d"
    )
    rows = rows.join(sets_.select("node", "n", "keys").hint("merge"), "node")
    rows = rows.select(
        "region", "i", "j", "own", "node", "comp", "d", "n", "keys"
    ).repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j", "own", "node")

    def run(batches):
        for (_, i, j), table in groups(batches, ["region", "i", "j"]):
            node, comp, d, n, own = (table.column(c).to_numpy() for c in ("node", "comp", "d", "n", "own"))
            if len(np.unique(comp)) < 2:
                continue
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            common = common_counts(unpacked(table.column("keys")), left, right)
            ok = 180 * common.astype(np.int64) >= 80 * (n[left][:, None] + n[right][None, :])
            ok &= (comp[left][:, None] != comp[right][None, :]) & (
                np.abs(d[left][:, None] - d[right][None, :]) <= RADIUS + 1e-9
            )
            a, b = np.nonzero(ok)
            a, b = forest((left[a], right[b]), len(node))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def opened(members_: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the regions that hold more than one component: (region, node, d, m, comp)."""
    rows = members_.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    open_ = rows.groupBy("region").agg(
        F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")
    ).where("low < high")
    return rows.join(open_.select("region", "m"), "region")


def voronoi(large: DataFrame, sets_: DataFrame, parts: int, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The regions of SPLIT new pivots in each region: members (region, node, d, parent_m); the
    regions that are better not split (region); and links (a, b) to the pivots."""
    lot = F.xxhash64("node", F.lit(100 + level))
    pivots = large.groupBy("region", F.pmod(lot, F.lit(SPLIT)).alias("k")).agg(
        F.min(F.struct(lot.alias("h"), "node")).alias("p"), F.max("m").alias("m")
    )
    pivots = pivots.select("region", F.col("p.node").alias("pivot"), "m")
    found = shared.cut(distances(large.select("region", "node", "m"), pivots, sets_, parts))
    # a member's nearest distance and its windows, as one row a member
    near = found.groupBy("region", "node").agg(F.collect_list(F.struct("d", "pivot")).alias("all"))  # SPLIT at most
    near = near.withColumn("to", F.filter("all", lambda x: x["d"] <= F.array_min("all")["d"] + 2 * RADIUS + 1e-9))
    sums = near.groupBy("region").agg(F.count("*").alias("parent_m"), F.sum(F.size("to")).alias("copies"))
    split = sums.where(F.col("copies") <= GROWTH * F.col("parent_m")).select("region", "parent_m")
    whole = sums.where(F.col("copies") > GROWTH * F.col("parent_m")).select("region")
    rows = near.join(split, "region").select("region", "node", "parent_m", F.explode("to").alias("x"))
    rows = rows.select(F.xxhash64("region", "x.pivot").alias("region"), "node", "x.d", "parent_m")
    return rows, whole, found.where("link").select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def links(sets_: DataFrame, parts: int) -> DataFrame:
    """(node, component): components of the classes that link."""
    met = shared.cut(sized(first_regions(sets_)))
    pivots = met.groupBy("region").agg(F.max("m").alias("m")).select("region", F.col("region").alias("pivot"), "m")
    found = shared.cut(distances(met, pivots, sets_, parts))
    edges = found.where("link").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    comp = shared.components(edges)
    now = shared.cut(opened(found.select("region", "node", "d"), comp).withColumn("parent_m", F.lit(None).cast("long")))
    level = 0
    while not now.isEmpty():
        stuck = F.coalesce(F.col("m") > SHRINK * F.col("parent_m"), F.lit(False))
        large = now.where((F.col("m") > LARGE) & ~stuck)
        joined, further = now.where((F.col("m") <= LARGE) | stuck), None
        edges = None
        if not large.isEmpty():
            further, whole, edges = voronoi(large, sets_, parts, level)
            joined = joined.unionByName(large.join(whole, "region", "left_semi"))
        forests = region_links(joined, sets_, parts)
        edges = shared.cut(forests if edges is None else forests.unionByName(edges.where("a <> b")))
        if not edges.isEmpty():
            stars = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comp = shared.components(stars.unionByName(edges))
        if further is None:
            break
        sizes = further.select("region", "parent_m").distinct()
        now = shared.cut(opened(further.drop("parent_m"), comp).join(sizes, "region"))
        level += 1
    return comp


def rows_with_components(docs: DataFrame) -> DataFrame:
    """(doc_id, content, node, n, component_id) of every row; content is xxhash64 of its text."""
    spark = docs.sparkSession
    with shared.settled(spark), shared.scratch() as tables:
        own = shared.cut(members(docs))
        texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
        total = own.agg(F.sum("n")).first()[0] or 0
        parts = max(shared.partitions(spark), -(-total // ENTRIES))
        sets_ = shared.written(shared_sets(texts, common_shingles(own), parts), clean=True)
        tables.append(sets_)
        comp = links(sets_, parts)
        # components of classes, named by their smallest document
        full = own.where("node is not null and doc_id is not null").select("doc_id", "content", "node", "n")
        classes = full.groupBy("node").agg(F.min("doc_id").alias("least")).join(comp, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
        of_node = shared.cut(classes.join(least, "component").select("node", "component_id"))
    rest = own.where("node is null or doc_id is null").select(
        "doc_id", "content", F.lit(None).cast("long").alias("node"), "n", F.col("doc_id").alias("component_id")
    )
    return full.join(of_node, "node").select("doc_id", "content", "node", "n", "component_id").unionByName(rest)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs, as of its class of equal sets."""
    return rows_with_components(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")

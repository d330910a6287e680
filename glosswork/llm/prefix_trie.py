"""The prefix trie of conversations, by an external mergesort that knows common prefixes.

A turn becomes a token, 128 bits of the SHA-256 of its role and text, so a conversation is a row of
tokens.  Tasks sort what they read into runs that carry, for each conversation, how many tokens it
shares with the one before it (LCP), and store only the rest.  Each part of the order, between two
separators of a sample, is merged from its pieces of all runs by a loser tree: of two heads that
share different numbers of tokens with the last output, the one that shares more comes first, and
no token is looked at; else they are compared behind what both share.  The merged stream has all
conversations below a node side by side, so the nodes that are open form one path, kept on a stack;
what the next conversation doesn't share is finished and leaves it.

A node on the path of a part's first or last conversation may go on in another part: such nodes
(at most two paths a part) are put together by a small aggregate afterwards.  Equal conversations
are ordered by id, so a group of copies is split between parts like all else.

Long conversations are cut into pieces of BLOCK turns.  Pieces meet only if everything before them
is equal; from the deepest level up, each level is a trie of its own, whose totals go into the nodes
it hangs on.  A piece that meets no other needs no trie and is written out at once, so there are as
many rounds as the longest shared beginning has blocks.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import shared

#: Bytes of a token; turns of a piece; turns that one task merges; bytes that one task sorts at a time.
TOKEN, BLOCK, PART, RUN_BYTES = 16, 256, 1 << 20, 16 << 20
#: Sampled conversations for each separator; a part has at least so many turns.
SAMPLE, LEAST = 16, 1 << 12
#: Turns of a conversation that are numbered in one task: those with equal turn div 2**TURN_BITS.
TURN_BITS = 12
#: Ids whose text is one row on the way to a digest.
IDS = 1 << 12


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, total, token, size): the turns of each conversation in order, from position 0.

    Ordered by turn, null first; of equal turns by token.  A null role or text is empty; rows
    without conv_id are no conversation's and go; repeated rows are turns like others.  size: UTF-8
    bytes of the text.  A long conversation is numbered in runs, so none is in one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TOKEN)
    turn = F.col("turn").cast("long")
    run = F.coalesce(F.shiftright(turn, TURN_BITS), F.lit(-(1 << 62)))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), run.alias("run"), token.alias("token"),
        F.octet_length(text).cast("long").alias("size")
    )
    place = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy(F.asc_nulls_first("turn"), "token"))
    rows = rows.withColumn("place", place)
    runs = rows.groupBy("conv_id", "run").agg(F.count("*").alias("n"))
    line = Window.partitionBy("conv_id")
    before = F.sum("n").over(line.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv_id", "run", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(line).alias("total"))
    rows = rows.join(runs, ["conv_id", "run"])
    return rows.select("conv_id", (F.col("before") + F.col("place") - 1).alias("pos"), "total", "token", "size")


def pieces(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, k, n, tokens, sizes): the turns k*block+1 .. of each conversation, at most block of
    them; a conversation that fills its last piece has an empty one behind it."""
    turn = F.struct("depth", "token", "size")
    own = turns.select("conv_id", F.coalesce(F.floor((F.col("depth") - 1) / block), F.lit(0)).alias("k"), F.when(F.col("depth").isNotNull(), turn).alias("t"))
    full = turns.where(F.col("depth") % block == 0)
    behind = full.select("conv_id", F.floor(F.col("depth") / block).alias("k"), F.lit(None).cast(dict(own.dtypes)["t"]).alias("t"))
    rows = own.unionAll(behind).groupBy("conv_id", "k").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select(
        "conv_id", F.col("k").cast("int").alias("k"), F.size("t").alias("n"),
        F.unhex(F.array_join(F.col("t.token"), "")).alias("tokens"), F.col("t.size").alias("sizes")
    )


def with_groups(rows: DataFrame, block: int) -> DataFrame:
    """pieces with group (16 bytes that stand for all tokens before the piece), next (that of the
    piece behind it), more (whether that has turns) and alone (whether no other piece meets it)."""
    digest = F.sha2(F.concat(F.encode(F.col("k").cast("string"), "UTF-8"), F.lit(b":"), F.col("tokens")), 256)
    half = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("long")
    line = Window.partitionBy("conv_id").orderBy("k")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    long = rows.where((F.col("n") == block) | (F.col("k") > 0)).select("conv_id", "k", "n", half(1).alias("x"), half(16).alias("y"))
    name = F.concat(F.hex(zero(F.bit_xor("x").over(before))), F.lit(":"), F.hex(zero(F.bit_xor("y").over(before))))
    long = long.select("conv_id", "k", "n", F.substring(F.sha2(name, 256), 1, 2 * TOKEN).alias("group"))
    long = long.withColumns({"next": F.lead("group").over(line), "more": zero(F.lead("n").over(line)) > 0})
    members = long.where("k > 0").groupBy("k", F.col("group").alias("g")).agg((F.count("*") == 1).alias("alone"))
    long = long.drop("n").join(members.withColumnRenamed("k", "l"), (F.col("k") == F.col("l")) & (F.col("group") == F.col("g")), "left")
    out = rows.join(long.drop("l", "g"), ["conv_id", "k"], "left")
    return out.withColumns(
        {
            "group": F.when(F.col("k") == 0, F.lit("0" * 2 * TOKEN)).otherwise(F.col("group")),
            "more": F.coalesce("more", F.lit(False)), "alone": F.coalesce("alone", F.lit(False))
        }
    )


# --- sorted runs -------------------------------------------------------------------------


def common(a, b, k=0):
    """How many tokens two keys share, given that they share k."""
    most = min(len(a), len(b))
    at = k * TOKEN
    while at < most and a[at : at + TOKEN] == b[at : at + TOKEN]:
        at += TOKEN
    return at // TOKEN


def separators(sample, parts):
    """Up to parts - 1 (key, id) that cut the order of a sorted sample evenly; a key is as short as
    tells it from the sampled key before it."""
    out = []
    for p in range(1, parts):
        i = p * len(sample) // parts
        if 0 < i < len(sample):
            (a, _), (b, conv) = sample[i - 1], sample[i]
            out.append((b, conv) if a == b else (b[: (common(a, b) + 1) * TOKEN], -(1 << 63)))
    return sorted(set(out))


#: A block of a run: shared tokens, tokens and id of each conversation, then the tokens that are
#: not shared, the bytes of their texts, and totals of what hangs on the last token.
KINDS = (np.int32, np.int32, np.int64, np.uint8, np.int64, np.int64, np.int64, np.int64)


def coded(items, shares):
    """A block of sorted items (key, id, sizes, kids, leaves, saved); the first is stored whole."""
    shares = [0, *shares[1:]]
    rest = b"".join(item[0][k * TOKEN :] for item, k in zip(items, shares))
    sizes = [x for item, k in zip(items, shares) for x in item[2][k:]]
    more = [[item[c] for item in items] for c in (3, 4, 5)]
    arrays = [shares, [len(item[0]) // TOKEN for item in items], [item[1] for item in items], None, sizes, *more]
    return shared.block([np.frombuffer(rest, np.uint8) if a is None else np.array(a, k) for a, k in zip(arrays, KINDS)])


def sorted_runs(cuts, keys):
    """A function for mapInArrow: pieces to blocks of sorted runs, one for each part it meets."""

    def flush(items):
        items.sort(key=lambda item: item[:2])
        shares = [0] + [common(a[0], b[0]) for a, b in zip(items, items[1:])]
        at = 0
        for p in range(len(cuts.value) + 1):
            to = bisect_left(items, cuts.value[p], at, key=lambda x: x[:2]) if p < len(cuts.value) else len(items)
            if to > at:
                yield shared.packed_batch([int(keys[p])], [coded(items[at:to], shares[at:to])])
            at = to

    def run(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", "tokens", "conv_id", "sizes", "kids", "leaves", "saved")]
            for group, tokens, conv, sizes, *more in zip(*columns):
                held.append((bytes.fromhex(group) + tokens, conv, [0, *sizes], *more))
                size += len(tokens) + 200
                if size > RUN_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


# --- merging -----------------------------------------------------------------------------


def stream(data):
    """The items of a block, with the tokens each shares with the one before: (key, id, shared, sizes, more)."""
    shares, lengths, convs, rest, sizes, *more = shared.unblock(data, KINDS)
    rest, sizes = rest.tobytes(), sizes.tolist()
    key, bytes_, at = b"", [], 0
    for k, n, conv, *extra in zip(shares.tolist(), lengths.tolist(), convs.tolist(), *(m.tolist() for m in more)):
        to = at + n - k
        key = key[: k * TOKEN] + rest[at * TOKEN : to * TOKEN]
        bytes_ = bytes_[:k] + sizes[at:to]
        at = to
        yield key, conv, k, bytes_, extra


def merged(blocks):
    """The items of sorted blocks in order, with the tokens each shares with the one before, by a loser tree."""
    n = len(blocks)
    runs = [stream(b) for b in blocks]
    head = [next(r, None) for r in runs]
    share = [0] * n  # with the last output

    def play(a, b):
        """(winner, loser); the loser's share becomes that with the winner."""
        if a < 0 or head[a] is None:
            return b, a
        if b < 0 or head[b] is None:
            return a, b
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        x, y = head[a], head[b]
        k = common(x[0], y[0], share[a])
        at, to = k * TOKEN, (k + 1) * TOKEN
        if (x[0][at:to], x[1]) > (y[0][at:to], y[1]):
            a, b = b, a
        share[b] = k
        return a, b

    loser = [-1] * max(1, n)
    winner = [-1] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    best = winner[1] if n > 1 else 0
    while best >= 0 and head[best] is not None:
        key, conv, _, sizes, extra = head[best]
        yield key, conv, share[best], sizes, extra
        head[best] = next(runs[best], None)
        share[best] = head[best][2] if head[best] else 0
        node = (best + n) // 2
        while node:
            best, loser[node] = play(best, loser[node])
            node //= 2


class Nodes:
    """The nodes of one part's merged stream, as columns; open ones are a path on a stack."""

    def __init__(self):
        self.depth, self.parent, self.conv, self.size = array("i"), array("i"), array("q"), array("q")
        self.n, self.kids, self.leaves, self.saved = array("q"), array("q"), array("q"), array("q")
        self.more = {}  # totals of what hangs on a node at a piece's end
        self.ends = {}  # ids of conversations that end at an open node
        self.digest = {}  # of those of finished ones
        self.cut = set()  # nodes that may go on in another part
        self.keys = {}  # their names
        self.path, self.order = [], array("i")

    def open(self, size):
        v = len(self.n)
        self.parent.append(self.path[-1] if self.path else -1)
        self.depth.append(len(self.path))
        self.conv.append((1 << 63) - 1)
        self.size.append(size)
        for column in (self.n, self.kids, self.leaves, self.saved):
            column.append(0)
        self.path.append(v)
        return v

    def close(self):
        """The deepest open node is finished: its parent gets its totals, unless they wait for other parts."""
        v = self.path.pop()
        up = self.parent[v]
        whole = v not in self.cut
        if whole:
            for column, x in zip((self.kids, self.leaves, self.saved), self.more.pop(v, (0, 0, 0))):
                column[v] += x
            self.leaves[v] += self.kids[v] == 0
            self.saved[v] += (self.n[v] - 1) * self.size[v]
            if v in self.ends:
                self.digest[v] = hashlib.sha256(",".join(map(str, self.ends.pop(v))).encode()).hexdigest()
            self.order.append(v)
        if up >= 0:
            self.n[up] += self.n[v]
            self.conv[up] = min(self.conv[up], self.conv[v])
            if whole:
                self.kids[up] += 1
                self.leaves[up] += self.leaves[v]
                self.saved[up] += self.saved[v]

    def name(self, key):
        """Names the open path's nodes, as they may go on elsewhere."""
        for t, v in enumerate(self.path):
            self.cut.add(v)
            self.keys[v] = hashlib.sha256(key[: (t + 1) * TOKEN]).digest()[:TOKEN]


NODE = "conv_id long, depth int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind 0: a finished node; 1: one whose parent may go on elsewhere; 2: part of a node that may; 3: ids that end at such a node.
FOUND = f"kind int, part int, {NODE}, group string, parent_conv_id long, key binary, parent_key binary, path array<binary>, size long, more_kids long, more_leaves long, more_saved long, seq long, ids string"
NOTHING = hashlib.sha256(b"").hexdigest()


def trie_of(blocks, part, first, last):
    """Rows of FOUND of one part's blocks."""
    nodes, groups, key = Nodes(), {}, b""
    for key, conv, k, sizes, extra in merged(blocks):
        while len(nodes.path) > k:
            nodes.close()
        for size in sizes[k:]:
            v = nodes.open(size)
            if not nodes.depth[v]:
                groups[v] = key[:TOKEN].hex()
        if not first:
            nodes.name(key)  # the first conversation's path may have begun in an earlier part
            first = True
        v = nodes.path[-1]
        nodes.n[v] += 1
        nodes.conv[v] = min(nodes.conv[v], conv)
        if extra[0]:
            nodes.more[v] = tuple(extra)  # the conversation goes on behind this piece
        else:
            nodes.ends.setdefault(v, array("q")).append(conv)
    if not last:
        nodes.name(key)  # the last one's may go on in a later part
    while nodes.path:
        nodes.close()
    conv, parent = nodes.conv, nodes.parent
    for v in nodes.order:
        up = parent[v]
        loose = up in nodes.cut
        yield (
            int(loose), part, conv[v], nodes.depth[v], nodes.n[v], nodes.kids[v], nodes.leaves[v], nodes.saved[v],
            nodes.digest.get(v, NOTHING), groups.get(v), None if up < 0 or loose else conv[up], None,
            nodes.keys[up] if loose else None, None, nodes.size[v], 0, 0, 0, None, None
        )
    for v in sorted(nodes.cut):
        path, at = [], v
        while at >= 0:
            path.append(nodes.keys[at])
            at = parent[at]
        yield (
            2, part, conv[v], nodes.depth[v], nodes.n[v], nodes.kids[v], nodes.leaves[v], nodes.saved[v], None, groups.get(v), None,
            path[0], path[1] if len(path) > 1 else None, path, nodes.size[v], *nodes.more.get(v, (0, 0, 0)), None, None
        )
        ids = nodes.ends.get(v, ())
        for at in range(0, len(ids), IDS):
            yield (3, part, *[None] * 9, path[0], *[None] * 6, at, ",".join(map(str, ids[at : at + IDS])))


def merging(keys, parts):
    """A function for mapInArrow: blocks of runs to rows of FOUND, part by part."""
    number = {int(k): p for p, k in enumerate(keys[:parts])}
    schema = pa.schema(
        [("kind", pa.int32()), ("part", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int32())]
        + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        + [("ends_sha256", pa.string()), ("group", pa.string()), ("parent_conv_id", pa.int64()), ("key", pa.binary())]
        + [("parent_key", pa.binary()), ("path", pa.list_(pa.binary()))]
        + [(c, pa.int64()) for c in ("size", "more_kids", "more_leaves", "more_saved", "seq")] + [("ids", pa.string())]
    )

    def run(batches):
        for key, blocks in shared.by_part(batches):
            p, held = number[key], []
            for row in trie_of(blocks, p, p == 0, p == parts - 1):
                held.append(row)
                if len(held) == 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return run


def digested(batches):
    """For mapInArrow: the SHA-256 of each key's ids, which come in order, piece by piece."""
    last, h = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key != last:
                if h is not None:
                    out.append((last, h.hexdigest()))
                last, h = key, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "ends_sha256"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([h.hexdigest()])], ["key", "ends_sha256"])


def level(rows: DataFrame, held: list, part: int = PART, least: int = LEAST) -> DataFrame:
    """The nodes (NODE, group, parent_conv_id) of the tries of one level's pieces; depth is within the piece."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("items"), F.sum(F.col("n") + 1).alias("turns")).first()
    if not size["items"]:
        return rows.sparkSession.createDataFrame([], f"{NODE}, group string, parent_conv_id long")
    parts = max(-(-size.turns // part), min(shared.partitions(spark), -(-size.turns // least)))
    cuts = []
    if parts > 1:
        every = max(1, size["items"] // (SAMPLE * parts))
        some = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select("group", "tokens", "conv_id")
        cuts = separators(sorted((bytes.fromhex(r.group) + bytes(r.tokens), r.conv_id) for r in some.toLocalIterator()), parts)
    parts = len(cuts) + 1
    keys = shared.part_keys(parts)
    blocks = rows.mapInArrow(sorted_runs(spark.sparkContext.broadcast(cuts), keys), shared.PACKED)
    found = shared.written(shared.dealt(blocks, parts).mapInArrow(merging(keys, parts), FOUND))
    held.append(found)
    done = found.where("kind < 2")
    columns = [c.split()[0] for c in NODE.split(", ")] + ["group", "parent_conv_id"]
    if parts == 1:
        return done.select(columns)
    # nodes that several parts have pieces of
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    more = [F.max(c).alias(c) for c in ("more_kids", "more_leaves", "more_saved")]
    same = [F.first(c).alias(c) for c in ("depth", "group", "parent_key", "path", "size")]
    cut = found.where("kind = 2").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *total, *more, *same)
    kids = cut.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("cut_kids")).where("key is not null")
    cut = cut.join(kids, "key", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("cut_kids", F.lit(0)) + F.col("more_kids")
    )
    cut = cut.withColumns(
        {
            "n_leaves": F.col("n_leaves") + F.col("more_leaves") + (F.col("n_children") == 0).cast("long"),
            "saved_tokens": F.col("saved_tokens") + F.col("more_saved") + (F.col("n_convs") - 1) * F.col("size")
        }
    )
    cut = shared.cut(cut.select("key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "group", "parent_key", "path"))
    above = cut.select(F.explode("path").alias("key"), "n_leaves", "saved_tokens").groupBy("key").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    ids = found.where("kind = 3").select("key", "part", "seq", "ids")
    ids = ids.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(digested, "key binary, ends_sha256 string")
    name = cut.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    whole = cut.drop("n_leaves", "saved_tokens", "path").join(above, "key").join(ids, "key", "left").join(name, "parent_key", "left")
    whole = whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    # a part's nodes below such a node learn its id, part by part, as many nodes can hang on one
    need = found.where("kind = 2").select("part", F.col("key").alias("parent_key")).join(name, "parent_key")
    loose = done.where("kind = 1").drop("parent_conv_id").join(need, ["part", "parent_key"])
    return done.where("kind = 0").select(columns).unionByName(loose.select(columns)).unionByName(whole.select(columns))


def nodes(turns: DataFrame, block: int = BLOCK, part: int = PART, least: int = LEAST) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, depth (from 1, without gaps; null in a row that only says that the conversation
    exists), token, size, as numbered() gives them.  A node is a distinct beginning of depth turns; conv_id its
    smallest member, so (conv_id, depth) names it, and (parent_conv_id, depth - 1) its parent.  n_leaves counts
    the childless nodes of its subtree, itself included; saved_tokens sums (n_convs - 1) * size of the last turn over its
    subtree; ends_sha256 digests the ascending ids, comma-joined, of the conversations that end there.
    Without conversations there are no nodes; all others hang on the root of depth 0.
    """
    with shared.scratch() as held, shared.settled(turns.sparkSession):
        held.append(shared.written(pieces(turns, block)))
        deep = held[0].where((F.col("n") == block) | (F.col("k") > 0))
        several = not deep.isEmpty()
        rows = held[0]
        if several:
            held.append(shared.written(with_groups(rows, block)))
            rows = held[1]
        else:
            rows = rows.withColumns({"group": F.lit("0" * 2 * TOKEN), "more": F.lit(False), "alone": F.lit(False), "next": F.lit("")})
        top = rows.where(~F.col("alone")).agg(F.max("k").alias("k")).first().k if several else 0
        out, totals = [], None
        for k in range(top or 0, -1, -1):
            these = rows.where((F.col("k") == k) & ~F.col("alone"))
            # what hangs on a piece's end: the totals of the next level, or a single conversation's
            kids = [F.when(F.col("more"), F.col(c)).otherwise(0) for c in ("more_kids", "more_leaves", "more_saved")]
            if totals is not None:
                these = these.join(totals, "next", "left")
            else:
                these = these.select("*", *[F.lit(None).cast("long").alias(c) for c in ("more_kids", "more_leaves", "more_saved")])
            these = these.fillna({"more_kids": 1, "more_leaves": 1, "more_saved": 0})
            these = these.select("conv_id", "n", "group", "tokens", "sizes", *[c.alias(n) for c, n in zip(kids, ("kids", "leaves", "saved"))])
            found = level(these, held, part, least)
            if k:
                held.append(shared.written(found))
                found = held[-1]
            out.append(found.where((F.col("depth") > 0) | F.lit(k == 0)).withColumn("depth", (F.col("depth") + k * block).cast("long")))
            totals = found.where("depth = 0").select(
                F.col("group").alias("next"), F.col("n_children").alias("more_kids"), F.col("n_leaves").alias("more_leaves"),
                F.col("saved_tokens").alias("more_saved")
            )
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        if several:
            single = rows.where("alone").select("conv_id", "k", "n", "more", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).where("i <= n and i >= 1 and n > 0")
            last = (F.col("i") == F.col("n")) & ~F.col("more")
            one = F.lit(1).cast("long")
            out.append(
                single.select(
                    "conv_id", (F.col("k").cast("long") * block + F.col("i")).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
                    one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"),
                    F.lit(0).cast("long").alias("saved_tokens"),
                    F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256")
                )
            )
        result = out[0].select(names)
        for more in out[1:]:
            result = result.unionByName(more.select(names))
        return shared.written(result)

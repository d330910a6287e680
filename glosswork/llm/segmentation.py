"""SentencePiece encoding and decoding by sampling from the piece lattice.

Encoding draws one segmentation of each text by forward filtering and backward sampling: forward
sums over the lattice of all pieces give the weight of every prefix, and pieces are then drawn
from the end backwards.  The draws come from a hash of (seed, row key, place), so a text's pieces
depend on its key and the seed alone, not on partitions or retries.  No piece crosses from a
character to a following space or a line end, so the lattice of a text is the product of the
lattices of its chunks (spaces and the word after them, or a line end); each distinct chunk of a
block is filtered once.  Decoding concatenates the pieces' bytes.

The vocabulary is a SentencePiece model file; its path is a parameter, it is read on the driver
and its pieces (a bounded table) are sent to the executors.  Scores that are merge ranks become
weights 1 / (rank + 2.7); scores of unigram models are log probabilities.  A character that is no
piece, the literal U+2581 among them, is spelled in byte pieces, so decoding is always exact.

No normalisation is applied and no space is put before a text, as either would make decoding
lossy; so ids at the start of a text can differ from those of an encoder that adds a space.

Defined cases: null text gives null pieces and decodes to null; empty text gives no pieces; a null
key counts as the hash of the text; repeated rows are segmented alike; an empty table gives no
rows.  Other columns are passed through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import kernel, shared

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 20
#: Edges of the lattices that a task keeps for chunks that come again; about 40 MB.
KEPT_EDGES = 2_500_000
FILTER_BITS = 19


class Vocabulary:
    """Pieces as bytes (space for U+2581), weights, and a hash table of them."""

    def __init__(self, path=MODEL, sharpness=1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        self.pieces, usable, score = [b""] * n, [], []
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.pieces[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = model.id_to_piece(i).replace("▁", " ").encode()
                self.pieces[i] = text
                if b"\n" not in text and b" " not in text.lstrip(b" "):
                    usable.append(i)
                    score.append(model.get_score(i))
        if not self.byte_id.all():
            raise ValueError("the model has no byte pieces, so it can't spell every text")
        score = np.array(score)
        if len(score) and score.min() < -1000:  # merge ranks
            rank = np.empty(len(score))
            rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
            score = -np.log(rank + 2.7)
        log = sharpness * score
        data, start = self.table(usable)
        sums = kernel.prefix(data.astype(kernel.U) + kernel.U(1), kernel.BASE_BYTES)
        h = kernel.ranges(sums, start[:-1], start[1:], kernel.BASE_BYTES)
        order = np.argsort(h)
        self.hash, self.ids = h[order], np.array(usable, np.int32)[order]
        self.weight = log[order]
        self.byte_weight = float(log.min() - 3.0) if len(log) else 0.0
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.hash >> kernel.U(64 - FILTER_BITS)).astype(np.int64)] = True
        self.lengths = sorted(set(np.diff(start).tolist()))
        self.all_bytes, self.all_start = self.table(range(n))

    def table(self, ids):
        got = [self.pieces[i] for i in ids]
        return np.frombuffer(b"".join(got), np.uint8), np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)

    def find(self, h):
        """(positions in h that are pieces, their places in hash order)"""
        some = np.flatnonzero(self.maybe[(h >> kernel.U(64 - FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[some]), len(self.hash) - 1)
        ok = self.hash[at] == h[some]
        return some[ok], at[ok]


def gather(start, length):
    """Indices start[i] .. start[i] + length[i] - 1, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + length, length)


class Lattice:
    """Forward-filtered lattices of distinct chunks; node p + i is byte place p of chunk i."""

    def __init__(self, data, length, voc):
        n, place = len(length), np.cumsum(length) - length
        total = len(data)
        chunk = np.repeat(np.arange(n), length)
        left = np.repeat(place + length, length) - np.arange(total)  # bytes to the chunk's end
        node = np.arange(total) + chunk
        self.first, self.last = place + np.arange(n), place + length + np.arange(n)
        sums = kernel.prefix(data.astype(kernel.U) + kernel.U(1), kernel.BASE_BYTES)
        lead = (data & 0xC0) != 0x80
        span = np.ones(total, np.int64)  # bytes of the character that starts here
        span[data >= 0xC0], span[data >= 0xE0], span[data >= 0xF0] = 2, 3, 4
        spelled = lead.copy()  # characters without a piece
        found = []
        for k in voc.lengths:
            at = np.flatnonzero((left >= k) & lead)
            if len(at):
                hit, which = voc.find(kernel.ranges(sums, at, at + k, kernel.BASE_BYTES))
                at = at[hit]
                found.append((k, at, which))
                spelled[at[span[at] == k]] = False
        bytewise = np.flatnonzero(spelled)
        bytewise = gather(bytewise, span[bytewise]) if len(bytewise) else bytewise
        degree = np.zeros(total + n + 1, np.int64)
        degree[node[bytewise] + 1] += 1
        for k, at, _ in found:
            degree[node[at] + k] += 1
        self.off = np.cumsum(degree) - degree
        edges = int(degree.sum())
        self.source, self.piece, weight = np.zeros(edges, np.int32), np.zeros(edges, np.int32), np.zeros(edges)
        fill = self.off.copy()
        for k, at, which in [(1, bytewise, None), *found]:
            end = node[at] + k
            slot = fill[end]
            fill[end] += 1
            self.source[slot] = end - k
            self.piece[slot] = voc.byte_id[data[at]] if which is None else voc.ids[which]
            weight[slot] = voc.byte_weight if which is None else voc.weight[which]
        log_alpha = np.zeros(total + n + 1)
        self.cum = np.zeros(edges)
        # nodes by their depth in the chunk: a node's sources are all nearer to the start
        ends = node + 1
        depth = np.arange(total) - np.repeat(place, length)
        has = degree[ends] > 0
        ends, depth = ends[has], depth[has]
        order = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        ends, cuts = ends[order], np.cumsum(np.bincount(depth)) if len(depth) else []
        at = 0
        for to in cuts:
            now = ends[at:to]
            at = to
            if not len(now):
                continue
            deg, off, top, sum_ = degree[now], self.off[now], np.full(len(now), -np.inf), np.zeros(len(now))
            picks = [np.flatnonzero(deg > k) for k in range(int(deg.max()))]
            for k, some in enumerate(picks):
                slot = off[some] + k
                weight[slot] += log_alpha[self.source[slot]]
                top[some] = np.maximum(top[some], weight[slot])
            for k, some in enumerate(picks):
                slot = off[some] + k
                sum_[some] += np.exp(weight[slot] - top[some])
                self.cum[slot] = sum_[some]
            log_alpha[now] = top + np.log(sum_)
            for k, some in enumerate(picks):
                self.cum[off[some] + k] /= sum_[some]
        self.degree = degree


class Lattices:
    """Lattices of the distinct chunks met so far; forgets all of them beyond KEPT_EDGES."""

    PARTS = {
        "source": np.int32, "piece": np.int32, "cum": np.float32, "off": np.int32, "degree": np.int32, "first": np.int32,
        "last": np.int32
    }

    def __init__(self, voc):
        self.voc = voc
        self.forget()

    def forget(self):
        self.hash, self.place = np.zeros(0, kernel.U), np.zeros(0, np.int64)
        self.size = dict.fromkeys(self.PARTS, 0)
        for name, kind in self.PARTS.items():
            setattr(self, name, np.zeros(1 << 12, kind))

    def append(self, name, values):
        have, n = getattr(self, name), self.size[name]
        if n + len(values) > len(have):
            more = np.empty(max(2 * len(have), n + len(values)), have.dtype)
            more[:n] = have[:n]
            setattr(self, name, more)
            have = more
        have[n : n + len(values)] = values
        self.size[name] = n + len(values)

    def places(self, h, data, start, length):
        """Numbers of the chunks with these distinct hashes; unknown ones are filtered and kept."""
        if self.size["source"] > KEPT_EDGES:
            self.forget()
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        known = self.hash[at] == h if len(self.hash) else np.zeros(len(h), bool)
        new = np.flatnonzero(~known)
        if len(new):
            own = Lattice(data[gather(start[new], length[new])], length[new], self.voc)
            count, nodes, edges = self.size["first"], self.size["off"], self.size["source"]
            for name, shift in (
                ("source", nodes), ("piece", 0), ("cum", 0), ("off", edges), ("degree", 0), ("first", nodes), ("last", nodes)
            ):
                self.append(name, getattr(own, name) + shift)
            both = np.concatenate([self.hash, h[new]])
            order = np.argsort(both, kind="stable")
            self.hash, self.place = both[order], np.concatenate([self.place, count + np.arange(len(new))])[order]
            at = np.searchsorted(self.hash, h)
        return self.place[at]


def encode_rows(array, keys, lattice, seed):
    """(pieces of all rows, offsets of rows): one draw per row."""
    data, offsets = kernel.text_buffer(array)
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(array) + 1, np.int64)
    space, line = data == 0x20, data == 0x0A
    cut = np.zeros(n, bool)
    cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, n))
    sums = kernel.prefix(data.astype(kernel.U) + kernel.U(1), kernel.BASE_BYTES)
    h = kernel.ranges(sums, start, start + length, kernel.BASE_BYTES)
    distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
    which = lattice.places(distinct, data, start[first], length[first])[which]
    rows = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(array)), np.diff(rows))
    nth = np.arange(len(start)) - rows[row]
    base = kernel.mix(keys[row] + kernel.mix(nth.astype(kernel.U) + kernel.U(seed)))
    node, first = lattice.last[which], lattice.first[which]
    todo, steps = np.arange(len(start)), []
    while len(todo):
        u = (
            kernel.mix(base[todo] + kernel.U(((len(steps) + 1) * kernel.MUL_A) & kernel.MASK)) >> kernel.U(11)
        ).astype(np.float64) * 2.0**-53
        here = node[todo]
        slot, last = lattice.off[here], lattice.off[here] + lattice.degree[here] - 1
        going = np.flatnonzero((lattice.cum[slot] <= u) & (slot < last))
        while len(going):
            slot[going] += 1
            s = slot[going]
            going = going[(lattice.cum[s] <= u[going]) & (s < last[going])]
        steps.append((todo, lattice.piece[slot]))
        node[todo] = lattice.source[slot]
        todo = todo[node[todo] != first[todo]]
    count = np.zeros(len(start), np.int64)
    for todo, _ in steps:
        count[todo] += 1
    ends = np.cumsum(count)
    out = np.empty(int(ends[-1]), np.int32)
    for k, (todo, piece) in enumerate(steps):
        out[ends[todo] - 1 - k] = piece
    return out, np.concatenate([[0], ends])[rows]


def decode_rows(pieces, offsets, voc):
    """(bytes of all rows, offsets of rows)"""
    size = np.diff(voc.all_start)[pieces]
    data = voc.all_bytes[gather(voc.all_start[pieces], size)]
    return data, np.concatenate([[0], np.cumsum(size)])[offsets]


def encode(docs: DataFrame, path=MODEL, seed=0, sharpness=1.0, key="doc_id", check=False) -> DataFrame:
    """docs with pieces (array of ids) and n_pieces; check adds lossless, the outcome of decoding."""
    added = [T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType())]
    added += [T.StructField("lossless", T.BooleanType())] * check
    own = {f.name for f in added}
    kept = [f.name for f in docs.schema.fields if f.name not in own]
    schema = T.StructType([docs.schema[n] for n in kept] + added)
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, sharpness))
    place = shared.own_name(docs, "__key")
    keyed = docs.select(*[F.col(f"`{n}`") for n in kept], F.coalesce(F.xxhash64(F.col(key)), F.xxhash64("text")).alias(place))
    names = [f.name for f in schema.fields]

    def run(batches):
        voc = sent.value
        lattices = Lattices(voc)
        for batch in kernel.chunks(batches, "text", CHUNK):
            text = batch.column("text")
            keys = batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64).view(kernel.U)
            pieces, offsets = encode_rows(text, keys, lattices, seed)
            null = text.is_null()
            mask = null.to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), pa.array(pieces), mask=null if null.true_count else None
            )
            out = [batch.column(n) for n in kept] + [lists, pa.array(np.diff(offsets), mask=mask)]
            if check:
                data, ends = decode_rows(pieces, offsets, voc)
                have, had = kernel.text_buffer(text)
                good = np.array_equal(ends, had)
                if good:
                    wrong = np.concatenate([[0], np.cumsum(data != have)])
                    ok = wrong[ends[1:]] == wrong[ends[:-1]]
                else:
                    ok = np.array([np.array_equal(data[a:b], have[c:d]) for a, b, c, d in zip(ends, ends[1:], had, had[1:])])
                out.append(pa.array(ok))
            yield pa.RecordBatch.from_arrays(out, names)

    return keyed.mapInArrow(run, schema)


def decode(encoded: DataFrame, path=MODEL, column="decoded") -> DataFrame:
    """encoded with the text of its pieces; null pieces give null."""
    kept = [f.name for f in encoded.schema.fields if f.name != column]
    schema = T.StructType([encoded.schema[n] for n in kept] + [T.StructField(column, T.StringType())])
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        voc = sent.value
        for batch in batches:
            lists = batch.column("pieces")
            at = lists.offsets.to_numpy()
            data, ends = decode_rows(lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0], voc)
            raw, null = data.tobytes(), lists.is_null().to_pylist()
            text = [None if z else raw[a:b].decode() for a, b, z in zip(ends, ends[1:], null)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [pa.array(text, pa.string())], kept + [column])

    return encoded.select(*[F.col(f"`{n}`") for n in kept]).mapInArrow(run, schema)

"""N-gram Jaccard join over word shingles by token-combination prefixes, and the components of its links.

A document's tokens are its distinct shingles. Tokens have one global order, rare before frequent (by the power of two of their document
count, then by value). Two sets with Jaccard similarity of t or more share o = ceil(t n) tokens, so in that order they share at least one
of the first n - o + 1; a prefix longer by the number of token classes that it meets guarantees a shared pair of one class instead:

* rare tokens (in fewer than ``frequent`` documents) are index keys of their own;
* frequent tokens fall into classes by hash, and the keys are the pairs of one class; a prefix is extended until its length less the
  classes it meets reaches n - o + 1. The number of classes follows the power of two of n, so that keys stay proportional to the prefix;
  a document whose partner may lie in the power below emits that level's keys as well.

Plan. (1) Blocks of documents emit their tokens, sorted and packed, to parts by token value; parts count documents per token and send back
the tokens that two or more documents share; only these can be prefix keys with a partner or part of an intersection. A token in ``OFTEN``
documents of a block or more keeps its postings there and sends their number only, so a part receives a token fewer than ``OFTEN`` times
from each block, however many documents have it. (2) Blocks pick
prefixes and emit keys; exact copies are one node. (3) Nodes with a common key are verified exactly, on shared tokens and set sizes:
first within blocks of at most ``block`` nodes, and 8 MB of tokens, of one anchor key, by a search that holds each component against what is not in it yet,
then among central nodes of those components, at last each node that is not in its key's main component against the blocks that its
block's outsiders share keys with. No group is ever expanded into all its pairs, and no pair with a common key is left untested unless a chain of links
already joins it. (4) Components: smallest id by alternating large-star and small-star steps.

Tokens are 64-bit hashes of which 48 bits are sent. Equal sets are told by their size and two 64-bit sums over their tokens; in sets of
``STRONG`` tokens or fewer the second is over other hashes of the shingles themselves, so that 128 bits tell short texts apart. Sets too
small to have a similar set other than their equals (two tokens or fewer at 75 %) send no tokens and are never verified.

Nulls: a null text and a text without words have no tokens, no links and are their own component; a row without id is given n_shingles and
no component. Rows that repeat an id are one vertex: their links add up. No rows from an empty table. Of extra columns none is read. Very
long texts: a block holds at least one whole text, 24 bytes a word.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, give_back, n_parts, tidy

SIZE, PERCENT, FREQUENT, BLOCK = 5, 75, 64, 512
BITS = 48
MASK = np.uint64((1 << BITS) - 1)
BLOCK_TOKENS, BLOCK_DOCS = 1_000_000, 60_000
OFTEN, STRONG = 4, 16
BLOCK_BYTES = 8 << 20
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


def shingles(text: str | None, size: int = SIZE, known: WordHashes | None = None) -> np.ndarray:
    """The distinct shingles of a text, hashed, sorted; with fewer words than size the whole sequence is one."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = WordHashes() if known is None else known
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)
    n = len(words) - size + 1
    out = h[:n] * ODD[0]
    for k in range(1, size):
        out = out + h[k : k + n] * ODD[k % 8] + np.uint64(k)
    return np.unique(mixed(out))


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any similar one."""
    return -(-n * percent // 100)


def similar(n: int, m: int, common: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def has_others(n: int, percent: int) -> bool:
    """Whether a set of n can be similar to any other than its equals: at best to itself and one token more."""
    return 100 * n >= percent * (n + 1)


def strong(text: str | None, size: int = SIZE) -> int:
    """A sum over the distinct shingles as they are, hashed otherwise than as tokens."""
    words = (text or "").encode("utf-8").lower().split()
    each = {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}
    return sum(xxhash.xxh3_64_intdigest(x, seed=0x9E3779B9) for x in each) & 0xFFFFFFFFFFFFFFFF


# ---------------------------------------------------------------- (1) tokens to parts, shared tokens back

CELL = "kind int, block long, part int, data binary, more binary, third binary"
CELL_NAMES = ("kind", "block", "part", "data", "more", "third")
CELL_TYPES = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _cells(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CELL_TYPES, strict=True)], CELL_NAMES)


def _block_cells(docs: list[tuple[int | None, np.ndarray, int | None]], parts: int, number: int, percent: int, often: int) -> Iterator[pa.RecordBatch]:
    """The block's table of documents (kind 0); for each part its tokens with their documents' places (kind 1) and the numbers of its frequent ones (kind 4), whose places it keeps (kind 3)."""
    sizes = np.fromiter((len(s) for _, s, _ in docs), np.int64, len(docs))
    flat = np.concatenate([s for _, s, _ in docs]) if docs else np.zeros(0, np.uint64)
    place = np.repeat(np.arange(len(docs), dtype=np.uint32), sizes)
    # sums of two mixings name a set: equal sets, and in practice no others, agree in both and in size
    a, b = (np.add.reduceat(np.append(mixed(flat ^ x), np.uint64(0)), np.cumsum(sizes) - sizes) * (sizes > 0).astype(np.uint64) for x in (np.uint64(0x5BD1E995), np.uint64(0x27D4EB2F)))
    for k, (_, _, other) in enumerate(docs):
        if other is not None:
            b[k] = other
    table = np.zeros(len(docs), np.dtype([("id", "<i8"), ("none", "?"), ("n", "<i8"), ("a", "<u8"), ("b", "<u8")]))
    table["id"] = [i or 0 for i, _, _ in docs]
    table["none"] = [i is None for i, _, _ in docs]
    table["n"], table["a"], table["b"] = sizes, a, b
    rows = [(0, number, number % parts, table.tobytes(), None, None)]
    # of equal sets in a block the first sends its tokens; a document without id and one without others like it send none
    named = np.flatnonzero(~table["none"] & (100 * sizes >= percent * (sizes + 1)))
    first = np.zeros(len(docs), bool)
    first[named[np.unique(np.stack([a, b, sizes.astype(np.uint64)], 1)[named], axis=0, return_index=True)[1]]] = True
    keep = first[place]
    token, place = flat[keep] & MASK, place[keep]
    order = np.argsort(token, kind="stable")
    token, place = token[order], place[order]
    bounds_at = np.array([-(-(k << BITS) // parts) for k in range(1, parts)], np.uint64)
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(token)))
    many = counts >= often
    if many.any():
        held, n = token[starts[many]], counts[many].astype(np.uint32)
        mine = np.repeat(many, counts)
        rows.append((3, number, number % parts, held.tobytes(), place[mine].tobytes(), n.tobytes()))
        token, place = token[~mine], place[~mine]
        edges = [0, *np.searchsorted(held, bounds_at).tolist(), len(held)]
        rows += [(4, number, k, held[lo:hi].tobytes(), n[lo:hi].tobytes(), None) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo]
    bounds = [0, *np.searchsorted(token, bounds_at).tolist(), len(token)]
    small = np.uint16 if len(docs) <= 0xFFFF else np.uint32
    for k in range(parts):
        lo, hi = bounds[k], bounds[k + 1]
        if hi > lo:
            t = token[lo:hi]
            step = np.diff(t, prepend=t[:1])
            wide = np.uint32 if len(step) == 1 or step.max() < 1 << 32 else np.uint64
            rows.append((1, number, k, t[:1].tobytes() + step.astype(wide).tobytes(), place[lo:hi].astype(small).tobytes(), np.array([step.astype(wide).itemsize, small().itemsize], np.uint8).tobytes()))
        if len(rows) >= 256:
            yield _cells(rows)
            rows = []
    if rows:
        yield _cells(rows)


def _to_blocks(size: int, parts: int, percent: int, often: int):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        known = WordHashes()
        docs, held = [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = t.as_py()
                s = shingles(text, size, known)
                docs.append((i, s, strong(text, size) if 0 < len(s) <= STRONG else None))
                held += len(s)
                if held >= BLOCK_TOKENS or len(docs) >= BLOCK_DOCS:
                    yield from _block_cells(docs, parts, number, percent, often)
                    docs, held, number = [], 0, number + 1
        if docs:
            yield from _block_cells(docs, parts, number, percent, often)

    return each


def _unpacked(data: bytes, more: bytes, third: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide, small = third[0], third[1]
    first = np.frombuffer(data[:8], np.uint64)
    step = np.frombuffer(data[8:], np.uint32 if wide == 4 else np.uint64).astype(np.uint64)
    return first + np.cumsum(step), np.frombuffer(more, np.uint16 if small == 2 else np.uint32)


def _share(t: pa.Table) -> pa.Table:
    """A part: what blocks keep passes; of the tokens those in two documents or more go back to their blocks, with their counts' power of two (kind 1 with places, kind 5 without)."""
    rows, tokens, places, weights, senders = [], [], [], [], []
    for r in t.to_pylist():
        if r["kind"] in (0, 3):
            rows.append(tuple(r[c] for c in CELL_NAMES))
            continue
        if r["kind"] == 4:
            token, weight = np.frombuffer(r["data"], np.uint64), np.frombuffer(r["more"], np.uint32)
            place = np.zeros(len(token), np.uint32)
        else:
            token, place = _unpacked(r["data"], r["more"], r["third"])
            weight = np.ones(len(token), np.uint32)
        tokens.append(token)
        places.append(place.astype(np.uint32))
        weights.append(weight)
        senders.append((r["block"], r["kind"]))
    if tokens:
        sender = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
        token, place, weight = np.concatenate(tokens), np.concatenate(places), np.concatenate(weights).astype(np.int64)
        del tokens, places, weights
        order = np.argsort(token, kind="stable")
        token = token[order]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        total = np.add.reduceat(weight[order], starts) if len(starts) else starts
        count = np.repeat(total, np.diff(np.append(starts, len(token))))
        twice = count > 1
        token, count, order = token[twice], count[twice], order[twice]
        place, sender = place[order], sender[order]
        level = np.floor(np.log2(np.maximum(count, 1))).astype(np.uint8)
        by = np.argsort(sender, kind="stable")
        edges = np.searchsorted(sender[by], np.arange(len(senders) + 1))
        for k, (number, kind) in enumerate(senders):
            own = by[edges[k] : edges[k + 1]]
            if len(own):
                rows.append((1 if kind == 1 else 5, number, 0, token[own].tobytes(), place[own].tobytes() if kind == 1 else b"", level[own].tobytes()))
        del token, place, sender, weight, level, count, order, by, starts, total, twice
    if t.nbytes > 1 << 20:
        give_back()
    return pa.Table.from_batches([_cells(rows)]) if rows else pa.Table.from_batches([], pa.schema(list(zip(CELL_NAMES, CELL_TYPES, strict=True))))


# ---------------------------------------------------------------- (2) prefixes and keys


def levels(n: int, percent: int) -> list[int]:
    """The levels whose keys a set of n emits, from its smallest partner's to its own; level 0 (sets under 4) has single tokens only."""
    least, own = (max(0, x.bit_length() - 1) if x >= 4 else 0 for x in (needed(n, percent), n))
    return [x for x in range(least, own + 1) if x != 1]


def prefix_keys(tokens: np.ndarray, level: np.ndarray, n: int, percent: int, frequent: int) -> np.ndarray:
    """Index keys of a set of n tokens, of which the shared ones are given with the powers of two of their counts.

    The other n - len(tokens) are in no other set: they come first in the order and make no keys.
    """
    order = np.lexsort((tokens, level))
    tokens, level = tokens[order], level[order]
    alone = n - len(tokens)
    o = needed(n, percent)
    often = level >= math.log2(frequent)
    keys = []
    for scheme in levels(n, percent):
        if scheme == 0:
            keys.append(tokens[: max(0, n - o + 1 - alone)])
            continue
        classes = 1 << (scheme - 2)
        cls = (mixed(tokens) % np.uint64(classes)).astype(np.int64)
        # a prefix's length less the frequent classes it meets: new ones do not count
        new = np.zeros(len(tokens), bool)
        at = np.flatnonzero(often)
        new[at[np.unique(cls[at], return_index=True)[1]]] = True
        reach = alone + np.cumsum(~new)
        length = int(np.searchsorted(reach, n - o + 1)) + 1 if alone < n - o + 1 else 0
        part, rare = tokens[:length], ~often[:length]
        keys.append(part[rare])
        pool: dict[int, list[int]] = defaultdict(list)
        for t, c in zip(part[~rare].tolist(), cls[:length][~rare].tolist(), strict=True):
            pool[c].append(t)
        pairs = [(x, y) for ts in pool.values() for k, y in enumerate(ts) for x in ts[:k]]
        if pairs:
            p = np.sort(np.array(pairs, np.uint64), axis=1)
            keys.append(mixed(mixed(p[:, 0] + np.uint64(scheme)) * ODD[1] + p[:, 1]) | np.uint64(1 << BITS))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


NODE = "id long, n long, alone long, tokens binary, counts binary, keys array<long>"


def _emit(percent: int, frequent: int):
    def each(t: pa.Table) -> pa.Table:
        token, place, level, wanted, kept, told = [], [], [], {}, [], []
        for r in t.to_pylist():
            if r["kind"] == 2:
                wanted[r["place"]] = (r["id"], r["n"])
            elif r["kind"] == 3:
                kept.append((np.frombuffer(r["data"], np.uint64), np.frombuffer(r["more"], np.uint32), np.frombuffer(r["third"], np.uint32)))
            elif r["kind"] == 5:
                told.append((np.frombuffer(r["data"], np.uint64), np.frombuffer(r["third"], np.uint8)))
            else:
                token.append(np.frombuffer(r["data"], np.uint64))
                place.append(np.frombuffer(r["more"], np.uint32))
                level.append(np.frombuffer(r["third"], np.uint8))
        if kept and wanted:
            # all parts have told their tokens' levels; together they are the block's own list
            names, levels_of = (np.concatenate(x) for x in zip(*told, strict=True))
            order = np.argsort(names)
            names, levels_of = names[order], levels_of[order]
            for held, places, n in kept:
                token.append(np.repeat(held, n))
                place.append(places)
                level.append(np.repeat(levels_of[np.searchsorted(names, held)], n))
        out = []
        if token and wanted:
            tokens, places, lv = np.concatenate(token), np.concatenate(place), np.concatenate(level)
            order = np.argsort(places, kind="stable")
            tokens, places, lv = tokens[order], places[order], lv[order]
            edges = np.flatnonzero(np.diff(places, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (node := wanted.get(int(places[a]))) is None:
                    continue
                i, n = node
                if b - a < needed(n, percent):  # too few shared tokens for any partner
                    continue
                keys = prefix_keys(tokens[a:b], lv[a:b], n, percent, frequent)
                if len(keys):
                    own = np.argsort(tokens[a:b])
                    out.append((i, n, n - (b - a), tokens[a:b][own].tobytes(), lv[a:b][own].tobytes(), keys.view(np.int64).tolist()))
            del tokens, places, lv, order
        token, place, level, kept, told = [], [], [], [], []
        if t.nbytes > 1 << 20:
            give_back()
        cols = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["id", "n", "alone", "tokens", "counts", "keys"])

    return each


# ---------------------------------------------------------------- (3) verification


class Sets:
    """Token sets of the nodes of one block, and links among them."""

    def __init__(self, nodes: list[tuple[int, int, bytes]], percent: int):
        self.percent = percent
        self.ids = np.array([i for i, _, _ in nodes], np.int64)
        self.n = np.array([n for _, n, _ in nodes], np.int64)
        self.sets = [np.frombuffer(t, np.uint64) for _, _, t in nodes]
        flat = np.concatenate(self.sets) if nodes else np.zeros(0, np.uint64)
        self.values, inverse = np.unique(flat, return_inverse=True)
        self.owner = np.repeat(np.arange(len(nodes)), [len(s) for s in self.sets])
        self.code = inverse.astype(np.int64)

    def index(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the marked nodes: by token, the nodes that have it."""
        keep = members[self.owner]
        code, owner = self.code[keep], self.owner[keep]
        order = np.argsort(code, kind="stable")
        return np.searchsorted(code[order], np.arange(len(self.values) + 1)), owner[order]

    def linked(self, tokens: np.ndarray, n: int, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Nodes of the index that are similar to the set of n tokens of which these are shared."""
        starts, owner = index
        at = np.searchsorted(self.values, tokens)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == tokens)] if len(self.values) else at[:0]
        lo, size = starts[at], starts[at + 1] - starts[at]
        total = int(size.sum())
        if not total:
            return np.zeros(0, np.int64)
        pick = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(total)
        common = np.bincount(owner[pick], minlength=len(self.ids))
        return np.flatnonzero((common > 0) & (100 * common >= self.percent * (n + self.n - common)))

    def components(self) -> np.ndarray:
        """Component of each node. Each search step holds a reached node against the nodes not reached yet."""
        label = np.full(len(self.ids), -1, np.int64)
        rest = np.ones(len(self.ids), bool)
        index, indexed = self.index(rest), len(self.ids)
        for seed in np.argsort(-self.centrality(), kind="stable").tolist():
            if not rest[seed]:
                continue
            rest[seed] = False
            label[seed] = seed
            queue = [seed]
            while queue:
                x = queue.pop()
                left = int(rest.sum())
                if not left:
                    break
                if left * 2 < indexed:
                    index, indexed = self.index(rest), left
                found = self.linked(self.sets[x], int(self.n[x]), index)
                found = found[rest[found]]
                rest[found] = False
                label[found] = seed
                queue += found.tolist()
        return label

    def centrality(self) -> np.ndarray:
        """How common a node's tokens are in the block, for its size."""
        if not len(self.ids):
            return np.zeros(0)
        weight = np.bincount(self.code, minlength=len(self.values))[self.code].astype(np.float64)
        return np.bincount(self.owner, weights=weight, minlength=len(self.ids)) / np.maximum(self.n, 1)


LINK = "a long, b long, central boolean"


def _links_within(percent: int):
    """Of a block: a link from each component's most central node (marked, linked to itself) to its others."""

    def each(t: pa.Table) -> pa.Table:
        s = Sets(list(zip(*(t.column(c).to_pylist() for c in ("id", "n", "tokens")), strict=True)), percent)
        label = s.components()
        a = s.ids[label] if len(label) else s.ids
        central = label == np.arange(len(label))
        return pa.table([pa.array(a), pa.array(s.ids), pa.array(central)], ["a", "b", "central"])

    return each


def _links_across(percent: int):
    """Of a block's own nodes (guest false) and its guests: a link from each guest to each component that it is similar to."""

    def each(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t.column(c).to_pylist() for c in ("id", "n", "tokens", "label", "guest")), strict=True))
        own = [r for r in rows if not r[4]]
        s = Sets([r[:3] for r in own], percent)
        index = s.index(np.ones(len(own), bool))
        label = np.array([r[3] for r in own], np.int64)
        out = []
        for i, n, tokens, lab, guest in rows:
            if guest and own:
                found = s.linked(np.frombuffer(tokens, np.uint64), n, index)
                found = found[label[found] != lab]
                out += [(i, int(s.ids[k])) for k in found[np.unique(label[found], return_index=True)[1]].tolist()]
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64()), pa.array([False] * len(out), pa.bool_())], ["a", "b", "central"])

    return each


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """id, label: the smallest id that links (a, b) reach, for each id in a link, by alternating large-star and small-star steps."""
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        old, edges = edges, cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        forget(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, label for each node."""
    found = components(links)
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _n_blocks(block: int) -> Column:
    """Blocks for a group of nodes, so that none has more than about ``block`` of them or BLOCK_BYTES of tokens."""
    return F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("long")


def _dealt(rows: DataFrame, block: int, salt: str) -> DataFrame:
    """rows (id, anchor, size) with blocks, the number of their anchor's blocks, and deal, their own."""
    per = cut(rows.groupBy("anchor").agg(_n_blocks(block).alias("blocks")))
    return rows.join(per, "anchor").withColumn("deal", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")))


def link_nodes(nodes: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """id, label: components of the links among nodes (id, n, tokens, keys) that share a key."""
    pairs = nodes.select("id", F.explode("keys").alias("key"))
    often = cut(pairs.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    keyed = cut(pairs.join(often, "key"))  # key, id, c
    # a node's home: the most frequent of its keys, dealt into blocks
    anchors = keyed.groupBy("id").agg(F.max(F.struct("c", "key")).alias("x"))
    sizes = nodes.select("id", F.octet_length("tokens").alias("size"))
    homes = cut(_dealt(anchors.join(sizes, "id").select("id", F.col("x.key").alias("anchor"), "size"), block, "home"))
    sets = cut(nodes.select("id", "n", "tokens").join(homes, "id"))
    links = cut(sets.groupBy("anchor", "deal").applyInArrow(_links_within(percent), LINK))
    every, used = [links.select("a", "b")], [often, keyed, homes, sets, links]
    # central nodes of the components of a key's blocks, against each other, until one block holds them
    many = cut(homes.filter("blocks > 1").select("anchor").distinct())
    used.append(many)
    central = links.filter("central").select(F.col("a").alias("id"))
    for _ in range(8):
        mid = homes.select("id", "anchor", "size").join(many, "anchor", "left_semi").join(central, "id", "left_semi")
        mid = cut(_dealt(mid, block, "central").join(nodes.select("id", "n", "tokens"), "id"))
        more = cut(mid.groupBy("anchor", "deal").applyInArrow(_links_within(percent), LINK))
        every.append(more.select("a", "b"))
        used += [mid, more]
        if mid.filter("blocks > 1").isEmpty():
            break
        central = more.filter("central").select(F.col("a").alias("id"))
    known = every[0]
    for x in every[1:]:
        known = known.unionByName(x)
    labels = cut(_labelled(nodes, known))
    # nodes outside the main component of a key, against each block that has the key
    spread = keyed.select("key", "id").join(labels, "id").groupBy("key", "label").agg(F.count("*").alias("k"))
    main = spread.groupBy("key").agg(F.max(F.struct("k", "label")).alias("x"), F.count("*").alias("parts")).filter("parts > 1").select("key", F.col("x.label").alias("main"))
    main = cut(main)
    open_keys = cut(keyed.select("key", "id").join(main, "key").join(labels, "id").join(homes.select("id", "anchor", "deal"), "id"))
    outside = cut(open_keys.filter("label <> main").select("key", "id", "label", F.col("anchor").alias("a0"), F.col("deal").alias("d0")))
    where = cut(open_keys.select("key", "anchor", "deal").distinct())
    # keys that stand in the same blocks are one class; a block's outsiders are guests wherever a class of theirs stands
    classes = cut(where.groupBy("key").agg(F.bit_xor(F.xxhash64("anchor", "deal")).alias("x"), F.bit_xor(F.xxhash64("deal", "anchor", F.lit(1))).alias("y"), F.count("*").alias("z")))
    stands = where.join(classes, "key").select("x", "y", "z", "anchor", "deal").distinct()
    asks = outside.join(classes, "key").select("x", "y", "z", "a0", "d0").distinct()
    near = asks.join(stands, ["x", "y", "z"]).filter("anchor <> a0 OR deal <> d0").select("a0", "d0", "anchor", "deal").distinct()
    guests = guest_rows = cut(outside.select("id", "label", "a0", "d0").distinct().join(near, ["a0", "d0"]).select("id", "label", "anchor", "deal"))
    # a block with many guests meets them in several groups, each of a bounded number of rows
    groups = guests.join(sizes, "id").groupBy("anchor", "deal").agg(_n_blocks(block).alias("groups"))
    guests = guests.join(groups, ["anchor", "deal"]).withColumn("g", F.pmod(F.xxhash64("id", F.lit("guest")), F.col("groups")))
    guests = guests.join(nodes.select("id", "n", "tokens"), "id").withColumn("guest", F.lit(True))
    own = sets.join(labels, "id").join(groups, ["anchor", "deal"]).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    own = own.select("id", "label", "anchor", "deal", "g", "n", "tokens", F.lit(False).alias("guest"))
    last = guests.select(*own.columns).unionByName(own).groupBy("anchor", "deal", "g").applyInArrow(_links_across(percent), LINK)
    last = cut(last.select("a", "b"))
    merged = components(last.unionByName(labels.select(F.col("id").alias("a"), F.col("label").alias("b"))))
    forget(*used, labels, main, open_keys, outside, where, classes, guest_rows, last)
    return merged


# ---------------------------------------------------------------- (4) documents


def shingle_nodes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, frequent: int = FREQUENT, often: int = OFTEN) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, a, b; equal sets agree in n, a, b) and nodes: one of each group of equal sets that may have a similar one."""
    parts = n_parts(docs.select("text"), 16 << 20) * 2
    cells = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_to_blocks(size, parts, percent, often)), CELL)
    shared = cut(cells.groupBy("part").applyInArrow(_share, CELL))

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("id", "<i8"), ("none", "?"), ("n", "<i8"), ("a", "<u8"), ("b", "<u8")])
        for x in batches:
            for number, data in zip(x.column("block").to_pylist(), x.column("data").to_pylist(), strict=True):
                t = np.frombuffer(data, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(t), number, np.int64)), pa.array(np.arange(len(t), dtype=np.int64)), pa.array(t["id"].copy(), mask=t["none"].copy()), *(pa.array(t[c].astype(np.int64)) for c in ("n",)), *(pa.array(t[c].copy().view(np.int64)) for c in ("a", "b"))],
                    ["block", "place", "doc_id", "n", "a", "b"],
                )

    documents = cut(shared.filter("kind = 0").select("block", "data").mapInArrow(tables, "block long, place long, doc_id long, n long, a long, b long"))
    firsts = documents.filter("doc_id IS NOT NULL AND n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("id"), F.min(F.struct("block", "place")).alias("p"))
    wanted = firsts.select(F.lit(2).alias("kind"), F.col("p.block").alias("block"), *(F.lit(None).cast("binary").alias(c) for c in ("data", "more", "third")), F.col("p.place").alias("place"), "id", "n")
    held = shared.filter("kind IN (1, 3, 5)").select("kind", "block", "data", "more", "third", *(F.lit(None).cast("long").alias(c) for c in ("place", "id", "n")))
    nodes = cut(held.unionByName(wanted).groupBy("block").applyInArrow(_emit(percent, frequent), NODE))
    forget(shared)
    return documents.select("doc_id", "n", "a", "b"), nodes


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, frequent: int = FREQUENT, block: int = BLOCK, often: int = OFTEN) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    if not 50 <= percent <= 100 or frequent < 2 or block < 2 or size < 1 or often < 2:
        raise ValueError("percent from 50 to 100, frequent, block and often of 2 or more, size of 1 or more are needed")
    documents, nodes = shingle_nodes(docs, size, percent, frequent, often)
    labels = link_nodes(nodes, percent, block)
    forget(nodes)
    sets = documents.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "a", "b").agg(F.min("doc_id").alias("first"))
    sets = cut(sets.join(labels.withColumnRenamed("id", "first"), "first", "left").select("n", "a", "b", F.coalesce("label", "first").alias("component")))
    # rows that repeat an id tie the components of their texts together
    if documents.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = documents.join(sets, ["n", "a", "b"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    of = cut(documents.join(sets, ["n", "a", "b"], "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component")))
    tied = components(of.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("component").alias("b")))
    out = of.join(tied.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))

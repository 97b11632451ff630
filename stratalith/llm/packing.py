"""Best-fit packing by hierarchical residual packing.

Each task tokenises its documents, cuts those longer than ``limit`` and packs the pieces best-fit, longest first. Bins that are full,
or nearly (``slack`` tokens at most are free), are emitted. Underfull bins are merged as items, in ever fewer tasks of at most
``capacity`` bins each, best-fit again, until one task has seen all that are left or a round no longer helps. A bin travels with its
members, at most ``limit`` of them, so no task holds more than a bounded number of bounded rows.

Nulls: a null text is empty, one piece that holds the end id only; null ids stay null. Rows that repeat an id are documents of their
own, with pieces of their own. An empty table gives no rows. Of extra columns none is read. Very long texts are tokenised whole, about 30
bytes a token, and only then cut.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, outlives, tidy

LIMIT, SLACK, CAPACITY, LOCAL = 4096, 8, 50_000, 200_000
REMEMBERED = 300_000
MEMBER = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
SCHEMA = "fill long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


#: The characters that stand for bytes in byte-level vocabularies, where they are not the bytes' own.
SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for; new holds those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers: a fraction of a list's size."""
    return struct.pack(f"<{len(ids)}i", *ids)


# Words of ASCII and Latin letters only: no normaliser changes more than their case, and a plain pattern cuts them into pre-tokens.
SIMPLE = re.compile("[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PRETOKEN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class WordEncoder:
    """Ids of texts, by a tokenizer that drops blanks: a word between ASCII blanks is encoded once and remembered; beyond a bound, for its batch only.

    Simple words are cut into pre-tokens, which the tokenizer's model encodes once as well; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Numbered()
        self.pieces: dict[str, bytes] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.plain = self.agrees()

    def agrees(self) -> bool:
        """Whether simple() gives the library's ids for each simple character, alone and beside others of every class of the pattern."""
        chars = [c for c in map(chr, range(33, 256)) if SIMPLE.fullmatch(c)]
        words = [w for c in chars for w in (c, *(c + d for d in "aZ1,é"), *(d + c for d in "aZ1,é"), f"x{c}y", f"1{c}2", f",{c}.", c * 3)]
        return all(self.simple(w) == packed_ids(e.ids) for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True))

    def simple(self, word: str) -> bytes:
        out = b""
        for piece in PRETOKEN.findall(word.lower()):
            if (ids := self.pieces.get(piece)) is None:
                shown = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(SHOWN)
                ids = packed_ids([t.id for t in self.tokenizer.model.tokenize(shown)])
                if len(self.pieces) < REMEMBERED:
                    self.pieces[piece] = ids
            out += ids
        return out

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8") for w in words]
        ids = [self.simple(t) if self.plain and SIMPLE.fullmatch(t) else b"" for t in texts]
        hard = [k for k, i in enumerate(ids) if not i]
        for k, e in zip(hard, self.tokenizer.encode_batch_fast([texts[k] for k in hard], add_special_tokens=False) if hard else (), strict=True):
            ids[k] = packed_ids(e.ids)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<i4")])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of each text's."""
        cut_up = [t.encode("utf-8").split() for t in texts]
        before, n_flat = len(self.known), len(self.flat)
        n_words = np.fromiter(map(len, cut_up), np.int64, len(cut_up))
        get = self.known.__getitem__
        which = np.concatenate([np.fromiter(map(get, ws), np.int32, len(ws)) for ws in cut_up])
        if new := self.known.new:
            self.learn(new)
            self.known.new = []
        sizes = self.sizes[which]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(self.starts[which] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids = self.flat[at].astype("<u4")
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_words)])]
        if new and len(self.known) > REMEMBERED:
            for w in new:
                del self.known[w]
            self.starts, self.sizes, self.flat = self.starts[:before], self.sizes[:before], self.flat[:n_flat]
        return ids, np.diff(edges)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: longest first, each into the bin that it leaves least room in."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    fills: list[int] = []
    some = 0  # bit r: a bin with r tokens of room is open
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fit := some >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            b, room = len(fills), limit
            fills.append(0)
        bins[i], offsets[i] = b, limit - room
        fills[b] += n
        if left := room - n:
            free[left].append(b)
            some |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _batches(fills: np.ndarray, sizes: np.ndarray, members: list[pa.Array], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Bins as rows; sizes: the number of each bin's members, which stand one bin after the other."""
    struct = pa.StructArray.from_arrays(members, MEMBER)
    edges = np.r_[0, np.cumsum(sizes)]
    for a in range(0, len(fills), rows):
        b = min(a + rows, len(fills))
        part = struct.slice(int(edges[a]), int(edges[b] - edges[a]))
        lists = pa.ListArray.from_arrays(pa.array(edges[a : b + 1] - edges[a], pa.int32()), part)
        yield pa.RecordBatch.from_arrays([pa.array(fills[a:b], pa.int64()), lists], ["fill", "members"])


def _packed(pieces: list[tuple], limit: int) -> Iterator[pa.RecordBatch]:
    """Bins of pieces (doc_id, piece, start, length, crc)."""
    lengths = np.array([p[3] for p in pieces], np.int64)
    bins, offsets, fills = best_fit(lengths, limit)
    order = np.lexsort((offsets, bins))
    cols = [pa.array([pieces[i][k] for i in order.tolist()], t) for k, t in enumerate(TYPES[:5])]
    yield from _batches(fills, np.bincount(bins, minlength=len(fills)), [*cols, pa.array(offsets[order], pa.int64())])


def _tokenise(path: str, end_id: int, limit: int, batch_chars: int = 1_000_000):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, pieces = encoder(path), []
        outlives("packing", encoder.cache_clear)

        def add(ids: list, texts: list[str]) -> None:
            flat, sizes = e.encode(texts)
            at = 0
            for i, n in zip(ids, sizes.tolist(), strict=True):
                own = np.append(flat[at : at + n], np.array([end_id], "<u4"))
                at += n
                for k, a in enumerate(range(0, n + 1, limit)):
                    part = own[a : a + limit]
                    pieces.append((i, k, a, len(part), zlib.crc32(part.tobytes())))

        for b in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = t.as_py() or ""
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= batch_chars:
                    add(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                add(ids, texts)
            if len(pieces) >= LOCAL:
                yield from _packed(pieces, limit)
                pieces.clear()
        if pieces:
            yield from _packed(pieces, limit)

    return each


def _merge(limit: int):
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        bins, offsets, fills = best_fit(t.column("fill").to_numpy(), limit)
        order = np.lexsort((offsets, bins))
        lists = t.column("members").combine_chunks().take(pa.array(order))
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        shifted = flat.field("offset").to_numpy(zero_copy_only=False) + np.repeat(offsets[order], counts)
        members = [*(flat.field(x) for x in MEMBER[:5]), pa.array(shifted, pa.int64())]
        sizes = np.bincount(bins[order], weights=counts, minlength=len(fills)).astype(np.int64)
        yield from _batches(fills, sizes, members)

    return each


def pack(docs: DataFrame, path: str, end_id: int = 1, limit: int = LIMIT, slack: int = SLACK, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each row of docs (doc_id, text)."""
    if not 0 <= slack < limit or capacity < 2:
        raise ValueError("0 <= slack < limit and capacity >= 2 are needed")
    bins = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_tokenise(path, end_id, limit), "packing"), SCHEMA))
    full = F.col("fill") >= limit - slack
    done, before = [], None
    while True:
        done.append(bins.filter(full))
        under = bins.filter(~full)
        n = under.count()
        if n < 2 or before is not None and n > before * 0.98:
            break
        parts = -(-n // capacity)
        bins, before = cut(under.repartition(parts).mapInArrow(_merge(limit), SCHEMA)), n
        if parts == 1:
            under = bins
            break
    if under is bins:
        done.append(bins)
    else:
        done.append(under)
    every = functools.reduce(DataFrame.unionByName, done)
    # numbered before the members are taken apart: in one select the numbers would go to the members
    numbered = every.withColumn("sequence_id", F.monotonically_increasing_id())
    rows = numbered.select("sequence_id", F.inline("members"))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

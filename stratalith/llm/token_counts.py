"""Token counts by rank-synchronous array merging.

Texts are cut at the special strings and into pre-tokens by the byte-level pattern. Pre-tokens that a task meets for the first time
are merged together: their bytes are symbols in one ragged array, and in each round every sequence applies its own lowest-rank pair,
all its occurrences from the left, at once. A round thus costs a few array operations for thousands of sequences; the symbols that
survive are the tokens. Counts of pre-tokens are remembered, up to a bound, so that frequent ones are merged once in a task.

Merging all occurrences of the lowest-rank pair before the next pair is what the library does one by one: a merge makes a new symbol,
and pairs that hold it rank after the merge that made it.

A round over a long sequence costs its length, and it has as many rounds as ranks: quadratic. Sequences of more than ``LINKED`` bytes
(unspaced text, scripts without spaces) therefore keep the places of each pair by rank and link their symbols, so that a round costs
what it merges; rounds, pairs and results are the same.

Nulls: a null text is empty, with 0 tokens. One row for each row, repeated ids too; none from an empty table. Of extra columns none is
read. Very long texts are counted whole: about 60 bytes for each of their bytes, 400 for those of pre-tokens beyond ``LINKED``.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import outlives, tidy

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED, LONGEST, LINKED = 400_000, 64, 1_000
NONE = np.int64(1) << 62


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class RankMerger:
    """Merges of a byte-level BPE vocabulary as sorted arrays, and the merging of ragged batches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order, made[order]
        self.byte_ids = np.array([vocab[c] for c in byte_characters()], np.int64)
        special = sorted((t["content"] for t in data.get("added_tokens", ()) if t["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made symbol of each pair; NONE where there is no merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left in each piece once no pair merges."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        counts = sizes.copy()
        while len(ids) > 1:
            rank, made = self.ranked(ids[:-1], ids[1:])
            rank[owner[:-1] != owner[1:]] = NONE
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(np.append(rank, NONE), starts)
            size = np.diff(np.append(starts, len(ids)))
            least = np.repeat(low, size)[:-1]
            chosen = (rank == least) & (rank < NONE)
            live = np.repeat(low < NONE, size)
            if not chosen.any():
                break
            # runs of overlapping occurrences (x x x) merge from the left: each second one falls out
            where = np.flatnonzero(chosen)
            first = np.r_[True, np.diff(where) > 1]
            run = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            ids[where] = made[where]
            live[where + 1] = False
            counts -= np.bincount(owner[where], minlength=len(pieces))
            ids, owner = ids[live], owner[live]  # sequences that are done leave as well
        return counts

    @functools.cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and made symbol by pair; only long sequences need them."""
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def linked(self, piece: bytes) -> int:
        """Number of symbols left in one long piece: survivors() with places by rank instead of whole-sequence scans."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        rank, _ = self.ranked(ids[:-1], ids[1:])
        there = np.flatnonzero(rank < NONE)
        if not len(there):
            return len(ids)
        there = there[np.argsort(rank[there], kind="stable")]
        found, edges = np.unique(rank[there], return_index=True)
        places = dict(zip(found.tolist(), (x.tolist() for x in np.split(there, edges[1:])), strict=True))
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pairs, queue, left = self.pairs, found.tolist(), n  # sorted, hence a heap
        while queue:
            now = heapq.heappop(queue)
            for at in sorted(places.pop(now)):
                end = after[at] if ids[at] >= 0 else n
                if end >= n:
                    continue
                hit = pairs.get(ids[at] << 32 | ids[end])
                if hit is None or hit[0] != now:  # an earlier merge took one of the two
                    continue
                made, ids[end] = hit[1], -1
                ids[at] = made
                left -= 1
                after[at] = beyond = after[end]
                before[beyond] = at
                if beyond < n and (hit := pairs.get(made << 32 | ids[beyond])):
                    if hit[0] not in places:
                        places[hit[0]] = []
                        heapq.heappush(queue, hit[0])
                    places[hit[0]].append(at)
                if (back := before[at]) >= 0 and (hit := pairs.get(ids[back] << 32 | made)):
                    if hit[0] not in places:
                        places[hit[0]] = []
                        heapq.heappush(queue, hit[0])
                    places[hit[0]].append(back)
        return left

    def learn(self, new: set[str]) -> None:
        words = sorted(new, key=len)
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            self.known.update(zip(part, self.survivors([w.encode("utf-8", "replace") for w in part]).tolist(), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text. Long pre-tokens are counted, not remembered."""
        out, cut = [], []
        for t in texts:
            parts = self.special.split(t) if self.special else [t]
            out.append(len(parts) - 1)
            cut.append([w for p in parts for w in self.pattern.findall(p)])
        long = [(k, w) for k, ws in enumerate(cut) for w in ws if len(w) > LONGEST]
        if long:
            raw = [(k, w.encode("utf-8", "replace")) for k, w in long]
            some = [(k, w) for k, w in raw if len(w) <= LINKED]
            for (k, _), n in zip(some, self.survivors([w for _, w in some]).tolist(), strict=True):
                out[k] += n
            for k, w in raw:
                if len(w) > LINKED:
                    out[k] += self.linked(w)
            cut = [[w for w in ws if len(w) <= LONGEST] for ws in cut]
        words = set().union(*cut)
        if new := words - self.known.keys():
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = words
            self.learn(new)
        get = self.known.__getitem__
        return [n + sum(map(get, ws)) for n, ws in zip(out, cut, strict=True)]


@functools.lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, batch_chars: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs, by the byte-level vocabulary at path."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        outlives("tokens", merger.cache_clear)
        for b in batches:
            texts = [t.as_py() or "" for t in b.column("text")]
            tokens, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size >= batch_chars:
                    tokens += m.counts(part)
                    part, size = [], 0
            tokens += m.counts(part)
            n_bytes = [len(t.encode("utf-8", "replace")) for t in texts]
            cols = [pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(each, "tokens"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

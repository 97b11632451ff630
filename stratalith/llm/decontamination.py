"""Benchmark decontamination by one Aho-Corasick automaton.

Words are runs of digits, letters a-z (A-Z lower-cased first) and characters beyond ASCII. Each window of ``window`` consecutive words
of a test item, or all its words if they are fewer, is a pattern. The automaton's letters are whole words: its trie, failure links and
outputs are arrays, about 130 bytes for each word of the items, written to one file that every worker maps instead of copying. It is
built once, on the driver. Texts are normalised alike and scanned once: pieces of many texts go through the automaton together, a word a
step; a piece begins a window less one word early, so that its state is that of the whole text. Hits are mapped to words and to code
points of the original.

Items pass through the driver one by one and are held up to ``max_words`` words; more are dealt to several automata, all of which are
used in the same pass over the texts. No benchmark is too large; only the files grow.

Nulls: a null text has no words; an item without text or id is left out. Rows that repeat an id each give a result; items that repeat
an id are one item. No rows from an empty table; without items nothing is hit. scan() reads doc_id and text only; clean() keeps all
columns, whatever their names. Very long texts take about 40 bytes a word.
"""

from __future__ import annotations

import atexit
import functools
import itertools
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import outlives, tidy

WINDOW, MIN_ITEMS, MAX_WORDS = 8, 2, 1_000_000
PIECE, BATCH_CHARS = 128, 2_000_000
IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if IS_WORD[b] else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(NORMAL).split()


class Numbers(dict):
    """Numbers of the items' words, from 1; any other word is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Automaton:
    """Nodes are numbered level by level in the order of (parent, word), so the sorted edges are the trie: edge k leads to node k + 1. Node 0 is the root."""

    ARRAYS = ("edges", "fail", "out", "levels", "ends", "items_at", "items", "vocabulary")

    def __init__(self, arrays: dict[str, np.ndarray], size: int):
        self.size = size
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        words = self.vocabulary.tobytes().split(b" ") if len(self.vocabulary) else []
        self.numbers = Numbers(zip(words, range(1, len(words) + 1), strict=True))
        self.first = np.zeros(len(words) + 1, np.int64)
        top = self.edges[: int(np.searchsorted(self.edges, np.int64(1) << 32))]
        self.first[top] = np.arange(1, len(top) + 1)

    @classmethod
    def of(cls, items: Iterable[tuple[int, str]], size: int) -> Automaton:
        numbers: dict[bytes, int] = {}
        flat, sizes, ids = [], [], []
        for i, text in items:
            if ws := words_of(text):
                flat.append(np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in ws), np.int64, len(ws)))
                sizes.append(len(ws))
                ids.append(i)
        words = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        n = np.array(sizes, np.int64)
        windows = np.maximum(n - size + 1, 1) if len(n) else n
        starts = np.repeat(np.cumsum(n) - n - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
        length = np.repeat(np.minimum(n, size), windows)
        owner = np.repeat(np.array(ids, np.int64), windows)
        node = np.zeros(len(starts), np.int64)
        edges, levels = [np.zeros(0, np.int64)], [0, 1]  # levels: the first node of each depth
        for d in range(int(length.max()) if len(length) else 0):
            on = length > d
            found, at = np.unique(node[on] << 32 | words[starts[on] + d], return_inverse=True)
            node[on] = levels[-1] + at
            edges.append(found)
            levels.append(levels[-1] + len(found))
        arrays = {"edges": np.concatenate(edges), "levels": np.array(levels, np.int64), "vocabulary": np.frombuffer(b" ".join(numbers), np.uint8)}
        fail = np.zeros(levels[-1], np.int32)
        out = np.zeros(levels[-1], np.int32)
        both = np.unique(np.stack([node, owner], 1), axis=0) if len(node) else np.zeros((0, 2), np.int64)
        arrays["ends"], at = np.unique(both[:, 0], return_index=True)
        arrays["items_at"], arrays["items"] = np.append(at, len(both)).astype(np.int64), both[:, 1].copy()
        is_end = np.zeros(levels[-1], bool)
        is_end[arrays["ends"]] = True
        made = cls({**arrays, "fail": fail, "out": out}, size)
        for a, b in zip(levels[1:], levels[2:], strict=False):
            key = arrays["edges"][a - 1 : b - 1]
            if a > 1:
                fail[a:b] = made.step(fail[key >> 32], key & 0xFFFFFFFF)
            out[a:b] = np.where(is_end[a:b], np.arange(a, b), out[fail[a:b]])
        return made

    def save(self, path: str) -> None:
        """One file: the length of a header, the header, the arrays."""
        head, at = {}, 0
        for name in self.ARRAYS:
            x = getattr(self, name)
            head[name] = (x.dtype.str, at, x.nbytes)
            at += -(-x.nbytes // 8) * 8
        raw = json.dumps({"size": self.size, "arrays": head}).encode()
        raw += b" " * (-len(raw) % 8)
        with open(path, "wb") as f:
            f.write(len(raw).to_bytes(8, "little") + raw)
            for name in self.ARRAYS:
                data = getattr(self, name).tobytes()
                f.write(data + bytes(-len(data) % 8))

    @classmethod
    def load(cls, path: str) -> Automaton:
        raw = np.memmap(path, np.uint8, "r")
        n = 8 + int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8:n].tobytes())
        return cls({name: raw[n + at : n + at + size].view(kind) for name, (kind, at, size) in head["arrays"].items()}, head["size"])

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state after a word, for many states: along an edge, or from the state that the failure link leads to."""
        new = self.first[word]
        left = np.flatnonzero((state > 0) & (word > 0))
        at, word = state[left].astype(np.int64), word[left]
        while len(left):
            key = at << 32 | word
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[edge] == key
            new[left[hit]] = edge[hit] + 1
            left, at, word = left[~hit], self.fail[at[~hit]].astype(np.int64), word[~hit]
            on = at > 0  # at the root the word's own edge, if there is one, stands already
            left, at, word = left[on], at[on], word[on]
        return new

    def find(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and node of each occurrence of a pattern's last word, in texts that stand one after the other."""
        ends = np.cumsum(sizes)
        lanes = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (ends - sizes)[text] + nth * PIECE
        end, start = np.minimum(begin + PIECE, ends[text]), np.maximum(begin - self.size + 1, (ends - sizes)[text])
        order = np.argsort(start - end, kind="stable")
        begin, start, length = begin[order], start[order], (end - start)[order]
        state, at, nodes = np.zeros(len(order), np.int64), [], []
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -t))
            here = start[:m] + t
            state[:m] = now = self.step(state[:m], words[here])
            node = self.out[now]
            hit = np.flatnonzero((node > 0) & (here >= begin[:m]))
            here, node = here[hit], node[hit]
            while len(node):
                at.append(here)
                nodes.append(node)
                node = self.out[self.fail[node]]
                here, node = here[node > 0], node[node > 0]
        return (np.concatenate(at), np.concatenate(nodes).astype(np.int64)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Scanner:
    """Texts against automata."""

    def __init__(self, items: Iterable[tuple[int, str]] = (), size: int = WINDOW, automata: list[Automaton] | None = None):
        self.automata = [Automaton.of(items, size)] if automata is None else automata

    def scan_all(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[int]]]:
        """Of each text its words, which of them are hit (empty: none), and the items."""
        cut_up = [words_of(t) for t in texts]
        sizes = np.fromiter(map(len, cut_up), np.int64, len(cut_up))
        ends = np.cumsum(sizes)
        edge: dict[int, np.ndarray] = {}
        items: dict[int, set[int]] = {}
        for a in self.automata:
            get = a.numbers.__getitem__
            words = np.fromiter(map(get, itertools.chain.from_iterable(cut_up)), np.int64, int(sizes.sum()))
            at, node = a.find(words, sizes)
            text = np.searchsorted(ends, at, "right")
            order = np.argsort(text, kind="stable")
            text, at, node = text[order], at[order], node[order]
            long = np.searchsorted(a.levels, node, "right") - 1
            cuts = np.flatnonzero(np.diff(text, prepend=-1, append=len(texts) + 1))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                k = int(text[lo])
                marks = edge.setdefault(k, np.zeros(int(sizes[k]) + 1, np.int64))
                last = at[lo:hi] - (ends[k] - sizes[k]) + 1
                np.add.at(marks, last - long[lo:hi], 1)
                np.add.at(marks, last, -1)
                found = items.setdefault(k, set())
                for p in np.searchsorted(a.ends, np.unique(node[lo:hi])).tolist():
                    found.update(a.items[a.items_at[p] : a.items_at[p + 1]].tolist())
        none = np.zeros(0, bool)
        return [(int(n), np.cumsum(edge[k][:-1]) > 0 if k in edge else none, items.get(k, set())) for k, n in enumerate(sizes.tolist())]

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[int]]:
        return self.scan_all([text])[0]

    def scan_column(self, column: pa.Array, take) -> list:
        """take(text, words, hit, items) of each text, a bounded number of characters at a time."""
        out, part, size = [], [], 0
        for t in column:
            part.append(t.as_py())
            size += len(part[-1] or "")
            if size >= BATCH_CHARS:
                out += [take(t, *r) for t, r in zip(part, self.scan_all(part), strict=True)]
                part, size = [], 0
        return out + [take(t, *r) for t, r in zip(part, self.scan_all(part), strict=True)]


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.r_[False, hit, False].astype(np.int8))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def original_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Code points of the original text that runs of hit words take, end exclusive."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    step = np.diff(np.r_[False, IS_WORD[raw], False].astype(np.int8))
    point = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    starts, ends = point[np.flatnonzero(step == 1)], point[np.flatnonzero(step == -1)]
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in runs(hit)]


@functools.cache
def _folder() -> str:
    """The driver's folder for automata on their way to the executors."""
    folder = tempfile.mkdtemp(prefix="automata-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def _ship(benchmark: DataFrame, size: int, max_words: int) -> list[str]:
    """Names of the files that hold the automata over the items, each of at most max_words words (a longer item alone)."""
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    names: list[str] = []
    held: list[tuple[int, str]] = []
    n = 0

    def emit() -> None:
        name = f"automaton-{uuid.uuid4().hex}"
        path = os.path.join(_folder(), name)
        Automaton.of(held, size).save(path)
        benchmark.sparkSession.sparkContext.addFile(path)
        names.append(name)

    for i, text in items.orderBy("item_id", "text").toLocalIterator():
        k = len(words_of(text))
        if held and n + k > max_words:
            emit()
            held, n = [], 0
        held.append((i, text))
        n += k
    if held or not names:
        emit()
    return names


@functools.lru_cache(maxsize=1)
def _scanner(names: tuple[str, ...]) -> Scanner:
    return Scanner(automata=[Automaton.load(SparkFiles.get(n)) for n in names])


def _loaded(names: list[str]) -> Scanner:
    """A worker's scanner, mapped once."""
    outlives("decontamination", _scanner.cache_clear)
    return _scanner(tuple(names))


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
RESULT = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"
RESULT_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(SPAN))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated (n_items >= min_items), spans, for each row of docs (doc_id, text)."""
    names = _ship(benchmark, window, max_words)

    def take(text: str | None, n: int, hit: np.ndarray, found: set[int]) -> tuple:
        return n, int(hit.sum()), sorted(found), original_spans(text, hit) if found else []

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _loaded(names).scan_column(b.column("text"), take)
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, RESULT_TYPES, strict=True))], ["doc_id", "n_words", "n_hit", "items", "spans"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(each, "decontamination"), RESULT)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), "items", F.sha2(ids, 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that hold windows of fewer than min_items items."""
    names = _ship(benchmark, window, max_words)

    def take(text: str | None, n: int, hit: np.ndarray, found: set[int]) -> bool:
        return len(found) < min_items

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_loaded(names).scan_column(b.column("text"), take), pa.bool_()))

    return docs.mapInArrow(tidy(each, "decontamination"), docs.schema)

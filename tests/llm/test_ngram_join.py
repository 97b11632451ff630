from __future__ import annotations

import random

import numpy as np
import pytest
from edge_cases import ROWS, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm.ngram_join import components, has_others, join, levels, prefix_keys, strong


def word_sets(rows, size=5):
    out = []
    for i, text, *_ in rows:
        raw = (text or "").encode().lower().split()
        out.append((i, {tuple(raw[k : k + size]) for k in range(max(1, len(raw) - size + 1))} if raw else set()))
    return out


def plain(rows, percent=75):
    sets = word_sets(rows)
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    named = [(i, s) for i, s in sets if i is not None and s]
    for a, (i, s) in enumerate(named):
        for j, t in named[:a]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def got(spark, rows, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join(documents(spark, rows, False).repartition(3), **kw).collect()), key=repr)


def corpus(seed, n_groups=6, copies=12):
    """Groups of near copies about the threshold, exact copies, shared passages, short texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    passage = " ".join(rng.choices(words, k=30))
    rows = []
    for _ in range(n_groups):
        base = rng.choices(words, k=rng.choice([4, 6, 9, 14, 40, 120]))
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
            rows.append(text + (" " + passage if rng.random() < 0.4 else ""))
            if rng.random() < 0.2:
                rows.append(rows[-1].upper())
    rows += [passage, passage + " tail", "", "one", "ONE", None]
    ids = rng.sample(range(10_000), len(rows))
    return [(i, t, None, None, None) for i, t in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("seed, kw", [(0, {}), (1, {"frequent": 2, "block": 3}), (2, {"frequent": 4, "block": 5}), (3, {"frequent": 2, "block": 2}), (4, {"often": 2, "frequent": 2, "block": 4}), (0, {"often": 2}), (0, {"often": 10_000})])
def test_brute_force(spark, seed, kw):
    rows = corpus(seed)
    assert got(spark, rows, **kw) == plain(rows)


def test_large_group_in_many_blocks(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(150)] = f"n{rng.random()}"
        rows.append((k + 1, " ".join(own), None, None, None))
    assert got(spark, rows, block=8, frequent=8) == got(spark, rows, block=8, frequent=8, often=2) == plain(rows)


def test_blocks_of_few_bytes(spark, monkeypatch):
    from stratalith.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2_000)
    rows = corpus(11, n_groups=4)
    assert got(spark, rows) == plain(rows)


def test_edges(spark):
    assert got(spark, ROWS) == plain(ROWS)
    assert join(documents(spark)).count() == len(ROWS)
    assert got(spark, []) == []


def test_repeated_ids_tie_texts(spark):
    a, b = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(5, a, *[None] * 3), (3, b, *[None] * 3), (9, a, *[None] * 3), (9, b, *[None] * 3)]
    assert {r[2] for r in got(spark, rows)} == {3}


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 60), st.data())
def test_prefixes_meet(n, data):
    """Any two similar sets share a key, whatever the counts of their tokens are."""
    x = data.draw(st.sets(st.integers(0, 80), min_size=n, max_size=n))
    y = set(x) - set(data.draw(st.lists(st.sampled_from(sorted(x)), max_size=max(1, n // 5)))) | data.draw(st.sets(st.integers(81, 120), max_size=max(1, n // 6)))
    both = len(x & y)
    if not y or 100 * both < 75 * (len(x) + len(y) - both):
        return
    level = {t: data.draw(st.integers(1, 9)) for t in sorted(x | y)}
    keys = []
    for s in (x, y):
        t = np.array(sorted(s), np.uint64)
        keys.append(set(prefix_keys(t, np.array([level[int(v)] for v in t], np.uint8), len(t), 75, 8).tolist()))
    assert keys[0] & keys[1]


def test_no_partner_but_equals():
    """Sets that has_others() leaves out have no similar set but their equals, at any percent."""
    for percent in (50, 60, 75, 90, 100):
        for n in range(1, 40):
            best = max((both / (n + m - both) for m in range(1, 200) for both in [min(n, m)] if m != n), default=0)
            assert has_others(n, percent) == (100 * best >= percent - 1e-9) or has_others(n, percent) and percent == 100, (n, percent)


def test_short_texts_are_told_apart():
    """The second sum over a short text's shingles does not depend on their 64-bit tokens."""
    texts = ["a", "b", "a b", "a b c d e", "a a a a a a a", "a a a a a", "A  A\ta a a"]
    assert [strong(t) == strong(u) for t in texts for u in texts] == [word_sets([(0, t)])[0][1] == word_sets([(0, u)])[0][1] for t in texts for u in texts]


def test_tables_are_removed(spark):
    """What a join has kept for its steps goes when the next ones stand."""
    import os

    from stratalith.llm.common import scratch, shared_dir

    where = shared_dir(spark).removeprefix("file:")
    there = lambda: {x for top, d, _ in os.walk(where) if top.count("/") == where.count("/") + 1 for x in d}
    before = there()
    with scratch(spark):
        out = join(documents(spark, corpus(0), False))
        assert out.count() and 0 < len(there() - before) <= 6
    assert not there() - before


def test_levels():
    assert levels(3, 75) == [0] and levels(4, 75) == [0, 2] and levels(5, 75) == [2] and levels(64, 75) == [5, 6] and levels(100, 75) == [6]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(500, 560)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {r.id: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {k: found.get(k, k) for k in parent} == {k: find(k) for k in parent}


@pytest.mark.parametrize("bad", [{"percent": 40}, {"block": 1}, {"frequent": 1}, {"size": 0}, {"often": 1}])
def test_bad_options(spark, bad):
    with pytest.raises(ValueError):
        join(documents(spark, ROWS), **bad)

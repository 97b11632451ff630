from __future__ import annotations

import random
import re

import pytest
from edge_cases import ROWS, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm.decontamination import Automaton, Scanner, clean, original_spans, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, size):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        p = words(t)
        k = min(len(p), size)
        grams = {tuple(p[a : a + k]) for a in range(len(p) - k + 1)} if p else set()
        for a in range(len(w) - k + 1 if k else 0):
            if tuple(w[a : a + k]) in grams:
                hit |= set(range(a, a + k))
                found.add(i)
    return len(w), hit, found


token = st.sampled_from(["a", "B", "b", "ä", "1", "-", " ", "\n", ",", "É", "\u0085"])
text = st.lists(token, max_size=30).map("".join)


@settings(max_examples=400, deadline=None)
@given(text, st.lists(st.tuples(st.integers(0, 3), text), max_size=4), st.integers(1, 4))
def test_brute_force(doc, items, size):
    n, hit, found = Scanner(items, size).scan(doc)
    want = plain(doc, items, size)
    assert (n, set(hit.nonzero()[0].tolist()) if len(hit) else set(), found) == want
    if len(hit):
        for s in original_spans(doc, hit):
            assert words(doc[s["start"] : s["end"]]) and WORD.fullmatch(doc[s["start"]].translate(LOWER))
        assert [w for s in original_spans(doc, hit) for w in words(doc[s["start"] : s["end"]])] == [w for k, w in enumerate(words(doc)) if hit[k]]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota"), (2, "Short item"), (3, None), (4, "..."), (None, "alpha beta"), (2, "other words of item two that are quite long indeed"), (1, "alpha beta gamma delta epsilon zeta eta theta iota")]


@pytest.mark.parametrize("max_words", [50_000, 5])
def test_frames(spark, max_words):
    rows = [*ROWS, (20, "x ALPHA, beta gamma delta: epsilon zeta eta theta y short item", None, None, None), (21, "alpha beta gamma", None, None, None)]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.items), r.contaminated) for r in scan(documents(spark, rows), bench(spark, ITEMS), max_words=max_words).collect()), key=repr)
    items = [x for x in ITEMS if None not in x]
    want = []
    for i, t, *_ in rows:
        n, hit, found = plain(t, items, 8)
        want.append((i, n, len(hit), tuple(sorted(found)), len(found) >= 2))
    assert got == sorted(want, key=repr)
    kept = clean(documents(spark, rows), bench(spark, ITEMS), max_words=max_words)
    assert kept.count() == len(rows) - 1 and kept.columns == documents(spark, rows).columns


def test_empty(spark):
    assert scan(documents(spark, []), bench(spark, ITEMS)).count() == 0
    r = scan(documents(spark), bench(spark, [])).collect()
    assert len(r) == len(ROWS) and not any(x.contaminated for x in r)
    assert clean(documents(spark), bench(spark, [])).count() == len(ROWS)


def test_saved_and_mapped(tmp_path):
    """An automaton read from its file finds what the one in memory does, in pieces and across their edges."""
    rng = random.Random(3)
    vocabulary = [f"v{k}" for k in range(40)] + ["ä", "7"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for k in range(60)]
    texts = [" ".join(rng.choices([*vocabulary, "other"], k=rng.randrange(0, 900))) for _ in range(20)]
    texts += [" ".join(rng.choices(vocabulary, k=p)) + " " + items[1][1] + " tail" for p in range(115, 135)]
    built = Automaton.of(items, 3)
    built.save(str(tmp_path / "a"))
    for scanner in (Scanner(automata=[built]), Scanner(automata=[Automaton.load(str(tmp_path / "a"))])):
        for t, (n, hit, found) in zip(texts, scanner.scan_all(texts), strict=True):
            assert (n, set(hit.nonzero()[0].tolist()), found) == plain(t, items, 3)


def test_several_automata_in_one_pass(spark):
    """Items beyond max_words are dealt to more automata; texts are read once whatever their number is."""
    rows = [*ROWS, (20, "x ALPHA, beta gamma delta: epsilon zeta eta theta y short item", None, None, None)]
    one, many = (scan(documents(spark, rows), bench(spark, ITEMS), max_words=m) for m in (1_000, 3))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_many_items():
    """A large suite in one automaton: its size is a fixed number of bytes a word."""
    rng = random.Random(1)
    items = [(k, " ".join(f"w{rng.randrange(30_000)}" for _ in range(100))) for k in range(2_000)]
    made = Automaton.of(items, 8)
    assert sum(getattr(made, x).nbytes for x in Automaton.ARRAYS) < 200 * 200_000
    text = "a b " + " ".join(items[77][1].split()[20:60]) + " c " + items[1999][1]
    n, hit, found = Scanner(automata=[made]).scan(text)
    assert (n, int(hit.sum()), found) == (143, 140, {77, 1999})

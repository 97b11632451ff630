from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from edge_cases import CLASHES, ROWS, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm.quality_rules import clean, repeated_words, score, text_features


def plain_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    keys = [line.strip(" \t\n\v\f\r") for line in text.split("\n")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), sum(map(len, keys))


def plain_keys(text):
    return [line.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for line in (text or "").split("\n")]


def plain_score(rows, min_docs, max_percent, min_kept_percent):
    """(doc_id, base_failed, removed_chars, depleted, kept, text left) of each row."""
    ids, hosts = defaultdict(set), Counter(r[3] for r in rows)
    for i, text, _, host, _ in rows:
        for k in plain_keys(text):
            if k:
                ids[host, k].add(i)
    gone = {x: min((i for i in v if i is not None), default=None) for x, v in ids.items() if len(v) > min_docs and 100 * len(v) > max_percent * hosts[x[0]]}
    out = []
    for i, text, _, host, _ in rows:
        f, keys = plain_features(text), plain_keys(text)
        lost = [k for k in keys if (host, k) in gone and gone[host, k] != i]
        failed = f[0] < 20 or 100 * f[4] > 30 * f[0]
        n = sum(map(len, lost))
        depleted = 100 * (f[5] - n) < min_kept_percent * f[5]
        left = "\n".join(x for x, k in zip((text or "").split("\n"), keys, strict=True) if k not in lost)
        out.append((i, failed, n, depleted, not failed and not depleted, left))
    return sorted(out, key=repr)


texts = st.lists(st.sampled_from(["a", "b", "c", "é", "#", "x\u0085y", " "]), max_size=60).flatmap(lambda ws: st.lists(st.sampled_from([" ", "\n", "  ", "\t", "\r\n", "\v"]), min_size=len(ws), max_size=len(ws)).map(lambda gaps: "".join(w + g for w, g in zip(ws, gaps, strict=True))))


@settings(max_examples=300, deadline=None)
@given(texts)
def test_features(text):
    assert text_features(text) == plain_features(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=40), st.integers(1, 9))
def test_repeats(words, size):
    windows = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
    often = Counter(windows)
    assert repeated_words(words, size) == len({k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(size)})


def host(n, line, own="unlike {0} any other document of {0} words that {0} there {0} ever were in {0} some {0} corpus of {0} texts like {0} this"):
    return [(k, f"{own.format(k)}\n{line}", "en", "h", None) for k in range(n)]


def test_limits(spark):
    docs = documents(spark, host(30, "Share this page") + [(100 + k, " ".join(f"{k}y{j}" for j in range(30)) + "\nShare this page", "en", "other", None) for k in range(5)])
    got = {r.doc_id: r for r in score(docs, min_docs=20, max_percent=1).collect()}
    assert got[0].removed_chars == 0 and got[1].removed_chars == len("Share this page") and got[100].removed_chars == 0
    assert not any(r.depleted for r in got.values()) and got[1].kept
    kept = {r.doc_id: r.text for r in clean(docs, 20, 1).collect()}
    assert kept[0].endswith("\nShare this page") and "Share" not in kept[1] and kept[100].endswith("Share this page")


def test_depleted_copies_but_one(spark):
    body = " ".join(f"word{k}" for k in range(40))
    docs = documents(spark, [(k, body, "en", "h", None) for k in range(25)])
    got = {r.doc_id: r for r in score(docs, min_docs=20).collect()}
    assert got[0].kept and all(got[k].depleted and not got[k].kept for k in range(1, 25))


def test_edges(spark):
    docs = documents(spark)
    got = score(docs)
    assert got.count() == len(ROWS)
    for r in got.collect():
        assert r.kept == (not r.base_failed and not r.depleted)
    assert {(r.doc_id, r.base_failed) for r in got.filter("doc_id IN (3, 4, 5)").collect()} == {(3, True), (4, True), (5, True)}
    kept = clean(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()
    assert {tuple(r[c] for c in CLASHES) for r in kept.collect()} == {("clash",) * len(CLASHES)}


def test_repeated_ids_count_once(spark):
    rows = [(1, "the line\n" + f"own {k} " * 20, "en", "h", None) for k in range(30)]
    assert all(r.removed_chars == 0 for r in score(documents(spark, rows), min_docs=20).collect())


@pytest.mark.parametrize("seed", range(4))
def test_limits_bind_on_repeated_rows(spark, seed):
    """Rows that repeat an id, a text or all their columns, null hosts and ids; a repeated row loses what a single one does."""
    rng = random.Random(seed)
    lines = [f"Shared line number {k} " * (k + 1) for k in range(4)] + ["", "  "]
    rows = []
    for k in range(40):
        body = [" ".join(f"{k}w{rng.randrange(99)}" for _ in range(22))] + rng.choices(lines, k=rng.randrange(5))
        rng.shuffle(body)
        rows.append((rng.choice([None, *range(30)]), "\n".join(body) if k % 13 else None, "en", rng.choice(["h", "i", None]), None))
    rows += [rng.choice(rows) for _ in range(15)]
    want = plain_score(rows, 3, 5, 80)
    docs = documents(spark, rows).repartition(3)
    assert sorted(((r.doc_id, r.base_failed, r.removed_chars, r.depleted, r.kept) for r in score(docs, 3, 5, 80).collect()), key=repr) == sorted((w[:5] for w in want), key=repr)
    assert any(w[2] for w in want) and any(w[3] for w in want)
    kept = clean(docs, 3, 5, 80).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(((w[0], w[5]) for w in want if w[4]), key=repr)


def test_repeated_row_loses_once(spark):
    rows = host(30, "Share this page")
    got = score(documents(spark, [*rows, rows[7]]), min_docs=20).filter("doc_id = 7").collect()
    assert [r.removed_chars for r in got] == [len("Share this page")] * 2


def test_empty(spark):
    none = documents(spark, [])
    assert score(none).count() == 0 and clean(none).count() == 0


@pytest.mark.parametrize("percent, gone", [(50, True), (99, False)])
def test_share_of_host(spark, percent, gone):
    docs = documents(spark, host(30, "Share this page") + [(100 + k, " ".join(f"{k}x{j}" for j in range(25)), "en", "h", None) for k in range(3)])
    assert (score(docs, 20, percent).filter("removed_chars > 0").count() > 0) == gone

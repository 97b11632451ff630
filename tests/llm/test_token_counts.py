from __future__ import annotations

import public_tokenizers
import pytest
from edge_cases import ROWS, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratalith.llm import token_counts
from stratalith.llm.token_counts import count_tokens, merger

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


pieces = st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", " the", "  ", "\n\n", "aaaa", "'s", "'ll", "1234", "日本", "\u0085", "﻿"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=12).map("".join))
def test_same_as_library(library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert merger(PATH).counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


long = st.sampled_from(["abcdefghijklmnopqrstuvwxyz", "etaoin", "a", "ab", "日本語の文字", "=-", " ", "0123", "аеиоу", "ÿ\u0301"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(long, st.integers(1, 400)), min_size=1, max_size=12), st.randoms(use_true_random=False))
def test_long_pretokens(library, parts, rng):
    """Long sequences take another route, to the same symbols: by round, and by the library."""
    text = "".join("".join(rng.choices(letters, k=n)) for letters, n in parts)
    m = merger(PATH)
    assert m.counts([text]) == [len(library.encode(text, add_special_tokens=False).ids)]
    raw = text.encode()
    assert m.linked(raw) == m.survivors([raw])[0]


def test_time_is_linear(library):
    import random
    import string
    import time

    text = "".join(random.Random(1).choices(string.ascii_lowercase, k=300_000))
    begin = time.perf_counter()
    assert merger(PATH).counts([text]) == [len(library.encode(text).ids)]
    assert time.perf_counter() - begin < 20  # whole-sequence rounds took minutes


def test_forgetting(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    m = token_counts.RankMerger(PATH)
    texts = [f"word{k} of many words {k * k}" for k in range(40)]
    assert [m.counts([t])[0] for t in texts] == [len(library.encode(t).ids) for t in texts]


def test_edges(spark, library):
    got = count_tokens(documents(spark), PATH).collect()
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "").ids)) for i, t, *_ in ROWS), key=repr)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert count_tokens(documents(spark, []), PATH).count() == 0


def test_query(spark, sf_dir, duck, library):
    from stratalith.llm.queries import QUERIES

    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op5_token_counts"](spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}

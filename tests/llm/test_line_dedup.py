from __future__ import annotations

import hashlib
from collections import defaultdict

from edge_cases import CLASHES, ROWS, documents
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stratalith.llm.line_dedup import clean, dedup_lines

BLANKS = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_chars=1, min_docs=10):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    found = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            found[key(line)].add(i)
    gone = {k for k, ids in found.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(documents(spark, rows, False), **kw).withColumnRenamed("kept_text", "kept").collect()), key=repr)


lines = st.sampled_from(["Same", "same ", "\tSAME\r", "ÄB", "äb", "", " ", "unique", "x\u0085", " same"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.lists(lines, max_size=5).map("\n".join))), max_size=12), st.integers(1, 4), st.integers(0, 3))
def test_brute_force(spark, rows, min_docs, min_chars):
    rows = [(i, t, None, None, None) for i, t in rows]
    assert got(spark, rows, min_docs=min_docs, min_chars=min_chars) == plain(rows, min_chars, min_docs)


def test_edges(spark):
    assert got(spark, ROWS, min_docs=2) == plain(ROWS, 1, 2)
    out = dedup_lines(documents(spark), min_docs=2)
    assert out.columns == [*documents(spark).columns, "n_lines_", "n_dropped_", "kept_text_"]
    rows = out.collect()
    assert {tuple(r[c] for c in CLASHES) for r in rows} == {("clash",) * len(CLASHES)}
    assert sorted(((r.doc_id, r.n_lines_, r.n_dropped_, r.kept_text_) for r in rows), key=repr) == plain(ROWS, 1, 2)


def test_clean(spark):
    docs = documents(spark)
    out = clean(docs, min_docs=2)
    assert out.schema == docs.schema
    rows = out.collect()
    assert {tuple(r[c] for c in CLASHES) for r in rows} == {("clash",) * len(CLASHES)}
    lost = [(i, d, t) for i, _, d, t in plain(ROWS, 1, 2)]
    assert sorted(((r.doc_id, r.text or "") for r in rows), key=repr) == sorted(((i, t) for i, _, t in lost), key=repr)
    assert any(r.text is None for r in rows) and all(r.n_chars == len(r.text) for r in rows if r.doc_id == 1)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_many_lines_of_one_text(spark):
    rows = [(k, "\n".join(f"line {j}" if j % 2 else f"own {k} {j}" for j in range(20_000)), None, None, None) for k in range(3)]
    assert got(spark, rows, min_docs=3) == plain(rows, 1, 3)


def test_digest(spark):
    from stratalith.llm.queries import op4_line_dedup

    first = op4_line_dedup(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    assert len(first.kept_sha256) == len(hashlib.sha256(b"").hexdigest())

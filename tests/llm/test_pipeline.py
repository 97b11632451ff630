"""Each stage against a plain version on its own input, and the whole on a small corpus."""

from __future__ import annotations

import random

import pytest
from edge_cases import CLASHES, ROWS, documents
from test_decontamination import plain as plain_hits
from test_line_dedup import plain as plain_lines
from test_ngram_join import plain as plain_components
from test_quality_rules import plain_features

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(5, 30))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += [t.replace("w1 ", "v1 ") for t in texts[:10]] + [t + "\ncommon line of many documents" for t in texts[20:40]] + texts[50:55]
    items = [(k, " ".join(rng.choices(words, k=20))) for k in range(6)]
    own = lambda: " ".join(rng.choices(words, k=80))
    texts += [own() + " " + items[0][1] + " " + items[1][1], own() + " " + items[2][1], items[3][1][:80] + " " + own()]
    rows = [(k, t, "en", f"h{k % 2}", len(t)) for k, t in enumerate(texts)]
    d = tmp_path_factory.mktemp("sf")
    documents(spark, [*rows, *[(1000 + (r[0] or 0), *r[1:]) for r in ROWS]], False).coalesce(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), items, set(range(len(texts) - 3, len(texts)))


def test_stages(spark, folder, tmp_path):
    d, items, planted = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r) for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == columns and all(r[4] == len(r[1]) for r in after if r[1] is not None and r[0] is not None and r[0] < 1000)
        ids = lambda rows: sorted(r[0] for r in rows)
        if name == "quality_rules":
            good = [(r[0], f) for r in before if (f := plain_features(r[1]))[0] >= 20]
            assert ids(after) == sorted(i for i, f in good if 100 * f[4] <= 30 * f[0])
        elif name == "line_dedup":
            assert sorted((r[0], r[1]) for r in after) == sorted((i, t) for i, _, _, t in plain_lines(before))
        elif name == "ngram_jaccard_join":
            assert ids(after) == sorted(i for i, _, c in plain_components(before) if i == c)
        elif name == "decontamination":
            hit = {r[0] for r in before if plain_hits(r[1], items, 8)[2]}
            assert planted <= hit and any(len(plain_hits(r[1], items, 8)[2]) == 1 for r in before)  # a passage of one item is enough
            assert ids(after) == sorted(r[0] for r in before if r[0] not in hit)
            assert not any(plain_hits(r[1], items, 8)[2] for r in after)
        else:
            assert {r.doc_id for r in docs.collect()} == {r[0] for r in before}
            fills = docs.groupBy("sequence_id").sum("length").collect()
            assert all(r[1] <= 4096 for r in fills)


def test_run(spark, folder):
    d, *_ = folder
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_extra_columns_stay(spark, folder, tmp_path):
    d, *_ = folder
    docs = documents(spark)
    for _name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.filter(" OR ".join(f"`{c}` <> 'clash'" for c in CLASHES)).isEmpty()
        out.write.parquet(f"{tmp_path}/{_name}")
        docs = spark.read.parquet(f"{tmp_path}/{_name}")
    assert docs.count() > 0


def test_empty(spark, folder):
    d, *_ = folder
    docs = documents(spark, [], False)
    for _name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, d)
    assert corpus_pipeline.STAGES[4][1](spark, docs, d).count() == 0

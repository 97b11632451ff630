"""The registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from sql_compare import same_as_sql

from stratalith.llm.oracles import ORACLES
from stratalith.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    same_as_sql(spark, duck, sf_dir, QUERIES[name], ORACLES[name])


def test_names():
    assert [n.split("_")[0] for n in QUERIES if n.startswith("op")] == [f"op{k}" for k in range(1, 11)]
    assert set(QUERIES) - set(ORACLES) == {"op2_secret_scans", "op3_best_fit_packing", "op5_token_counts"}


def test_narrow_ids(spark):
    """Ids of 32 bits and hosts that are numbers do as well."""
    import public_tokenizers

    from stratalith.llm import decontamination, line_dedup, ngram_join, packing, quality_rules, secret_scans, token_counts

    docs = spark.sql("SELECT CAST(1 AS INT) AS doc_id, 'some words here' AS text, CAST(5 AS INT) AS source, 'en' AS lang")
    bench = spark.sql("SELECT CAST(1 AS INT) AS item_id, 'words here' AS text")
    assert quality_rules.score(docs).count() == 1 and quality_rules.clean(docs, 1).count() == 0
    assert secret_scans.scan(docs).first().n_hex == 0
    assert token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).first().n_tokens == 3
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).first().length == 4
    assert decontamination.scan(docs, bench).first().n_hit == 2 and decontamination.clean(docs, bench, min_items=1).count() == 0
    assert ngram_join.join(docs).first().component_id == 1 and line_dedup.dedup_lines(docs).first().n_lines == 1

"""Each operator with SQL against DuckDB, on the standard tables."""

import pytest

from corvane.llm import exact_dedup, registry, substring_dedup


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, sf_dir, same):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name])


def test_colliding_block_hashes(spark, sf_dir, same):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same(exact_dedup.exact_groups(docs, block=512, hash_bits=6), exact_dedup.ORACLE)


def test_crowded_anchors(spark, sf_dir, same, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWDED", 1)
    same(substring_dedup.op7_substring_dedup(spark, sf_dir), substring_dedup.ORACLE)

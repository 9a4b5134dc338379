"""The registered text queries: against their SQL, and the pipeline against its parts."""

from __future__ import annotations

import pytest

from eddyforge.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(name, same):
    same(Q.QUERIES[name], Q.oracle_sql()[name])


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P
    from eddyforge.llm import decontaminate, quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "encoding"]
    kept = {r["doc_id"] for r in quality.assess(spark, docs).where("kept").collect()}
    first = P.STAGES[0][1](spark, docs, sf_dir)
    assert first.schema == docs.schema and {r["doc_id"] for r in first.collect()} == kept
    second = P.STAGES[1][1](spark, first, sf_dir)
    assert second.columns == docs.columns and all(len(r["text"]) == r["n_chars"] for r in second.collect())
    third = P.STAGES[2][1](spark, second, sf_dir)
    fourth = P.STAGES[3][1](spark, third, sf_dir)
    assert fourth.columns == docs.columns
    clean = decontaminate.decontaminate(spark, third, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated")
    assert {r["doc_id"] for r in fourth.collect()} == {r["doc_id"] for r in clean.collect()}
    out = P.run(spark, sf_dir)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in fourth.collect()} and out.where("not round_trip").count() == 0

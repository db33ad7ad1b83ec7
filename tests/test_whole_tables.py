"""Projections and redaction over whole tables: as many rows as the table has."""

import pytest

from veridex.plans.queries import QUERIES


@pytest.mark.parametrize("name, source", [("proj_alias", "orders"), ("proj_computed", "lineitem"), ("proj_arith", "lineitem"), ("trace_redact_values", "documents")])
def test_every_row(name, source, spark, sf):
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{source}.parquet").count()


def test_redaction_of_other_names(spark, tmp_path):
    spark.createDataFrame([(1, "api_key = abc"), (2, "api_key = xyz"), (3, "bearer: k"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.digest for r in QUERIES["trace_redact_values"](spark, str(tmp_path)).collect()}
    assert set(found) == {1, 2, 3, 4} and found[1] == found[2] != found[3] and found[4] is None


import pyarrow as pa
import pytest

import corpus_pipeline
from veridex.llm import queries


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_each_stage_on_its_own_input(spark, sf):
    from tests.llm.test_line_dedup import brute as lines_left
    from tests.llm.test_ngram_join import brute as groups
    from tests.llm.test_packing import check as packed
    from tests.llm.test_pii import brute as base

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf)
        rows = docs.collect()
        if name == "packing":
            packed(rows, texts)
            break
        assert docs.columns == columns and len({r.doc_id for r in rows}) == len(rows)
        assert all(r.n_chars == len(r.text) for r in rows)
        new = {r.doc_id: r.text for r in rows}
        if name == "quality":
            assert 0.6 * len(texts) < len(new) < len(texts) and all(texts[k] == t for k, t in new.items())
        elif name == "line_dedup":
            assert new == lines_left([(k, t) for k, t in texts.items()], 50)
        elif name == "near_copies":
            assert set(new) == {d for d, _, c in groups(sorted(texts.items())) if d == c}
        else:
            assert set(new) == set(texts) and not any(v for t in new.values() for v in base(t).values())
        texts = new
        docs = spark.createDataFrame(rows, docs.schema)


@pytest.mark.parametrize("name", ["quality", "near_copies", "pii", "packing"])
def test_batches_to_workers_are_bounded(name, spark, sf):
    from veridex.llm.common import BATCH_BYTES

    key, row = "spark.sql.execution.arrow.maxBytesPerBatch", 50_000
    docs = spark.range(100, numPartitions=1).selectExpr("id doc_id", f"repeat('word ', {row // 5}) text", "'s' source", "'en' lang", f"{row} n_chars")

    def sizes():
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "k"])

        return docs.mapInArrow(run, "size long, k long").collect()

    try:
        spark.conf.unset(key)
        assert len(sizes()) == 1
        found = dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), sf)
        assert found.count() == 0
        after = sizes()
        assert max(r.size for r in after) <= BATCH_BYTES + 2 * row and sum(r.k for r in after) == 100
        # a lower bound stays
        spark.conf.set(key, "100k")
        dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), sf)
        assert spark.conf.get(key) == "100k"
    finally:
        spark.conf.unset(key)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() > 50


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(name, spark, sf, duck):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr) == sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)



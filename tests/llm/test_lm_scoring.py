import math
import re
from collections import Counter

import pytest

from tests.llm.conftest import EDGES
from veridex.llm import lm_scoring

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute(rows):
    """Score per row of (text, target), by plain counting; the vocabulary holds every word here."""
    models = []
    vocabulary = {w for text, _ in rows for w in words(text)}
    for only in (True, False):
        used = [words(t) for t, target in rows if target or not only]
        one = Counter(w for ws in used for w in ws)
        two = Counter(p for ws in used for p in zip(["<s>", *ws], ws))
        starts = sum(1 for ws in used if ws)
        total = sum(one.values())

        def loss(h, w, one=one, two=two, starts=starts, total=total):
            p = (one[w] + 1) / (total + len(vocabulary) + 1)
            seen = starts if h == "<s>" else one[h]
            return -math.log((two[h, w] + 50 * p) / (seen + 50))

        models.append(loss)
    out = []
    for text, _ in rows:
        ws = words(text)
        d = [models[0](h, w) - models[1](h, w) for h, w in zip(["<s>", *ws], ws)]
        out.append((len(ws), sum(d) / len(d) if d else None))
    return out


def check(found, want):
    assert [f[0] for f in found] == [w[0] for w in want]
    for f, w in zip(found, want):
        assert (f[1] is None) == (w[1] is None) and (w[1] is None or f[1] == pytest.approx(w[1], abs=2e-5))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    rows = [(r.text, r.doc_id % 3 == 0) for r in docs]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, is_target boolean")
    found = {r.doc_id: (r.n_tokens, r.xent_diff) for r in lm_scoring.score(df).collect()}
    check([found[k] for k in range(len(rows))], brute(rows))


def test_small_chunks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_TOKENS", 7)
    monkeypatch.setattr(lm_scoring, "BUCKET_ENTRIES", 3)
    rows = [(f"a b c{k % 3} A b", k % 2 == 0) for k in range(40)] + [("", True), (None, False)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, is_target boolean")
    found = {r.doc_id: (r.n_tokens, r.xent_diff) for r in lm_scoring.score(df).collect()}
    check([found[k] for k in range(len(rows))], brute(rows))


def test_edges(spark, edges, nothing):
    flagged = edges.selectExpr("*", "cast(null as boolean) as is_target")
    rows = lm_scoring.score(flagged).collect()
    assert sorted((r.doc_id or 0) for r in rows) == sorted(i or 0 for i, _ in EDGES)
    assert all((r.xent_diff is None) == (r.n_tokens == 0) for r in rows)
    assert lm_scoring.score(flagged.limit(0)).count() == 0


def test_the_target_scores_lower(spark):
    rows = [(k, "red green blue red green " * 3 if k % 2 else "one two three four five " * 3) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(1, 20, 2)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.xent_diff for r in lm_scoring.score_against_good(docs, labels).collect()}
    assert max(v for k, v in found.items() if k % 2) < min(v for k, v in found.items() if not k % 2)


def test_every_word_is_kept(spark):
    """More different words than 16 bits can number, rare ones in both kinds of documents."""
    rows = [(" ".join(f"r{k * 1500 + j}" for j in range(1500)) + f" tail{k % 2} r{k}", k % 2 == 0) for k in range(60)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, is_target boolean")
    found = {r.doc_id: (r.n_tokens, r.xent_diff) for r in lm_scoring.score(df).collect()}
    check([found[k] for k in range(len(rows))], brute(rows))


def test_a_text_beyond_four_megabytes(spark):
    import math

    rows = [(1, "a b " * 1_100_000, True), (2, "a c", False), (3, None, None)]
    found = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, is_target boolean")).collect()}
    assert found[1].n_tokens == 2_200_000 and found[2].n_tokens == 2 and found[3].xent_diff is None
    assert math.isfinite(found[1].xent_diff) and found[1].xent_diff < found[2].xent_diff

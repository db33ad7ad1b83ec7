import math
import random

import numpy as np
import pytest

from veridex.llm import impact_search
from veridex.llm.common import stage


def brute(rows, k=5):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, v) in enumerate(good):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for j, (i, w) in enumerate(good) if j != own)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("n, dims, spread", [(400, 6, 1.0), (300, 3, 0.01), (30, 64, 0.2), (3, 2, 1.0), (1, 2, 1.0)])
def test_against_brute_force(spark, n, dims, spread):
    rng = random.Random(n)
    rows = [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(dims)]) for i in range(n)]
    rows += [(1000, None), (1050, [None] * dims), (1100, [float("nan")] * dims), (1150, [float("inf")] * dims), (1200, [0.0] * dims), (None, [0.1] * dims)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, query_id string")
    assert found(impact_search.search_table(df)) == brute(rows)


def test_ties_and_small_blocks(spark):
    rows = [(i, [1.0, -1.0]) for i in range(60)] + [(i, [0.5, 0.25]) for i in range(60, 120)]
    v = stage(impact_search.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), "v")
    assert found(impact_search.top_k(v, v.where("vec_id % 50 = 0"), 5, block_rows=16, query_bytes=40)) == brute(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [-1.0, 0.5]), (1, [1.0, 2.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0])]
    result = found(impact_search.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert result == brute(rows) and len(result) == 15


def test_empty_vectors_take_part(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(impact_search.search_table(frame([(0, []), (1, []), (2, [])]))) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert found(impact_search.search_table(frame([(0, [1.0]), (1, []), (50, [2.0])]))) == [(0, 1, 50, 256 * 512), (0, 2, 1, 0), (50, 1, 0, 256 * 512), (50, 2, 1, 0)]


def test_empty(spark):
    assert impact_search.search_table(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_index_stops_early_and_stays_exact():
    rng = np.random.default_rng(4)
    matrix = rng.integers(-100, 100, (5000, 32))
    matrix[17] = 3000
    index = impact_search.Index(matrix)
    for q in rng.integers(-50, 50, (10, 32)):
        at, scores = index.top(q, 4)
        whole = matrix @ q
        assert at.tolist() == np.lexsort((np.arange(5000), -whole))[:4].tolist() and scores.tolist() == whole[at].tolist()

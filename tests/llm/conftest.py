import pytest

#: doc_id, text of shared edge cases: null, empty, blank, long, repeated rows, a null id.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "no id here at all"), (6, "word " * 5000), (7, "é" * 3000 + " ßharp ✓ 🎉\r\nline")]
EXTRA = "doc_id long, text string, ids string, n long, length int, media string, _low double, cid long, token string, h long, rank int, label string, n_lines int, n_deleted int, p_low double, rejected string, pcm_media binary, rid int, th int, comp int"


@pytest.fixture(scope="session")
def edges(spark):
    """Edge cases with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "m", 0.5, 3, "t", 4, 5, "l", 6, 7, 0.25, "no", None, 8, 9, 10) for i, t in EDGES], EXTRA)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

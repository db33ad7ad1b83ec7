"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors become integers and are dealt into blocks by row; each block's index is built once and stored. In a block
each dimension's postings are cut into segments of one quantised value. For a query, every segment has an impact,
its least gain over the dimension's worst value in the block. Segments of all dimensions are processed by descending
quantised impact, adding lower bounds to accumulators. What is still open is bounded by the next segments' gains; the
loop ends early only when the bounds prove that few rows can be members, and all of those are scored exactly.

Queries go to the stored index in parts of bounded bytes, so no vector is copied or shuffled once per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridex.llm.common import release, stage

#: Rows of a block at most on average, and from which on a table is dealt to all cores.
BLOCK_ROWS, LEAST_ROWS = 16_384, 2_048
#: Bytes of the queries that are sent to all blocks at once.
QUERY_BYTES = 32 << 20
#: Segments of a dimension.
LEVELS = 16
#: The loop may end once so few rows of a block can be members.
POSSIBLE = 256
_CHECK_EVERY = 96


class Index:
    """Impact-ordered postings of one block: ids ascending, and an integer matrix."""

    def __init__(self, matrix: np.ndarray, levels: int = LEVELS):
        self.matrix = matrix
        if not matrix.size:  # vectors without components: every score is 0
            self.low = self.high = np.zeros(matrix.shape[1], np.int64)
            self.rows, self.dims, self.least, self.most = [], *(np.zeros(0, np.int64) for _ in range(3))
            return
        low, high = matrix.min(0), matrix.max(0)
        width = np.maximum(1, -(-(high - low + 1) // levels))
        self.low, self.high = low, high
        self.rows: list[np.ndarray] = []
        dims, least, most = [], [], []
        for d in range(matrix.shape[1]):
            level = (matrix[:, d] - low[d]) // width[d]
            order = np.argsort(level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[order])) + 1
            for part in np.split(order, cuts):
                v = matrix[part, d]
                dims.append(d)
                least.append(v.min())
                most.append(v.max())
                self.rows.append(part)
        self.dims, self.least, self.most = np.array(dims), np.array(least), np.array(most)

    def stored(self) -> tuple[bytes, ...]:
        """The postings as bytes: rows by segment, segment sizes, dimensions, least and most values."""
        rows = np.concatenate([*self.rows, np.zeros(0, np.int64)]).astype("<i4")
        return tuple(a.tobytes() for a in (rows, np.array([len(r) for r in self.rows], "<i4"), self.dims.astype("<i4"), self.least.astype("<i8"), self.most.astype("<i8")))

    @classmethod
    def load(cls, matrix: np.ndarray, parts: tuple[bytes, ...]) -> Index:
        self = cls.__new__(cls)
        self.matrix = matrix
        self.low, self.high = (matrix.min(0), matrix.max(0)) if matrix.size else (np.zeros(matrix.shape[1], np.int64),) * 2
        rows, sizes, self.dims = (np.frombuffer(p, "<i4").astype(np.int64) for p in parts[:3])
        self.rows = np.split(rows, np.cumsum(sizes)[:-1]) if len(sizes) else []
        self.least, self.most = (np.frombuffer(p, "<i8") for p in parts[3:])
        return self

    def top(self, query: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best rows but `own`, ties to the smaller position."""
        n = len(self.matrix)
        q = query[self.dims]
        # gains over the worst value of each dimension: at least `sure`, at most `best`
        worst = np.where(query >= 0, self.low * query, self.high * query)
        one, two = self.least * q, self.most * q
        sure, best = np.minimum(one, two) - worst[self.dims], np.maximum(one, two) - worst[self.dims]
        quantum = max(1, int(best.max(initial=0)) >> 10)
        order = np.argsort(-(best // quantum), kind="stable")
        # how far any row's gain can lie above the sum of its segments' lower bounds
        slack = np.zeros(len(query), np.int64)
        np.maximum.at(slack, self.dims, best - sure)
        left = np.zeros(len(query), np.int64)
        np.maximum.at(left, self.dims, best)
        # after position j of the order, dimension d can still give at most best of its next segment
        gains = np.zeros(n, np.int64)
        want = min(k + (own >= 0), n)
        dims, rows = self.dims[order], self.rows
        nexts = _next_best(dims, best[order], len(query))
        total = int(slack.sum())
        for j, s in enumerate(order):
            gains[rows[s]] += sure[s]
            left[dims[j]] = nexts[j]
            if (j + 1) % _CHECK_EVERY == 0:
                floor = np.partition(gains, n - want)[n - want]
                if np.count_nonzero(gains + total + int(left.sum()) >= floor) <= max(POSSIBLE, want):
                    break
        floor = np.partition(gains, n - want)[n - want] if want else 0
        members = np.flatnonzero(gains + total + int(left.sum()) >= floor)
        members = members[members != own]
        scores = self.matrix[members] @ query
        chosen = np.lexsort((members, -scores))[:k]
        return members[chosen], scores[chosen]


def _next_best(dims: np.ndarray, best: np.ndarray, n: int) -> np.ndarray:
    """For each place of the order the most that its dimension can give later."""
    out, later = np.zeros(len(dims), np.int64), np.zeros(n, np.int64)
    for j in range(len(dims) - 1, -1, -1):
        out[j] = later[dims[j]]
        later[dims[j]] = max(later[dims[j]], best[j])
    return out


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """rid, which names the row, vec_id and v, floor(scale * x) of every component; rows that are null or hold null or non-finite values are left out.

    rid follows the partitions, so the result must be written before it is used twice. Other columns are not read.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~bad).select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        row = np.asarray(v.values)
        out[i, : len(row)] = row
    return out


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """One stored row per block (ids, rids, matrix, postings), and the width of the matrix.

    vectors: rid, which names the row, vec_id and v. Rows are dealt by a hash of rid, so that equal ids or vectors are
    no hot block; there are as many blocks as cores unless that makes them tiny.
    """
    size = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    rows, width = size[0], size[1] or 0
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-rows // block_rows), min(cores, rows // min(LEAST_ROWS, block_rows)))

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["vec_id", "rid"])
        matrix = _matrix(pa.array(block["v"], pa.list_(pa.int64())), width)
        parts = Index(matrix).stored()
        one = [block["vec_id"].to_numpy(np.int64).tobytes(), block["rid"].to_numpy(np.int64).tobytes(), matrix.astype("<i8").tobytes(), *parts]
        return pd.DataFrame([one], columns=columns)

    columns = ["ids", "rids", "matrix", "rows", "sizes", "dims", "least", "most"]
    dealt = vectors.withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    index = dealt.groupBy("_b").applyInPandas(lambda block: build(block), ", ".join(f"{c} binary" for c in columns))
    return stage(index.repartition(blocks), "index"), width


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of queries the k rows of vectors with the largest integer inner product.

    vectors and queries hold rid, vec_id and v (see integers); a query's own row, the one with its rid, is no
    candidate, other rows with its vec_id are. Ties go to the smaller vec_id. Repeated ids among the queries are
    rankings of their own, repeated rows candidates of their own. Vectors of different lengths are compared over the
    longer, zeros added; without components all scores are 0. Queries with fewer than k candidates return all; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    index, width = build_index(vectors, block_rows)
    asked = queries.count()
    parts = max(1, math.ceil(asked * (8 * width + 16) / query_bytes))
    dealt = stage(queries.select("rid", "vec_id", "v", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int").alias("_q")), "queries")
    found = []
    for part in range(parts):
        some = dealt.where(F.col("_q") == part).toArrow()  # about query_bytes
        shared = spark.sparkContext.broadcast((some["rid"].to_numpy(), some["vec_id"].to_numpy(), _matrix(some["v"].combine_chunks(), width)))

        def search(batches, shared=shared):
            rids, query_ids, asked = shared.value
            for batch in batches:
                for block in zip(*batch.columns):
                    block = [x.as_py() for x in block]
                    ids, own = (np.frombuffer(x, np.int64) for x in block[:2])
                    one = Index.load(np.frombuffer(block[2], "<i8").reshape(len(ids), width), tuple(block[3:]))
                    mine = dict(zip(own.tolist(), range(len(own))))
                    best: list[list[np.ndarray]] = [[], [], [], []]
                    for rid, query_id, query in zip(rids.tolist(), query_ids.tolist(), asked):
                        at, scores = one.top(query, k, mine.get(rid, -1))
                        for column, values in zip(best, (np.full(len(at), rid), np.full(len(at), query_id), ids[at], scores)):
                            column.append(values)
                    if best[0]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in best], ["rid", "query_id", "vec_id", "score"])

        found.append(stage(index.mapInArrow(search, "rid long, query_id long, vec_id long, score long"), "found"))
        shared.destroy()
    release(index, dealt)
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The stated query set (ids divisible by `every`) against all rows. Null ids and vectors take no part, empty vectors do."""
    whole = stage(integers(vectors), "integers")
    return top_k(whole, whole.where(F.col("vec_id") % every == 0), k)

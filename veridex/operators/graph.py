"""Queries over graphs kept as two DataFrames: nodes(id, label, ...) and edges(src, dst, label, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("label").agg(F.count("*").alias("n"))


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.select("label").distinct()


def catalog(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, label, n, properties (sorted names) and, for edges, the labels of their ends."""
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("properties"))))).alias("properties")
    of_nodes = nodes.groupBy("label").agg(F.count("*").alias("n"), keys).select(F.lit("node").alias("kind"), "label", "n", "properties", F.lit(None).cast("string").alias("src_label"), F.lit(None).cast("string").alias("dst_label"))
    ends = edges.withColumn("src_label", F.split_part("src", F.lit(":"), F.lit(1))).withColumn("dst_label", F.split_part("dst", F.lit(":"), F.lit(1)))
    of_edges = ends.groupBy("label", "src_label", "dst_label").agg(F.count("*").alias("n"), keys).select(F.lit("edge").alias("kind"), "label", "n", "properties", "src_label", "dst_label")
    return of_nodes.union(of_edges)


def scan(nodes: DataFrame, label: str, where: str | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Nodes of a label. where may use property names as properties['name']."""
    out = nodes.where(F.col("label") == label)
    out = out.where(where) if where else out
    out = out.select("id", *[F.col("properties")[c].alias(c) for c in columns]) if columns is not None else out
    return out.limit(limit) if limit is not None else out


def lookup(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.where(F.col("id") == id_)


def neighbours(edges: DataFrame, id_: str) -> DataFrame:
    """direction, label, other, properties of every edge of one node."""
    out = edges.where(F.col("src") == id_).select(F.lit("out").alias("direction"), "label", F.col("dst").alias("other"), "properties")
    return out.union(edges.where(F.col("dst") == id_).select(F.lit("in").alias("direction"), "label", F.col("src").alias("other"), "properties"))


def hop(frame: DataFrame, edges: DataFrame, at: str, to: str, label: str, forward: bool = True) -> DataFrame:
    """frame joined over edges of a label: from the ids in column `at` to their neighbours, in column `to`."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = edges.where(F.col("label") == label).select(F.col(a).alias(at), F.col(b).alias(to))
    return frame.join(step, at)


def degree(edges: DataFrame) -> DataFrame:
    """id, n_out, n_in of every node with an edge; summed in one pass."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def common_neighbours(links: DataFrame, left: str, over: str, at_least: int = 1) -> DataFrame:
    """a, b, n: pairs of `left` ids that share at least so many `over` ids. links has both columns.

    The pairs are the result itself, so a hub of `over` has as many as its square: filter hubs before.
    """
    pairs = links.select(left, over).distinct()
    x, y = pairs.withColumnRenamed(left, "a"), pairs.withColumnRenamed(left, "b")
    return x.join(y, over).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def only_one(links: DataFrame, left: str, over: str, at_least: int = 2) -> DataFrame:
    """`left` ids with several links that all lead to one `over` id."""
    return links.groupBy(left).agg(F.count("*").alias("n"), F.min(over).alias("low"), F.max(over).alias("high")).where((F.col("low") == F.col("high")) & (F.col("n") >= at_least)).select(left, F.col("low").alias(over), "n")

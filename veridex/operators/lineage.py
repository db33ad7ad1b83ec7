"""Metric lineage: datasets, dimensions, physical fields and metrics of a model as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veridex.plans.engine import Engine
from veridex.plans.errors import GraphError
from veridex.plans.scopes import Reader, kind
from veridex.sources import files

NODES = "id string, label string, name string, properties map<string,string>"
EDGES = "src string, dst string, label string, properties map<string,string>"


def field_columns(engine: Engine, expression: str) -> list[str]:
    """The physical columns of a field's expression, each once."""
    found: list[str] = []

    def walk(e):
        if kind(e) == "UnresolvedAttribute":
            found.append(Reader._ref(e).name)
        for i in range(e.children().size()):
            walk(e.children().apply(i))

    walk(engine._parser.parseExpression(expression))
    return list(dict.fromkeys(found))


def build(engine: Engine) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). LogicalDataset MAPS_TO Dimension and PhysicalField, JOINS_TO LogicalDataset; Metric AGGREGATES_FROM
    PhysicalField, DERIVED_FROM LogicalDataset, SLICES_BY every Dimension of its datasets."""
    model, spark = engine.model, engine.spark
    nodes: dict[str, tuple] = {}
    edges: dict[tuple, tuple] = {}

    def node(id_, label, name, /, **properties):
        nodes.setdefault(id_, (id_, label, name, {k: str(v) for k, v in properties.items() if v}))

    def edge(src, dst, label, /, **properties):
        edges.setdefault((src, dst, label, tuple(sorted(properties.items()))), (src, dst, label, {k: str(v) for k, v in properties.items()}))

    def physical(dataset, column):
        id_ = f"field:{dataset.source}.{column}"
        node(id_, "PhysicalField", column, name=column, dataset=dataset.name)
        return id_

    for d in model.datasets:
        node(f"dataset:{d.name}", "LogicalDataset", d.name, name=d.name, source=d.source, primary_key=",".join(d.primary_key))
        for f in d.fields:
            if f.is_dimension:
                owner = f"dim:{d.name}.{f.name}"
                node(owner, "Dimension", f.name, name=f.name, is_time=str(f.is_time).lower(), dataset=d.name)
                edge(f"dataset:{d.name}", owner, "MAPS_TO", logical_name=f.name, is_dimension="true")
            for column in field_columns(engine, f.expression.sql):
                edge(f"dataset:{d.name}", physical(d, column), "MAPS_TO", logical_name=f.name)
    for r in model.relationships:
        on = ", ".join(f"{a}={b}" for a, b in zip(r.many_columns, r.one_columns))
        edge(f"dataset:{r.many}", f"dataset:{r.one}", "JOINS_TO", on=on, relationship=r.name)
    for m in model.metrics:
        id_ = f"metric:{m.name}"
        node(id_, "Metric", m.name, name=m.name, expression=m.expression.sql, description=m.description or "")
        for ref in engine._columns(m):
            dataset, name = engine._owner(ref, m)
            for column in field_columns(engine, dataset.get(name).expression.sql):
                edge(id_, physical(dataset, column), "AGGREGATES_FROM")
        for name in sorted(engine.datasets_of(m.name)):
            edge(id_, f"dataset:{name}", "DERIVED_FROM")
            for f in model.get(name).fields:
                if f.is_dimension:
                    edge(id_, f"dim:{name}.{f.name}", "SLICES_BY")
    return spark.createDataFrame(list(nodes.values()), NODES), spark.createDataFrame(list(edges.values()), EDGES)


def problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem, id: dangling edge ends, metrics without a physical field, and nodes without any edge."""
    ends = edges.selectExpr("src as id").union(edges.selectExpr("dst as id")).distinct()
    dangling = ends.join(nodes, "id", "left_anti").selectExpr("'dangling' as problem", "id")
    sourced = edges.where("label = 'AGGREGATES_FROM'").selectExpr("src as id")
    lone = nodes.where("label = 'Metric'").join(sourced, "id", "left_anti").selectExpr("'metric without source' as problem", "id")
    orphans = nodes.join(ends, "id", "left_anti").selectExpr("'orphan' as problem", "id")
    return dangling.union(lone).union(orphans)


def load(engine: Engine, path: str) -> tuple[DataFrame, DataFrame]:
    """Builds, validates and stores the lineage graph, and reads it back. A graph with problems is refused and nothing is stored."""
    nodes, edges = build(engine)
    found = problems(nodes, edges).limit(5).collect()
    if found:
        raise GraphError("; ".join(f"{r.problem}: {r.id}" for r in found))
    files.save_graph(nodes, edges, path)
    return files.load_graph(engine.spark, path)

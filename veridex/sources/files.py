"""Sources and sinks: files as tables, samples, schema scans, models made from schemas, stored graphs and traces."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, MapType, StringType, StructType, TimestampNTZType, TimestampType

from veridex.plans.errors import SemanticError
from veridex.plans.model import Dataset, Field, Expression, Relationship, SemanticModel


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A CSV file with a header; empty cells are null. Types come from the schema, or from all rows if there is none."""
    reader = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema=None, flat: bool = True) -> DataFrame:
    """A JSON file, one object or an array of objects; where flat, nested values become JSON text."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    return nested_as_text(df) if flat else df


def nested_as_text(df: DataFrame) -> DataFrame:
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text columns become bigint, else double, if all their non-null values are; in one pass over the rows."""
    columns = columns or [c for c, t in df.dtypes if t == "string"]
    if not columns:
        return df
    tests = []
    for c in columns:
        v = F.trim(F.col(f"`{c}`"))
        tests += [F.bool_and(v.isNull() | v.rlike(r"^[+-]?\d{1,18}$")).alias(f"i_{c}"), F.bool_and(v.isNull() | v.try_cast("double").isNotNull()).alias(f"d_{c}"), F.count(v).alias(f"n_{c}")]
    seen = df.agg(*tests).first()
    kinds = {c: "bigint" if seen[f"i_{c}"] else "double" for c in columns if seen[f"n_{c}"] and seen[f"d_{c}"]}
    return df.select(*[F.trim(F.col(f"`{c}`")).cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])


class Sources:
    """Names bound to DataFrames: what an engine takes as sources. kinds: parquet, orc, csv, json, table, sql."""

    def __init__(self, spark: SparkSession):
        self.spark, self._found = spark, {}

    def add(self, name: str, kind: str, where: str, **options) -> Sources:
        readers = {
            "parquet": lambda: self.spark.read.parquet(where), "orc": lambda: self.spark.read.orc(where), "csv": lambda: read_csv(self.spark, where, **options),
            "json": lambda: read_json(self.spark, where, **options), "table": lambda: self.spark.table(where), "sql": lambda: self.spark.sql(where),
        }
        if kind not in readers:
            raise SemanticError(f"no source kind {kind}; there are {', '.join(readers)}")
        self._found[name] = readers[kind]
        return self

    def __call__(self, name: str) -> DataFrame:
        if name not in self._found:
            raise SemanticError(f"no source {name}; there are {', '.join(self._found)}")
        return self._found[name]()

    def names(self) -> list[str]:
        return list(self._found)


@dataclass(frozen=True)
class ColumnInfo:
    table: str
    column: str
    type: str
    nullable: bool


def schema_scan(sources: Sources) -> list[ColumnInfo]:
    """Every column of every source with its real type; no rows are read."""
    return [ColumnInfo(n, f.name, f.dataType.simpleString(), f.nullable) for n in sources.names() for f in sources(n).schema.fields]


def model_from_schema(name: str, sources: Sources, keys: dict[str, list[str]] | None = None) -> SemanticModel:
    """A model with a dataset per source. Text, date and boolean columns that are no key are dimensions; x_id refers to x or xs, by its key."""
    keys = keys or {}
    datasets, relationships = [], []
    for table in sources.names():
        fields = []
        for f in sources(table).schema.fields:
            is_time = isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))
            is_dimension = f.name not in keys.get(table, []) and (is_time or isinstance(f.dataType, (StringType, BooleanType)))
            fields.append(Field(f.name, Expression.parse(f.name if f.name.isidentifier() else f"`{f.name}`"), is_dimension, is_dimension and is_time))
            if f.name.lower().endswith("_id"):
                stem = f.name[:-3].lower()
                parent = next((t for t in sources.names() if t.lower() in (stem, stem + "s") and t != table and len(keys.get(t, [])) == 1), None)
                if parent:
                    relationships.append(Relationship(f"{table}_{f.name}_{parent}", table, parent, (f.name,), (keys[parent][0],)))
        datasets.append(Dataset(table, table, tuple(fields), tuple(keys.get(table, []))))
    return SemanticModel(name, tuple(datasets), tuple(relationships))


def sample(engine, datasets: list[str], n: int = 3) -> dict[str, list[dict]]:
    """The first n rows of each dataset under logical names; a dataset that can't be read has none."""
    out = {}
    for name in datasets:
        try:
            out[name] = [r.asDict() for r in engine.dataset(name).limit(n).collect()]
        except Exception:  # a broken source must not hide the others
            out[name] = []
    return out


def sample_text(samples: dict[str, list[dict]]) -> str:
    """Samples as text: a heading per dataset, then its rows."""
    return "\n\n".join(f"{name}\n" + ("\n".join("  " + ", ".join(f"{k}={v}" for k, v in r.items()) for r in rows) or "  no rows") for name, rows in samples.items())


# --- graphs and traces -----------------------------------------------------------------


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replaces a stored graph: nodes(id, label, properties), edges(src, dst, label, properties), partitioned by label."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("label").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """A stored graph, None if there is none yet."""
    if not (exists(spark, f"{path}/nodes/_SUCCESS") and exists(spark, f"{path}/edges/_SUCCESS")):
        return None
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def graph_or_build(spark: SparkSession, path: str, build) -> tuple[DataFrame, DataFrame]:
    """The stored graph, or the built one after storing it."""
    found = load_graph(spark, path)
    if found is None:
        save_graph(*build(), path)
        found = load_graph(spark, path)
    return found


def save_sidecar(path: str, data: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, indent=2)


def load_sidecar(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def append_trace(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def first_scored(rows: DataFrame, task: str = "task_id", score: str = "score", order: str = "position") -> DataFrame:
    """The first row of each task whose score is true. One aggregate with partial minima, so a task with all rows is no hot key."""
    good = rows.where(F.col(score).cast("string").isin("true", "1"))
    return good.groupBy(task).agg(F.min_by(F.struct(*good.columns), order).alias("_r")).select("_r.*")


def choose_tasks(tasks: DataFrame, level: str | None = None, ids: list | None = None, at_most: int | None = None) -> DataFrame:
    """Tasks of a level or with given ids, the first of them by id."""
    out = tasks
    if level is not None:
        out = out.where(F.lower("level") == level.lower())
    if ids is not None:
        out = out.where(F.col("task_id").isin(list(ids)))
    return out.orderBy("task_id").limit(at_most) if at_most is not None else out

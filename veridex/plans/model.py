"""The semantic model: datasets, fields, relationships and metrics, declared in YAML or JSON and really validated."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path

import yaml

from veridex.plans.errors import ModelError

VERSION = "0.1.1"


class Dialect(str, Enum):
    ANSI_SQL = "ANSI_SQL"
    SNOWFLAKE = "SNOWFLAKE"
    MDX = "MDX"
    TABLEAU = "TABLEAU"
    DATABRICKS = "DATABRICKS"


#: Dialects whose text Spark can run, best first; MDX and TABLEAU can't be executed.
_EXECUTABLE = (Dialect.DATABRICKS, Dialect.ANSI_SQL, Dialect.SNOWFLAKE)


def _only(data: dict, allowed: set[str], where: str) -> None:
    if not isinstance(data, dict):
        raise ModelError(f"{where} must be a mapping")
    if extra := set(data) - allowed:
        raise ModelError(f"{where}: unknown keys {', '.join(sorted(extra))}")


def _unique(names: list[str], what: str) -> None:
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ModelError(f"duplicate {what}: {', '.join(twice)}")


@dataclass(frozen=True)
class AIContext:
    """Hints for people and assistants; keys beyond the usual ones are kept."""

    instructions: str | None = None
    synonyms: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, hash=False)

    @staticmethod
    def parse(data) -> AIContext | None:
        if data is None or isinstance(data, AIContext):
            return data
        if isinstance(data, str):
            return AIContext(instructions=data)
        rest = {k: v for k, v in data.items() if k not in ("instructions", "synonyms", "examples")}
        return AIContext(data.get("instructions"), tuple(data.get("synonyms") or ()), tuple(data.get("examples") or ()), rest)

    def to_dict(self) -> dict:
        return {k: v for k, v in {"instructions": self.instructions, "synonyms": list(self.synonyms), "examples": list(self.examples)}.items() if v} | self.extra


@dataclass(frozen=True)
class Extension:
    """A vendor's own data, kept as the JSON text it came in."""

    vendor: str
    data: str

    def __post_init__(self):
        try:
            json.loads(self.data)
        except (TypeError, ValueError) as error:
            raise ModelError(f"extension of {self.vendor}: data isn't JSON") from error


@dataclass(frozen=True)
class Expression:
    """One text per dialect."""

    texts: tuple[tuple[Dialect, str], ...]

    @staticmethod
    def parse(data) -> Expression:
        if isinstance(data, Expression):
            return data
        if isinstance(data, str):
            return Expression(((Dialect.ANSI_SQL, data),))
        if isinstance(data, dict) and "dialects" in data:
            data = {d["dialect"]: d["expression"] for d in data["dialects"]}
        if not data:
            raise ModelError("an expression needs at least one dialect")
        try:
            return Expression(tuple((Dialect(d), t) for d, t in data.items()))
        except ValueError as error:
            raise ModelError(str(error)) from error

    @property
    def sql(self) -> str:
        """The text for Spark. REAL is an 8-byte number in the model's language, so it becomes DOUBLE."""
        known = dict(self.texts)
        text = next((known[d] for d in _EXECUTABLE if d in known), self.texts[0][1])
        return re.sub(r"(?i)\bAS\s+REAL\b", "AS DOUBLE", text)

    def to_dict(self) -> dict:
        return {"dialects": [{"dialect": d.value, "expression": t} for d, t in self.texts]}


@dataclass(frozen=True)
class Field:
    name: str
    expression: Expression
    is_dimension: bool = False
    is_time: bool = False
    label: str | None = None
    description: str | None = None
    ai_context: AIContext | None = None

    @property
    def is_computed(self) -> bool:
        return re.fullmatch(r"[A-Za-z_]\w*|`[^`]+`", self.expression.sql.strip()) is None

    @property
    def column(self) -> str | None:
        """The physical column, if the expression is one."""
        return None if self.is_computed else self.expression.sql.strip().strip("`")

    @staticmethod
    def parse(data) -> Field:
        if isinstance(data, Field):
            return data
        _only(data, {"name", "expression", "dimension", "label", "description", "ai_context", "custom_extensions"}, "field")
        dimension = data.get("dimension")
        return Field(
            data["name"], Expression.parse(data.get("expression", data["name"])), dimension is not None, bool((dimension or {}).get("is_time")),
            data.get("label"), data.get("description"), AIContext.parse(data.get("ai_context")),
        )

    def to_dict(self) -> dict:
        out: dict = {"name": self.name, "expression": self.expression.to_dict()}
        if self.is_dimension:
            out["dimension"] = {"is_time": self.is_time}
        for key in ("label", "description"):
            if getattr(self, key):
                out[key] = getattr(self, key)
        return out | ({"ai_context": self.ai_context.to_dict()} if self.ai_context else {})


def plain(name: str, expression: str | None = None, **more) -> Field:
    return Field(name, Expression.parse(expression or name), **more)


def dimension(name: str, expression: str | None = None, **more) -> Field:
    return Field(name, Expression.parse(expression or name), is_dimension=True, **more)


def time_dimension(name: str, expression: str | None = None, **more) -> Field:
    return Field(name, Expression.parse(expression or name), is_dimension=True, is_time=True, **more)


@dataclass(frozen=True)
class Dataset:
    name: str
    source: str
    fields: tuple[Field, ...]
    primary_key: tuple[str, ...] = ()
    unique_keys: tuple[tuple[str, ...], ...] = ()
    description: str | None = None
    ai_context: AIContext | None = None

    def __post_init__(self):
        _unique([f.name for f in self.fields], f"field of {self.name}")

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name.lower() == name.lower()), None)

    def by_column(self, column: str) -> Field | None:
        return next((f for f in self.fields if (f.column or "").lower() == column.lower()), None)

    @staticmethod
    def parse(data) -> Dataset:
        if isinstance(data, Dataset):
            return data
        _only(data, {"name", "source", "primary_key", "unique_keys", "fields", "description", "ai_context", "custom_extensions"}, "dataset")
        return Dataset(
            data["name"], data["source"], tuple(Field.parse(f) for f in data.get("fields") or ()), tuple(data.get("primary_key") or ()),
            tuple(tuple(k) for k in data.get("unique_keys") or ()), data.get("description"), AIContext.parse(data.get("ai_context")),
        )

    def to_dict(self) -> dict:
        out: dict = {"name": self.name, "source": self.source, "primary_key": list(self.primary_key), "fields": [f.to_dict() for f in self.fields]}
        if self.unique_keys:
            out["unique_keys"] = [list(k) for k in self.unique_keys]
        if self.description:
            out["description"] = self.description
        return out | ({"ai_context": self.ai_context.to_dict()} if self.ai_context else {})


@dataclass(frozen=True)
class Relationship:
    """Many rows of one dataset to one of another, by pairs of columns."""

    name: str
    many: str
    one: str
    many_columns: tuple[str, ...]
    one_columns: tuple[str, ...]

    def __post_init__(self):
        if not self.many_columns or len(self.many_columns) != len(self.one_columns):
            raise ModelError(f"relationship {self.name}: both sides need the same number of columns")

    @staticmethod
    def parse(data) -> Relationship:
        if isinstance(data, Relationship):
            return data
        _only(data, {"name", "from", "to", "from_columns", "to_columns", "ai_context", "custom_extensions"}, "relationship")
        return Relationship(data["name"], data["from"], data["to"], tuple(data["from_columns"]), tuple(data["to_columns"]))

    def to_dict(self) -> dict:
        return {"name": self.name, "from": self.many, "to": self.one, "from_columns": list(self.many_columns), "to_columns": list(self.one_columns)}


@dataclass(frozen=True)
class Metric:
    name: str
    expression: Expression
    description: str | None = None
    ai_context: AIContext | None = None

    @staticmethod
    def parse(data) -> Metric:
        if isinstance(data, Metric):
            return data
        _only(data, {"name", "expression", "description", "ai_context", "custom_extensions"}, "metric")
        return Metric(data["name"], Expression.parse(data["expression"]), data.get("description"), AIContext.parse(data.get("ai_context")))

    def to_dict(self) -> dict:
        out: dict = {"name": self.name, "expression": self.expression.to_dict()}
        if self.description:
            out["description"] = self.description
        return out | ({"ai_context": self.ai_context.to_dict()} if self.ai_context else {})


@dataclass(frozen=True)
class SemanticModel:
    name: str
    datasets: tuple[Dataset, ...]
    relationships: tuple[Relationship, ...] = ()
    metrics: tuple[Metric, ...] = ()
    description: str | None = None
    ai_context: AIContext | None = None
    extensions: tuple[Extension, ...] = ()

    def __post_init__(self):
        if not self.datasets:
            raise ModelError("a model needs at least one dataset")
        _unique([d.name for d in self.datasets], "dataset")
        _unique([m.name for m in self.metrics], "metric")
        _unique([r.name for r in self.relationships], "relationship")
        for r in self.relationships:
            for end in (r.many, r.one):
                if self.get(end) is None:
                    raise ModelError(f"relationship {r.name}: no dataset {end}")

    def get(self, name: str) -> Dataset | None:
        return next((d for d in self.datasets if d.name.lower() == name.lower()), None)

    def metric(self, name: str) -> Metric | None:
        return next((m for m in self.metrics if m.name.lower() == name.lower()), None)

    @staticmethod
    def parse(data) -> SemanticModel:
        if isinstance(data, SemanticModel):
            return data
        _only(data, {"name", "description", "ai_context", "datasets", "relationships", "metrics", "custom_extensions"}, "model")
        try:
            return SemanticModel(
                data["name"], tuple(Dataset.parse(d) for d in data.get("datasets") or ()), tuple(Relationship.parse(r) for r in data.get("relationships") or ()),
                tuple(Metric.parse(m) for m in data.get("metrics") or ()), data.get("description"), AIContext.parse(data.get("ai_context")),
                tuple(Extension(x["vendor_name"], x["data"]) for x in data.get("custom_extensions") or ()),
            )
        except KeyError as error:
            raise ModelError(f"missing key {error}") from error

    def to_dict(self) -> dict:
        out: dict = {"name": self.name, "datasets": [d.to_dict() for d in self.datasets], "relationships": [r.to_dict() for r in self.relationships], "metrics": [m.to_dict() for m in self.metrics]}
        if self.description:
            out["description"] = self.description
        if self.extensions:
            out["custom_extensions"] = [{"vendor_name": x.vendor, "data": x.data} for x in self.extensions]
        return out | ({"ai_context": self.ai_context.to_dict()} if self.ai_context else {})


@dataclass(frozen=True)
class Specification:
    """The root of a model file."""

    models: tuple[SemanticModel, ...]
    dialects: tuple[str, ...] = ()
    vendors: tuple[str, ...] = ()

    @staticmethod
    def parse(data: dict) -> Specification:
        _only(data, {"version", "dialects", "vendors", "semantic_model"}, "specification")
        if data.get("version") != VERSION:
            raise ModelError(f"version must be {VERSION}")
        return Specification(tuple(SemanticModel.parse(m) for m in data.get("semantic_model") or ()), tuple(data.get("dialects") or ()), tuple(data.get("vendors") or ()))

    def to_dict(self) -> dict:
        out: dict = {"version": VERSION}
        if self.dialects:
            out["dialects"] = list(self.dialects)
        if self.vendors:
            out["vendors"] = list(self.vendors)
        return out | {"semantic_model": [m.to_dict() for m in self.models]}

    @staticmethod
    def load(path: str | Path) -> Specification:
        text = Path(path).read_text(encoding="utf-8")
        return Specification.parse(json.loads(text) if str(path).endswith(".json") else yaml.safe_load(text))

    def save(self, path: str | Path) -> None:
        data = self.to_dict()
        Path(path).write_text(json.dumps(data, indent=2) if str(path).endswith(".json") else yaml.safe_dump(data, sort_keys=False, allow_unicode=True), encoding="utf-8")


def resolve_model(model: SemanticModel | Specification | str | Path) -> SemanticModel:
    """A model as it is, the first of a specification or of a file, or that of a directory's first *.yaml by name."""
    if isinstance(model, SemanticModel):
        return model
    if isinstance(model, Specification):
        spec = model
    else:
        path = Path(model)
        if path.is_dir():
            found = sorted([*path.glob("*.yaml"), *path.glob("*.yml")])
            if not found:
                raise ModelError(f"no *.yaml in {path}")
            path = found[0]
        spec = Specification.load(path)
    if not spec.models:
        raise ModelError("the specification has no model")
    return spec.models[0]

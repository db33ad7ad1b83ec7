"""Entity graphs: a declared mapping of tables to typed nodes and edges, compiled to DataFrames.

Ids are Label:key, a composite key joined by a bar. Null keys make no node and no edge.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FractionalType, IntegralType

from veridex.plans.errors import GraphError


@dataclass(frozen=True)
class EntityType:
    """kind: strong, weak (needs a parent) or event."""

    label: str
    kind: str = "strong"
    parent: str | None = None


@dataclass(frozen=True)
class RelationType:
    label: str
    src: str
    dst: str


@dataclass(frozen=True)
class Schema:
    entities: tuple[EntityType, ...]
    relations: tuple[RelationType, ...] = ()

    def to_dict(self) -> dict:
        return {"entities": [vars(e) for e in self.entities], "relations": [vars(r) for r in self.relations]}

    @staticmethod
    def from_dict(data: dict) -> Schema:
        return Schema(tuple(EntityType(**e) for e in data["entities"]), tuple(RelationType(**r) for r in data["relations"]))

    def problems(self) -> list[str]:
        labels = [e.label for e in self.entities]
        out = [f"label {x} may hold letters, digits and underscores only" for x in [*labels, *(r.label for r in self.relations)] if not re.fullmatch(r"[A-Za-z_]\w*", x)]
        out += [f"duplicate entity {x}" for x in sorted({x for x in labels if labels.count(x) > 1})]
        out += [f"{e.label} is weak and needs a parent among the entities" for e in self.entities if e.kind == "weak" and e.parent not in labels]
        keys = [(r.label, r.src, r.dst) for r in self.relations]
        out += [f"duplicate relation {'-'.join(k)}" for k in sorted({k for k in keys if keys.count(k) > 1})]
        out += [f"relation {r.label}: no entity {x}" for r in self.relations for x in (r.src, r.dst) if x not in labels]
        return out + [f"{x} names an entity and a relation" for x in sorted(set(labels) & {r.label for r in self.relations})]


@dataclass(frozen=True)
class Join:
    left: str
    right: str
    on: tuple[tuple[str, str], ...]
    how: str = "inner"


@dataclass(frozen=True)
class Parent:
    """The strong parent of a weak entity, by this table's key columns."""

    label: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class NodeMapping:
    """tables: one, or several to unite; join: two tables joined instead. properties: name -> column, expression, or ${column} text. parents: further strong parents."""

    label: str
    key: tuple[str, ...]
    tables: tuple[str, ...] = ()
    join: Join | None = None
    properties: dict[str, str] = field(default_factory=dict, hash=False)
    parent: Parent | None = None
    parents: tuple[Parent, ...] = ()

    def strong(self) -> tuple[Parent, ...]:
        return (*([self.parent] if self.parent else []), *self.parents)


@dataclass(frozen=True)
class Route:
    """One of several edges that a row makes; role: the value of the mapping's role column that it is for, None for every row."""

    label: str
    src: str
    src_columns: tuple[str, ...]
    dst: str
    dst_columns: tuple[str, ...]
    role: str | None = None


@dataclass(frozen=True)
class EdgeMapping:
    """src_columns and dst_columns hold the ends' keys in the table; condition is a predicate, where ${column} means the column.

    With routes a row, such as an event, makes an edge for each route whose role is the row's; the mapping's own ends
    are one of them, unless it has a role column.
    """

    label: str
    table: str
    src: str
    src_columns: tuple[str, ...]
    dst: str
    dst_columns: tuple[str, ...]
    condition: str | None = None
    properties: dict[str, str] = field(default_factory=dict, hash=False)
    routes: tuple[Route, ...] = ()
    role_column: str | None = None

    def all_routes(self) -> tuple[Route, ...]:
        own = () if self.role_column else (Route(self.label, self.src, self.src_columns, self.dst, self.dst_columns),)
        return (*own, *self.routes)


@dataclass(frozen=True)
class Mapping:
    nodes: tuple[NodeMapping, ...]
    edges: tuple[EdgeMapping, ...] = ()

    def merged(self, other: Mapping) -> Mapping:
        """Both mappings; of node mappings with one label, and of edges with one label and ends, the other's wins."""
        nodes = {n.label: n for n in (*self.nodes, *other.nodes)}
        edges = {(e.label, e.src, e.dst): e for e in (*self.edges, *other.edges)}
        return Mapping(tuple(nodes.values()), tuple(edges.values()))

    def without(self, path: str) -> Mapping:
        """Without nodes/<label> or edges/<label>."""
        what, _, label = path.partition("/")
        return Mapping(tuple(n for n in self.nodes if what != "nodes" or n.label != label), tuple(e for e in self.edges if what != "edges" or e.label != label))

    def problems(self, schema: Schema, tables: dict[str, list[str]], keys: dict[str, list[str]] | None = None, partial: bool = False) -> list[str]:
        """tables: name -> columns; keys: name -> primary key. A partial mapping needn't cover the schema or have edges yet."""
        mapped, out = {n.label: n for n in self.nodes}, []
        if not partial:
            out += [f"entity {e.label} isn't mapped" for e in schema.entities if e.label not in mapped]
            out += [f"relation {r.label} isn't mapped" for r in schema.relations if (r.label, r.src, r.dst) not in {(e.label, e.src, e.dst) for e in self.edges}]
        for n in self.nodes:
            named = n.tables or ((n.join.left, n.join.right) if n.join else ())
            out += [f"{n.label}: no table {t}" for t in named if t not in tables]
            for t in n.tables:
                out += [f"{n.label}: {t} has no column {c}" for c in n.key if t in tables and c not in tables[t]]
                if keys and len(n.tables) == 1 and keys.get(t) and list(n.key) != list(keys[t]):
                    out.append(f"{n.label}: key {','.join(n.key)} isn't the primary key of {t}")
            kind = next((e for e in schema.entities if e.label == n.label), None)
            if kind and kind.kind == "weak" and not n.strong():
                out.append(f"{n.label} is weak and maps no parent")
            out += [f"{n.label}: parent {p.label} isn't mapped" for p in n.strong() if p.label not in mapped]
        if not partial:
            for e in self.edges:
                out += [f"{e.label}: no table {e.table}" for _ in [0] if e.table not in tables]
                out += [f"{e.label}: {x} isn't mapped" for r in e.all_routes() for x in (r.src, r.dst) if x not in mapped]
        return out


class Compiler:
    """Compiles a mapping over tables, given by a function of their names. engine resolves logical names where the table is a dataset."""

    def __init__(self, mapping: Mapping, table, engine=None):
        self.mapping, self._table, self.engine = mapping, table, engine

    def table(self, name: str) -> DataFrame:
        return self.engine.dataset(name) if self.engine is not None and self.engine.model.get(name) else self._table(name)

    def rows(self, n: NodeMapping) -> DataFrame:
        if n.join is not None:
            left, right = self.table(n.join.left).alias("l"), self.table(n.join.right).alias("r")
            joined = left.join(right, [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in n.join.on], n.join.how)
            taken = set(self.table(n.join.left).columns)
            return joined.select("l.*", *[F.col(f"r.{c}") for c in self.table(n.join.right).columns if c not in taken])
        if not n.tables:
            raise GraphError(f"{n.label} has no source")
        out = self.table(n.tables[0])
        for t in n.tables[1:]:
            out = out.unionByName(self.table(t), allowMissingColumns=True)
        return out

    @staticmethod
    def key(label: str, columns) -> F.Column:
        """Label:key, null if any part is."""
        whole = F.lit(True)
        for c in columns:
            whole = whole & F.col(f"`{c}`").isNotNull()
        return F.when(whole, F.concat(F.lit(f"{label}:"), F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in columns])))

    @staticmethod
    def _value(text: str) -> F.Column:
        if "${" not in text:
            return F.expr(text.split(".")[-1] if re.fullmatch(r"\w+\.\w+", text) else text)
        parts = re.split(r"\$\{(\w+)\}", text)
        return F.concat(*[F.col(p).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts) if p])

    def _mapped(self, label: str) -> NodeMapping:
        found = next((m for m in self.mapping.nodes if m.label == label), None)
        if found is None:
            raise GraphError(f"no node mapping {label}")
        return found

    def _typed(self, n: NodeMapping, rows: DataFrame) -> DataFrame:
        return rows.select(self.key(n.label, n.key).alias("id"), *[self._value(v).alias(p) for p, v in n.properties.items()]).where("id is not null")

    def typed_nodes(self, label: str) -> DataFrame:
        """id and typed properties of one label, without orphans' parents."""
        n = self._mapped(label)
        return self._typed(n, self.rows(n))

    def duplicates(self, label: str | None = None) -> DataFrame:
        """id and n of the keys that occur more than once in a label's source, united tables taken together; of all labels in one pass if none is given."""
        chosen = [self._mapped(label)] if label else self.mapping.nodes
        keys = reduce(DataFrame.union, [self.rows(n).select(self.key(n.label, n.key).alias("id")) for n in chosen])
        return keys.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")

    def orphans(self, label: str | None = None) -> DataFrame:
        """id, label, properties of parents that weak rows name but no table has: one Unknown_<Label> node per key."""
        found = []
        for n in self.mapping.nodes:
            for p in n.strong():
                if label in (None, p.label):
                    wanted = self.rows(n).select(self.key(p.label, p.columns).alias("id")).where("id is not null").distinct()
                    missing = wanted.join(self.typed_nodes(p.label).select("id"), "id", "left_anti")
                    found.append(missing.select("id", F.lit(p.label).alias("label"), F.create_map(F.lit("name"), F.lit(f"Unknown_{p.label}")).alias("properties")))
        if not found:
            first = self.mapping.nodes[0]
            return self.typed_nodes(first.label).limit(0).select("id", F.lit("").alias("label"), F.create_map(F.lit("name"), F.lit("")).alias("properties"))
        # the label is a key too, so that a filter on it prunes the other labels' parts
        return reduce(DataFrame.union, found).dropDuplicates(["id", "label"]) if len(found) > 1 else found[0]

    @staticmethod
    def _as_graph(typed: DataFrame, label: str) -> DataFrame:
        pairs = [x for c in typed.columns[1:] for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
        properties = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
        return typed.select("id", F.lit(label).alias("label"), properties.alias("properties"))

    def nodes(self, check: bool = True, labels: list[str] | None = None) -> DataFrame:
        """id, label, properties of all labels or of some. Where check is set, a duplicate key is an error, looked for in one pass."""
        if check and (twice := self.duplicates().head()):
            raise GraphError(f"{twice['id'].partition(':')[0]}: key {twice['id']} occurs {twice['n']} times")
        chosen = labels if labels is not None else [n.label for n in self.mapping.nodes]
        parents = [p for p in dict.fromkeys(p.label for n in self.mapping.nodes for p in n.strong()) if p in chosen]
        parts = [self._as_graph(self.typed_nodes(label), label) for label in chosen]
        if parents:
            parts.append(self.orphans() if labels is None else reduce(DataFrame.union, [self.orphans(p) for p in parents]))
        if not parts:
            return self.orphans("")
        return reduce(DataFrame.union, parts)

    def _keyed(self, rows: DataFrame, columns: tuple[str, ...], id_: str) -> DataFrame:
        """The rows whose key columns make the id, as comparisons of columns that reach the scan."""
        key = id_.partition(":")[2]
        values = key.split("|") if len(columns) > 1 else [key]
        if len(values) != len(columns):
            return rows.limit(0)
        kinds = dict(rows.dtypes)
        for c, v in zip(columns, values):
            rows = rows.where(F.col(f"`{c}`") == F.lit(v).try_cast(kinds[c]))
        return rows.where(self.key("", columns) == f":{key}")

    def lookup(self, id_: str) -> DataFrame:
        """id, label, properties of one node; only its label's sources are read, filtered by the key."""
        label = id_.partition(":")[0]
        if label not in {n.label for n in self.mapping.nodes}:
            return self.orphans("")
        n = self._mapped(label)
        own = self._as_graph(self._typed(n, self._keyed(self.rows(n), n.key, id_)), label)
        lost = [self._keyed(self.rows(m), p.columns, id_).limit(1) for m in self.mapping.nodes for p in m.strong() if p.label == label]
        if not lost:
            return own
        named = reduce(DataFrame.union, [x.select(F.lit(id_).alias("id")) for x in lost]).distinct().join(own.select("id"), "id", "left_anti")
        return own.union(named.select("id", F.lit(label).alias("label"), F.create_map(F.lit("name"), F.lit(f"Unknown_{label}")).alias("properties")))

    def edges(self, label: str | None = None) -> DataFrame:
        """src, dst, label, properties; rows with a null end, or that fail the condition, make no edge."""
        out = [self._routed(e, self._edge_rows(e), []) for e in self.mapping.edges if label is None or label in {r.label for r in e.all_routes()}]
        if not out:
            raise GraphError(f"no edge mapping {label or ''}")
        every = reduce(DataFrame.union, out)
        return every if label is None else every.where(F.col("label") == label)

    def _edge_rows(self, e: EdgeMapping) -> DataFrame:
        rows = self.table(e.table)
        return rows.where(F.expr(re.sub(r"\$\{(\w+)\}", r"`\1`", e.condition))) if e.condition else rows

    def _routed(self, e: EdgeMapping, rows: DataFrame, only: list[Route]) -> DataFrame:
        """Edges of a mapping's rows over all or some of its routes; several routes cost one scan."""
        routes = only or e.all_routes()
        pairs = [x for p, v in e.properties.items() for x in (F.lit(p), self._value(v).cast("string"))]
        properties = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

        def ends(r: Route) -> F.Column:
            here = F.struct(self.key(r.src, r.src_columns).alias("src"), self.key(r.dst, r.dst_columns).alias("dst"), F.lit(r.label).alias("label"))
            return here if r.role is None or not e.role_column else F.when(F.col(f"`{e.role_column}`").cast("string") == r.role, here)

        if len(routes) == 1:
            out = rows.select(ends(routes[0]).alias("e"), properties.alias("properties"))
        else:
            out = rows.select(F.explode(F.array(*map(ends, routes))).alias("e"), properties.alias("properties"))
        return out.select("e.src", "e.dst", "e.label", "properties").where("src is not null and dst is not null")

    def neighbours(self, id_: str) -> DataFrame:
        """direction, label, other, properties of every edge of one node; tables are filtered by the node's key."""
        label, found = id_.partition(":")[0], []
        for e in self.mapping.edges:
            for r in e.all_routes():
                for end, columns, direction, other in ((r.src, r.src_columns, "out", "dst"), (r.dst, r.dst_columns, "in", "src")):
                    if end == label:
                        rows = self._routed(e, self._keyed(self._edge_rows(e), columns, id_), [r])
                        found.append(rows.select(F.lit(direction).alias("direction"), "label", F.col(other).alias("other"), "properties"))
        if not found:
            raise GraphError(f"no edges of {label}")
        return reduce(DataFrame.union, found)

    def catalog(self) -> DataFrame:
        """kind, label, n, properties (name: type), example (JSON) and the labels of an edge's ends, one row per label; types are those of the columns."""
        parts = []
        for n in self.mapping.nodes:
            typed = self.typed_nodes(n.label)
            types = ", ".join(f"{c}: {t}" for c, t in property_types(typed.drop("id")).items())
            whole = typed.agg(F.count("*").alias("n"), F.min(F.to_json(F.struct(*typed.columns))).alias("example"))
            none = F.lit(None).cast("string")
            parts.append(whole.select(F.lit("node").alias("kind"), F.lit(n.label).alias("label"), "n", F.lit(types).alias("properties"), "example", none.alias("src_label"), none.alias("dst_label")))
        for e in self.mapping.edges:
            rows = self._routed(e, self._edge_rows(e), [])
            types = ", ".join(f"{p}: {t}" for p, t in property_types(self.table(e.table).select(*[self._value(v).alias(p) for p, v in e.properties.items()])).items()) if e.properties else ""
            ends = rows.groupBy("label", F.split_part("src", F.lit(":"), F.lit(1)).alias("src_label"), F.split_part("dst", F.lit(":"), F.lit(1)).alias("dst_label"))
            seen = ends.agg(F.count("*").alias("n"), F.min(F.to_json(F.struct("src", "dst", "properties"))).alias("example"))
            parts.append(seen.select(F.lit("edge").alias("kind"), "label", "n", F.lit(types).alias("properties"), "example", "src_label", "dst_label"))
        return reduce(DataFrame.union, parts)


def property_types(df: DataFrame) -> dict[str, str]:
    """Column -> INT64, DOUBLE, BOOL, STRING[] or STRING, as a graph store names them."""
    name = lambda t: "STRING[]" if isinstance(t, ArrayType) else "INT64" if isinstance(t, IntegralType) else "DOUBLE" if isinstance(t, FractionalType) else "BOOL" if isinstance(t, BooleanType) else "STRING"
    return {f.name: name(f.dataType) for f in df.schema.fields}

"""Catalogue entries for sources, samples, messages, metadata, validators, graph text and documents over the driver's tables."""

from __future__ import annotations

import dataclasses
import os
import tempfile

from pyspark.sql import functions as F

from veridex.functions import text as fx
from veridex.operators import entity_graph as eg
from veridex.operators import graph, lineage, pattern, reasoning, scoring
from veridex.plans.catalogue import plain_types, star, star_model
from veridex.plans.catalogue_more import _BULK, _CONTAINS, _MAPPING, _PLACED, _compiler, _folder, table
from veridex.plans.engine import Engine
from veridex.plans.model import Specification, resolve_model
from veridex.plans.rules import RULES, Rule
from veridex.sources import files

# --- guards, sources, samples ------------------------------------------------------------

_STATEMENTS = {
    "query": "SELECT region_name FROM regions", "with": "WITH r AS (SELECT * FROM regions) SELECT * FROM r", "union": "SELECT 1 AS a UNION ALL SELECT 2",
    "drop": "DROP TABLE regions", "insert": "INSERT INTO regions VALUES (1, 'x')", "create": "CREATE TABLE t AS SELECT 1 AS a", "set": "SET x = 1", "two": "SELECT 1; SELECT 2",
}


def _outcome(run) -> str:
    """The name of the error that a call raises, or 'ok'."""
    try:
        run()
    except Exception as error:  # the kind of error is the result
        return type(error).__name__
    return "ok"


def guard_readonly(spark, sf_dir):
    engine = star(spark, sf_dir)
    return spark.createDataFrame([(k, _outcome(lambda q=q: engine.validate(q)) == "ok") for k, q in _STATEMENTS.items()], "name string, allowed boolean")


def source_kinds(spark, sf_dir):
    nations, sources = table(spark, sf_dir, "nation"), files.Sources(spark)
    sources.add("parquet", "parquet", f"{sf_dir}/nation.parquet").add("sql", "sql", f"SELECT * FROM parquet.`{sf_dir}/nation.parquet`")
    for kind in ("orc", "csv"):
        nations.write.format(kind).option("header", True).save(path := _folder(spark))
        sources.add(kind, kind, path)
    nations.agg(F.to_json(F.collect_list(F.struct("*")))).write.text(path := _folder(spark))
    sources.add("json", "json", path)
    counts = [sources(k).agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.sum("n_nationkey").cast("long").alias("total")) for k in sources.names()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def source_protocols(spark, sf_dir):
    """An engine over a mapping, over a function and over the session's own tables gives the same."""
    frames = {d.source: table(spark, sf_dir, d.source) for d in star_model().datasets}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(f"own_{name}")
    owned = dataclasses.replace(star_model(), datasets=tuple(dataclasses.replace(d, source=f"own_{d.source}") for d in star_model().datasets))
    engines = {"mapping": Engine(spark, star_model(), frames), "function": star(spark, sf_dir), "tables": Engine(spark, owned)}
    rows = [(k, e.sql("SELECT units FROM sales").first()[0]) for k, e in engines.items()]
    return plain_types(spark.createDataFrame(rows, "kind string, units double"))


def source_json_array(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_name", F.struct(F.col("n_nationkey").alias("k")).alias("inner"))
    rows.agg(F.to_json(F.collect_list(F.struct("*")))).write.text(path := _folder(spark))
    return files.read_json(spark, path).select("n_name", "inner")


def sample_logical(spark, sf_dir):
    found = files.sample(star(spark, sf_dir), ["regions", "no such dataset"], 10)
    assert found["no such dataset"] == []
    return spark.createDataFrame([(r["region_key"], r["region_name"]) for r in found["regions"]], "region_key long, region_name string")


def sample_as_text(spark, sf_dir):
    text = files.sample_text(files.sample(star(spark, sf_dir), ["regions"], 10))
    return spark.createDataFrame([(line,) for line in text.splitlines()], "line string")


def model_round_trip(spark, sf_dir):
    """The model written as YAML and JSON and read again, and found in a folder."""
    rows = []
    with tempfile.TemporaryDirectory() as folder:  # the driver's own files, read by the driver
        for kind in ("yaml", "json"):
            Specification((star_model(),)).save(path := os.path.join(folder, f"m.{kind}"))
            rows += [(kind, d.name, len(d.fields)) for d in resolve_model(path).datasets]
        rows += [("folder", d.name, len(d.fields)) for d in resolve_model(folder).datasets]
    rows += [("object", d.name, len(d.fields)) for d in resolve_model(star_model()).datasets]
    return spark.createDataFrame(rows, "kind string, dataset string, fields long")


def schema_sidecar(spark, sf_dir):
    schema = eg.Schema((eg.EntityType("Customer"), eg.EntityType("Order", "weak", "Customer")), (eg.RelationType("PLACED", "Customer", "Order"),))
    with tempfile.TemporaryDirectory() as folder:
        files.save_sidecar(path := os.path.join(folder, "schema.json"), schema.to_dict())
        back = eg.Schema.from_dict(files.load_sidecar(path))
    assert back == schema
    return spark.createDataFrame([(e.label, e.kind, e.parent) for e in back.entities], "label string, kind string, parent string")


def markdown_rows(spark, sf_dir):
    text = star(spark, sf_dir).markdown("SELECT region_key, region_name FROM regions ORDER BY region_key", 3)
    return spark.createDataFrame([(k, line) for k, line in enumerate(text.splitlines())], "k long, line string")


def trace_jsonl(spark, sf_dir):
    """Events appended twice to a trace and read again."""
    events = table(spark, sf_dir, "conversations").select(F.col("role").alias("type"), F.col("conv_id").cast("string").alias("session_id"), "turn")
    path = _folder(spark)
    for _ in range(2):
        files.append_trace(events, path)
    from veridex.operators import trace

    return trace.read_trace(spark, path).groupBy("type").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"))


def report_by_group(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").select("toxic", (F.col("quality") == 1).alias("passed"))
    rows = scoring.report(scored, ["toxic"])["rows"]
    return plain_types(spark.createDataFrame([(r["toxic"], r["passed"], r["total"], r["accuracy"]) for r in rows], "toxic long, passed long, total long, accuracy double"))


def chosen_tasks(spark, sf_dir):
    tasks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"), F.when(F.col("toxic") == 1, "Hard").otherwise("Easy").alias("level"))
    return files.choose_tasks(tasks, level="hard", at_most=15).select("task_id", "level")


def total_with_literal(spark, sf_dir):
    """A literal that says limit is no LIMIT; a LIMIT in a CTE is one, and then the total is what was returned."""
    engine = star(spark, sf_dir)
    asked = {
        "literal": "SELECT order_key FROM orders WHERE priority <> 'limit' -- no limit", "own": "SELECT order_key FROM orders LIMIT 7",
        "cte": "WITH a AS (SELECT order_key FROM orders LIMIT 50) SELECT order_key FROM a", "subquery": "SELECT order_key FROM orders WHERE total_price > (SELECT MIN(total_price) FROM orders LIMIT 1)",
    }
    return spark.createDataFrame([(k, len(rows), total) for k, q in asked.items() for rows, total in [engine.rows(q, 10)]], "name string, returned long, total long")


# --- messages, metadata, rules -----------------------------------------------------------


def win_unaliased(spark, sf_dir):
    return plain_types(star(spark, sf_dir).sql("SELECT cust_key, order_key, ROW_NUMBER() OVER (PARTITION BY cust_key ORDER BY order_key) FROM orders").toDF("cust_key", "order_key", "place"))


class _NoStar(Rule):
    name = "X1"

    def check(self, scope, engine):
        return ["name the columns"] if any(i.star for i in scope.items) else []


def validate_more(spark, sf_dir):
    """A metric within a window aggregate, and a rule of the caller's own."""
    engine = Engine(spark, star_model(), star(spark, sf_dir).sources, rules=(*RULES, _NoStar()))
    asked = {"window": "SELECT return_flag, SUM(net_revenue) OVER (PARTITION BY return_flag) FROM sales GROUP BY return_flag", "star": "SELECT * FROM regions", "good": "SELECT return_flag, net_revenue FROM sales GROUP BY return_flag"}
    return spark.createDataFrame([(k, ",".join(sorted({x.split(":")[0] for x in engine.validate(q)}))) for k, q in asked.items()], "name string, rules string")


def same_name_here(spark, sf_dir):
    """nation_key is a field of three datasets; the one in FROM is meant."""
    return plain_types(star(spark, sf_dir).sql("SELECT nation_key, COUNT(*) AS n FROM suppliers GROUP BY nation_key"))


def error_messages(spark, sf_dir):
    """What goes wrong, and whether the message tells what to do in logical names."""
    engine, rows = star(spark, sf_dir), []
    asked = [
        ("unjoined field", "SELECT segment FROM orders", "customers: JOIN it"), ("unknown field", "SELECT colour FROM orders", "net_revenue"), ("unknown dataset", "SELECT a FROM shops", "activity"),
        ("physical name", "SELECT o_orderkey FROM orders", "order_key"), ("empty", "  ", "empty"), ("no query", "SELEC 1", "not a query"),
    ]
    for name, sql, said in asked:
        try:
            engine.sql(sql)
        except Exception as error:  # the message is the result
            rows.append((name, type(error).__name__, said in str(error)))
    return spark.createDataFrame(rows, "name string, error string, told boolean")


def search_words(spark, sf_dir):
    engine = star(spark, sf_dir)
    return spark.createDataFrame([(w, *x) for w in ("buyer", "discount", "Returned") for x in engine.search(w)], "word string, kind string, name string")


def translation_runs(spark, sf_dir):
    """The physical text of a translation, run by itself over the bound views."""
    engine = star(spark, sf_dir)
    pair = engine.translate("SELECT return_flag, net_revenue FROM sales GROUP BY return_flag HAVING net_revenue > 0")
    engine.bind()
    assert "net_revenue > 0" in pair.logical and "SUM(" in pair.physical
    return plain_types(spark.sql(pair.physical))


def auto_join_facts(spark, sf_dir):
    """Metrics of two facts, each aggregated before they meet: orders aren't repeated by their lines."""
    return plain_types(star(spark, sf_dir).query(["net_revenue", "avg_order_value"], ["segment"], having="net_revenue > 0"))


def auto_join_facts_filter(spark, sf_dir):
    return plain_types(star(spark, sf_dir).query(["units", "avg_order_value", "order_count"], ["orders.priority", "order_year"], where="orders.status = 'F'"))


# --- lineage -----------------------------------------------------------------------------


def lineage_fields(spark, sf_dir):
    return lineage.build(star(spark, sf_dir))[0].where("label = 'PhysicalField'").select("id")


def lineage_joins(spark, sf_dir):
    return lineage.build(star(spark, sf_dir))[1].where("label = 'JOINS_TO'").select("src", "dst", F.col("properties")["on"].alias("on"))


def lineage_sources(spark, sf_dir):
    return lineage.build(star(spark, sf_dir))[1].where("label = 'DERIVED_FROM'").select(F.col("src").alias("metric"), F.col("dst").alias("dataset"))


def lineage_time_dimensions(spark, sf_dir):
    return lineage.build(star(spark, sf_dir))[0].where("label = 'Dimension' and properties['is_time'] = 'true'").select("id")


def lineage_load(spark, sf_dir):
    nodes, edges = lineage.load(star(spark, sf_dir), _folder(spark))
    return graph.label_counts(nodes).union(graph.label_counts(edges))


def match_lineage(spark, sf_dir):
    return pattern.query(*lineage.build(star(spark, sf_dir)), "MATCH (m:Metric {name: 'net_revenue'})-[:AGGREGATES_FROM]->(f:PhysicalField) RETURN f.name AS field")


def match_slices(spark, sf_dir):
    text = "MATCH (m:Metric)-[:SLICES_BY]->(d:Dimension)<-[:MAPS_TO]-(s:LogicalDataset) WHERE d.is_time = true RETURN s.name AS dataset, COUNT(DISTINCT m) AS metrics, COUNT(*) AS n"
    return pattern.query(*lineage.build(star(spark, sf_dir)), text)


# --- graph text --------------------------------------------------------------------------


def _graph(spark, sf_dir):
    c = _compiler(spark, sf_dir)
    return c.nodes(check=False), c.edges()


def match_one_hop(spark, sf_dir):
    return pattern.query(*_graph(spark, sf_dir), "MATCH (c:Customer {segment: 'BUILDING'})-[:PLACED]->(o:Order) WHERE o.status <> 'F' RETURN c.name AS customer, o.id AS placed")


def match_two_hop(spark, sf_dir):
    text = "MATCH (c:Customer)-[:PLACED]->(o:Order)-[e:CONTAINS]->(p:Part) WHERE e.quantity > 45 AND p.brand STARTS WITH 'Brand#1' RETURN c.segment AS segment, p.brand AS brand, COUNT(*) AS n, SUM(e.quantity) AS quantity"
    return plain_types(pattern.query(*_graph(spark, sf_dir), text))


def match_backward(spark, sf_dir):
    return pattern.query(*_graph(spark, sf_dir), "MATCH (p:Part)<-[:CONTAINS]-(o)<-[:PLACED]-(c:Customer) WHERE NOT c.segment IN ['BUILDING', 'MACHINERY'] RETURN p.id AS part, COUNT(DISTINCT c) AS customers ORDER BY customers DESC, part LIMIT 25")


def match_edge_types(spark, sf_dir):
    return pattern.query(*_graph(spark, sf_dir), "MATCH ()-[e]->() RETURN label(e) AS rel, COUNT(*) AS n")


def match_shared(spark, sf_dir):
    return pattern.query(*_graph(spark, sf_dir), "MATCH (a:Supplier)-[:BULK]->(p)<-[:BULK]-(b:Supplier) WHERE a.id < b.id RETURN a.id AS a, b.id AS b, COUNT(DISTINCT p) AS n ORDER BY n DESC, a, b SKIP 5 LIMIT 20")


def graph_catalog_types(spark, sf_dir):
    return _compiler(spark, sf_dir).catalog().select("kind", "label", "n", "properties", "src_label", "dst_label", F.col("example").isNotNull().alias("has_example"))


def graph_lookup_keys(spark, sf_dir):
    """Nodes by id, each read from its own table by its key: a plain one, a composite one, an orphan's parent, none."""
    c = _compiler(spark, sf_dir)
    stock = table(spark, sf_dir, "lineitem").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("k")).first().k
    out = c.lookup("Supplier:7")
    for id_ in (f"Stock:{stock.l_partkey}|{stock.l_suppkey}", "Order:1", "Order:-5", "Nothing:1", "Part:1", "Part:2", "Part:3"):
        out = out.union(c.lookup(id_))
    return out.select("id", "label", F.col("properties")["name"].alias("name"))


def graph_neighbours_keys(spark, sf_dir):
    return _compiler(spark, sf_dir).neighbours("Part:1").select("direction", "label", "other")


def entity_logical_names(spark, sf_dir):
    """Properties by the logical names of a dataset."""
    mapping = eg.Mapping((eg.NodeMapping("Client", ("cust_key",), ("customers",), properties={"who": "customer_name", "where": "customers.segment", "title": "${segment}/${customer_name}"}),))
    engine = star(spark, sf_dir)
    return eg.Compiler(mapping, engine.source, engine).typed_nodes("Client")


def entity_routes(spark, sf_dir):
    """One row of orders makes an edge by its status, and one for every row."""
    routes = (
        eg.Route("FINISHED", "Order", ("o_orderkey",), "Customer", ("o_custkey",), "F"), eg.Route("OPEN", "Order", ("o_orderkey",), "Customer", ("o_custkey",), "O"),
        eg.Route("HAS", "Customer", ("o_custkey",), "Order", ("o_orderkey",)),
    )
    mapping = eg.Mapping(_MAPPING.nodes, (eg.EdgeMapping("STATUS", "orders", "Order", ("o_orderkey",), "Customer", ("o_custkey",), routes=routes, role_column="o_orderstatus"),))
    return graph.label_counts(eg.Compiler(mapping, lambda n: table(spark, sf_dir, n)).edges())


_SCHEMA = eg.Schema((eg.EntityType("Customer"), eg.EntityType("Order", "weak", "Customer"), eg.EntityType("Line", "weak")), (eg.RelationType("PLACED", "Customer", "Order"), eg.RelationType("HAS", "Order", "Shop"), eg.RelationType("Customer", "Order", "Line")))


def schema_problems(spark, sf_dir):
    more = eg.Schema((eg.EntityType("a b"), eg.EntityType("Twice"), eg.EntityType("Twice")), (eg.RelationType("R", "Twice", "Twice"), eg.RelationType("R", "Twice", "Twice")))
    return spark.createDataFrame([(p,) for s in (_SCHEMA, more) for p in s.problems()], "problem string")


def mapping_problems(spark, sf_dir):
    """Problems of a mapping against the tables' own columns, whole and in part."""
    tables = {t: table(spark, sf_dir, t).columns for t in ("customer", "orders")}
    mapping = eg.Mapping((eg.NodeMapping("Customer", ("c_name",), ("customer",)), eg.NodeMapping("Order", ("o_key",), ("orders",))), (eg.EdgeMapping("PLACED", "shops", "Customer", ("c",), "Shop", ("s",)),))
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"]}
    return spark.createDataFrame([(part, p) for part in (False, True) for p in mapping.problems(_SCHEMA, tables, keys, part)], "partial boolean, problem string")


def mapping_merge(spark, sf_dir):
    """A later mapping wins by label; a path deletes. What is left compiles."""
    other = eg.Mapping((eg.NodeMapping("Customer", ("c_custkey",), ("customer",), properties={"name": "upper(c_name)"}),))
    mapping = _MAPPING.merged(other).without("nodes/Stock").without("edges/BULK")
    c = eg.Compiler(mapping, _compiler(spark, sf_dir)._table)
    upper = c.nodes(check=False).where("label = 'Customer' and properties['name'] = upper(properties['name'])").agg(F.lit("upper names").alias("what"), F.count("*").alias("n"))
    return upper.union(spark.createDataFrame([("nodes", len(mapping.nodes)), ("edges", len(mapping.edges))], "what string, n long"))


# --- reasoning documents over the tables --------------------------------------------------


def _ontology(spark, sf_dir):
    """Regions, nations and customers as a hierarchy of facts."""
    parts = (
        table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("content"), F.lit(0.5).alias("confidence")),
        table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name", F.lit(0.75)),
        table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name", F.col("c_acctbal")),
    )
    return parts[0].union(parts[1]).union(parts[2]).withColumns({"is_ontology": F.lit(True), "merged_into": F.lit(None).cast("string")})


def _chain(spark, sf_dir):
    """Edges that call each customer the same as the one before, in runs of ten."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
    return c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("src"), F.concat(F.lit("c"), F.col("c_custkey") + 1).alias("dst"), F.lit("equivalent_to").alias("label"), F.lit(None).cast("string").alias("dependency"), (F.col("c_custkey") % 10 != 5).alias("merged"))


def reason_upsert_tables(spark, sf_dir):
    """Parts by key, over them the latest line of each."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("content"), F.lit(0).cast("long").alias("version"))
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id"), F.concat(F.lit("line "), F.col("l_orderkey").cast("string")).alias("content"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"))
    return reasoning.upsert(old, new).select("id", "version")


def reason_merge_tables(spark, sf_dir):
    return reasoning.merge_synonyms(_ontology(spark, sf_dir), _chain(spark, sf_dir)).where("merged_into is not null").select("id", "merged_into")


def reason_chain_tables(spark, sf_dir):
    def write(df):
        df.write.parquet(path := _folder(spark))
        return spark.read.parquet(path)

    return reasoning.merge_synonyms(_ontology(spark, sf_dir), _chain(spark, sf_dir), transitive=True, write=write).where("merged_into is not null").select("id", "merged_into")


def reason_paths_tables(spark, sf_dir):
    return reasoning.ontology_paths(_ontology(spark, sf_dir))


def reason_inherited_tables(spark, sf_dir):
    edges = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("references").alias("label"))
    return reasoning.inherited_counts(reasoning.ontology_paths(_ontology(spark, sf_dir)), edges)


def _document(spark, sf_dir):
    none = F.lit(None).cast("string")
    facts = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey").alias("id"), F.col("p_name").alias("content"), (F.col("p_size") / 50).alias("confidence"), F.when(F.col("p_size") > 40, "f1").alias("merged_into"))
    steps = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("method"))
    references = table(spark, sf_dir, "nation").select(F.concat(F.lit("o"), "n_nationkey").alias("id"), F.col("n_name").alias("osi_name"))
    sources = table(spark, sf_dir, "supplier").select(F.concat(F.lit("q"), "s_suppkey").alias("id"), F.col("s_name").alias("query_sql"))
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_orderkey").alias("dst"), F.lit("input_to").alias("label"), F.col("l_returnflag").alias("dependency"), F.lit(None).cast("boolean").alias("merged"))
    edges = edges.union(table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), "o_orderkey"), F.lit("f1"), F.lit("outputs"), none, F.lit(False)))
    return facts, steps, references, sources, edges


def reason_as_graph(spark, sf_dir):
    nodes, edges = reasoning.as_graph(*_document(spark, sf_dir))
    shown = edges.groupBy("label").agg(F.count(F.col("properties")["dependency"]).alias("n"))
    return graph.label_counts(nodes).union(graph.label_counts(edges)).union(shown.select(F.concat("label", F.lit(" with dependency")), "n"))


def reason_delete(spark, sf_dir):
    nodes, edges = reasoning.delete(*reasoning.as_graph(*_document(spark, sf_dir)), "f1")
    return graph.label_counts(nodes).union(graph.label_counts(edges))


def reason_summary(spark, sf_dir):
    return plain_types(reasoning.summary(_document(spark, sf_dir)[0]).select("id", "confidence"))


def reason_second_page(spark, sf_dir):
    return plain_types(reasoning.page(_document(spark, sf_dir)[0], 1).select("id", "confidence"))


# --- redaction, memory, scoring over the tables -------------------------------------------


def redact_keys(spark, sf_dir):
    """Columns, struct fields and map values under sensitive names, at any depth."""
    name = F.col("c_name")
    inner = F.struct(name.alias("x-api-key"), F.concat(F.lit("Bearer: "), name).alias("note"), F.array(F.struct(name.alias("password"), name.alias("plain"))).alias("list"))
    keys = F.create_map(F.lit("auth.token.value"), name, F.lit("page_token"), name, F.lit("My-Api_Key"), name, F.lit("api_key_v2"), name)
    rows = table(spark, sf_dir, "customer").select("c_custkey", name.alias("api_key"), name.alias("token_count"), inner.alias("inner"), keys.alias("keys"))
    out = fx.redact_columns(rows)
    shown = [out["inner"]["x-api-key"], out["inner"]["note"], out["inner"]["list"][0]["password"], out["inner"]["list"][0]["plain"], out["keys"]["auth.token.value"], out["keys"]["page_token"], out["keys"]["My-Api_Key"], out["keys"]["api_key_v2"]]
    return out.select("c_custkey", F.concat_ws("|", "api_key", "token_count", *shown).alias("shown"))


def redact_key_names(spark, sf_dir):
    """Which of many key names are sensitive, in Python as in SQL."""
    names = table(spark, sf_dir, "nation").select(F.explode(F.array(*[F.concat(F.lit(a), F.lower("n_name"), F.lit(b)) for a in ("", "x-", "auth.", "token.", "api_") for b in ("", "-api-key", "_token", ".token", "_count", ".password.x", "key")])).alias("name"))
    rows = [(r.name, fx.is_sensitive(r.name)) for r in names.distinct().collect()]
    return spark.createDataFrame(rows, "name string, sensitive boolean").where(fx._sensitive_key(F.col("name")) == F.col("sensitive"))


def memory_cleared(spark, sf_dir):
    from veridex.operators import trace

    return trace.clear_results(table(spark, sf_dir, "conversations"), 1, role="assistant", name="role").select("conv_id", "turn", "cleared", F.md5("text").alias("digest"))


def score_numbers(spark, sf_dir):
    """Prices with thousands' commas and a percent sign against prices a little or much off."""
    p = table(spark, sf_dir, "part")
    wanted = F.col("p_retailprice") * F.when(F.col("p_partkey") % 3 == 0, 1.00001).otherwise(1.001)
    given = F.concat(F.lit(" "), F.format_number("p_retailprice", 4), F.when(F.col("p_partkey") % 2 == 0, "%").otherwise(""))
    return p.select("p_partkey", fx.numeric_match(given, wanted.cast("string")).alias("equal"))


def score_answers_tables(spark, sf_dir):
    """Answers of every kind made from parts; a third of them are right."""
    p = table(spark, sf_dir, "part").withColumn("right", F.col("p_partkey") % 3 == 0)
    brand, price, size = F.col("p_brand"), F.col("p_retailprice"), F.col("p_size").cast("string")
    pick = lambda good, bad: F.when(F.col("right"), good).otherwise(bad)
    kinds = {
        "number": (F.concat(F.lit("Of 100 parts the answer is "), price.cast("string"), F.lit("%")), pick(price * 1.000001, price * 1.01).cast("string")),
        "list": (F.concat(brand, F.lit(" "), size, F.lit(";a")), pick(F.concat(F.lit("a, "), size, F.lit(","), brand), F.concat(F.lit("b, "), size, F.lit(","), brand))),
        "grouped_list": (F.concat(F.lit("x: 2.50; "), brand, F.lit(":1")), pick(F.concat(brand, F.lit(": 1.0; x: 2.5")), F.concat(brand, F.lit(": 1.5; x: 2.5")))),
        "text": (F.concat(F.lit(" "), F.upper(brand)), pick(F.lower(brand), F.concat(brand, F.lit(".")))),
        "not_applicable": (F.lit("Not Applicable"), pick(F.lit(" not applicable "), brand)),
    }
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    given, wanted = (F.coalesce(*[F.when(kind == k, v[i]) for k, v in kinds.items()]) for i in (0, 1))
    return p.select("p_partkey", fx.answers_match(given, wanted, kind).alias("passed"))


def score_accuracy_tables(spark, sf_dir):
    scored = score_answers_tables(spark, sf_dir)
    return plain_types(scoring.accuracy(scored.withColumn("kind", F.col("p_partkey") % 5), ["kind"]))


def score_last_numbers(spark, sf_dir):
    texts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" costs +"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit(" units")).alias("t"))
    return plain_types(texts.select("l_orderkey", "l_linenumber", fx.last_number(F.col("t")).alias("number")))


def score_guidelines(spark, sf_dir):
    """The kind that a guideline asks for, wrapped in the names of nations."""
    said = ["Answer grouped by x, broken down by y", "a list, grouping per group", "A comma separated list", "just a list of names", "a number rounded to 2 decimals", "yes or no", "Yes/No only", "a grouped number", "whatever"]
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array(*[F.concat(F.lit("For "), "n_name", F.lit(": "), F.lit(s)) for s in said])).alias("k", "guideline"))
    return plain_types(rows.select("n_nationkey", "k", fx.answer_kind(F.col("guideline")).alias("kind")))


_NAMES = """guard_readonly source_kinds source_protocols source_json_array sample_logical sample_as_text model_round_trip schema_sidecar markdown_rows trace_jsonl report_by_group chosen_tasks total_with_literal
win_unaliased validate_more same_name_here error_messages search_words translation_runs auto_join_facts auto_join_facts_filter lineage_fields lineage_joins lineage_sources lineage_time_dimensions lineage_load
match_lineage match_slices match_one_hop match_two_hop match_backward match_edge_types match_shared graph_catalog_types graph_lookup_keys graph_neighbours_keys entity_logical_names entity_routes schema_problems mapping_problems mapping_merge
reason_upsert_tables reason_merge_tables reason_chain_tables reason_paths_tables reason_inherited_tables reason_as_graph reason_delete reason_summary reason_second_page
redact_keys redact_key_names memory_cleared score_numbers score_answers_tables score_accuracy_tables score_last_numbers score_guidelines"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_FIELDS = "('sales', 13), ('orders', 9), ('customers', 5), ('parts', 6), ('suppliers', 4), ('nations', 3), ('regions', 2), ('activity', 7)"
_SOURCES = "('lineitem', 'orders', 'customer', 'part', 'supplier', 'nation', 'region', 'events')"
_LINEAGE_NODES = f"select * from (values ('LogicalDataset', cast(8 as bigint)), ('Dimension', 21), ('Metric', 13)) t(label, n) union all select 'PhysicalField', count(*) from information_schema.columns where table_name in {_SOURCES}"
_LINEAGE_EDGES = "select label, cast(n as bigint) as n from (values ('MAPS_TO', 72), ('JOINS_TO', 7), ('AGGREGATES_FROM', 17), ('DERIVED_FROM', 14), ('SLICES_BY', 58)) t(label, n)"
_ONTOLOGY_PATHS = """select 'r' || r_regionkey as id, 'r' || r_regionkey as root, cast(0 as bigint) as depth, 'r' || r_regionkey as path from region
    union all select 'n' || n_nationkey, 'r' || n_regionkey, 1, 'r' || n_regionkey || '>n' || n_nationkey from nation
    union all select 'c' || c_custkey, 'r' || n_regionkey, 2, 'r' || n_regionkey || '>n' || n_nationkey || '>c' || c_custkey from customer join nation on c_nationkey = n_nationkey"""
_TURNS = "select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as user_turn from conversations"
_FACTS = "select 'f' || p_partkey as id, round(p_size / 50.0, 4) as confidence, p_size from part"
_RIGHT = "select p_partkey, p_partkey % 3 = 0 as passed from part"
ORACLE = {
    "guard_readonly": "select * from (values ('query', true), ('with', true), ('union', true), ('drop', false), ('insert', false), ('create', false), ('set', false), ('two', false)) t(name, allowed)",
    "source_kinds": "select kind, count(*) as n, cast(sum(n_nationkey) as bigint) as total from nation, (values ('parquet'), ('sql'), ('orc'), ('csv'), ('json')) t(kind) group by kind",
    "source_protocols": "select kind, round(sum(l_quantity), 4) as units from lineitem, (values ('mapping'), ('function'), ('tables')) t(kind) group by kind",
    "source_json_array": "select n_name, '{\"k\":' || n_nationkey || '}' as inner from nation",
    "sample_logical": "select cast(r_regionkey as bigint) as region_key, r_name as region_name from region",
    "sample_as_text": "select 'regions' as line union all select '  region_key=' || r_regionkey || ', region_name=' || r_name from region",
    "model_round_trip": f"select kind, dataset, cast(fields as bigint) as fields from (values ('yaml'), ('json'), ('folder'), ('object')) k(kind), (values {_FIELDS}) t(dataset, fields)",
    "schema_sidecar": "select * from (values ('Customer', 'strong', null), ('Order', 'weak', 'Customer')) t(label, kind, parent)",
    "markdown_rows": "select cast(0 as bigint) as k, '| region_key | region_name |' as line union all select 1, '| --- | --- |' union all select 2 + r_regionkey, '| ' || r_regionkey || ' | ' || r_name || ' |' from region where r_regionkey < 3 union all select 5, '3 of ' || count(*) || ' rows' from region",
    "trace_jsonl": "select role as type, 2 * count(*) as n, cast(2 * sum(turn) as bigint) as turns from conversations group by role",
    "report_by_group": "select cast(toxic as bigint) as toxic, count(*) filter (quality = 1) as passed, count(*) as total, round(avg(case when quality = 1 then 1.0 else 0 end), 4) as accuracy from labels group by toxic",
    "chosen_tasks": "select doc_id as task_id, 'Hard' as level from labels where toxic = 1 order by doc_id limit 15",
    "total_with_literal": "select 'literal' as name, cast(10 as bigint) as returned, count(*) as total from orders union all select * from (values ('own', 7, 7), ('cte', 10, 10), ('subquery', 10, 10)) t",
    "win_unaliased": "select o_custkey as cust_key, o_orderkey as order_key, row_number() over (partition by o_custkey order by o_orderkey) as place from orders",
    "validate_more": "select * from (values ('window', 'R1'), ('star', 'X1'), ('good', '')) t(name, rules)",
    "same_name_here": "select cast(s_nationkey as bigint) as nation_key, count(*) as n from supplier group by s_nationkey",
    "error_messages": "select * from (values ('unjoined field', 'FieldNotFound', true), ('unknown field', 'FieldNotFound', true), ('unknown dataset', 'DatasetNotFound', true), ('physical name', 'FieldNotFound', true), ('empty', 'SemanticError', true), ('no query', 'QueryNotAllowed', true)) t(name, error, told)",
    "search_words": "select * from (values ('buyer', 'dataset', 'customers'), ('discount', 'field', 'sales.discount'), ('discount', 'field', 'sales.net'), ('discount', 'metric', 'net_revenue'), ('discount', 'metric', 'avg_discount'), ('Returned', 'field', 'sales.return_flag')) t(word, kind, name)",
    "translation_runs": "select l_returnflag as return_flag, round(sum(l_extendedprice * (1 - l_discount)), 4) as net_revenue from lineitem group by l_returnflag",
    "auto_join_facts": "select segment, round(net, 4) as net_revenue, round(value, 4) as avg_order_value from (select c_mktsegment as segment, sum(l_extendedprice * (1 - l_discount)) as net from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1) join (select c_mktsegment as segment, avg(o_totalprice) as value from orders join customer on o_custkey = c_custkey group by 1) using (segment)",
    "auto_join_facts_filter": "with o as (select o_orderpriority as priority, year(o_orderdate) as order_year, avg(o_totalprice) as value from orders where o_orderstatus = 'F' group by all), l as (select o_orderpriority as priority, year(o_orderdate) as order_year, sum(l_quantity) as units, count(distinct o_orderkey) as k from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by all) select priority, order_year, round(units, 4) as units, round(value, 4) as avg_order_value, k as order_count from o full join l using (priority, order_year)",
    "lineage_nodes": _LINEAGE_NODES,
    "lineage_edges": _LINEAGE_EDGES,
    "lineage_slices": "select 'metric:' || m as metric, cast(n as bigint) as n from (values ('net_revenue', 4), ('gross_revenue', 4), ('line_count', 4), ('units', 4), ('order_count', 6), ('avg_order_value', 6), ('revenue_per_customer', 10), ('return_rate', 4), ('avg_discount', 4), ('event_count', 3), ('active_users', 3), ('event_value', 3), ('total_part_size', 3)) t(m, n)",
    "lineage_fields": f"select 'field:' || table_name || '.' || column_name as id from information_schema.columns where table_name in {_SOURCES}",
    "lineage_joins": "select 'dataset:' || a as src, 'dataset:' || b as dst, k || '=' || k as \"on\" from (values ('sales', 'orders', 'order_key'), ('sales', 'parts', 'part_key'), ('sales', 'suppliers', 'supp_key'), ('orders', 'customers', 'cust_key'), ('customers', 'nations', 'nation_key'), ('suppliers', 'nations', 'nation_key'), ('nations', 'regions', 'region_key')) t(a, b, k)",
    "lineage_sources": "select 'metric:' || m as metric, 'dataset:' || d as dataset from (values ('net_revenue', 'sales'), ('gross_revenue', 'sales'), ('line_count', 'sales'), ('units', 'sales'), ('order_count', 'orders'), ('avg_order_value', 'orders'), ('revenue_per_customer', 'orders'), ('revenue_per_customer', 'sales'), ('return_rate', 'sales'), ('avg_discount', 'sales'), ('event_count', 'activity'), ('active_users', 'activity'), ('event_value', 'activity'), ('total_part_size', 'parts')) t(m, d)",
    "lineage_time_dimensions": "select 'dim:' || x as id from (values ('sales.ship_date'), ('sales.ship_year'), ('orders.order_date'), ('orders.order_year'), ('orders.order_month'), ('activity.ts'), ('activity.day')) t(x)",
    "lineage_load": f"select * from ({_LINEAGE_NODES}) union all select * from ({_LINEAGE_EDGES})",
    "catalog_ddl": "select dataset, cast(d as bigint) as dimensions, cast(m as bigint) as metrics from (values ('sales', 2, 7), ('orders', 3, 3), ('customers', 2, 0), ('parts', 3, 1), ('suppliers', 1, 0), ('nations', 1, 0), ('regions', 1, 0), ('activity', 1, 3)) t(dataset, d, m)",
    "match_lineage": "select * from (values ('l_extendedprice'), ('l_discount')) t(field)",
    "match_slices": "select dataset, cast(m as bigint) as metrics, cast(n as bigint) as n from (values ('sales', 7, 14), ('orders', 3, 9), ('activity', 3, 6)) t(dataset, m, n)",
    "match_one_hop": "select c_name as customer, 'Order:' || o_orderkey as placed from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING' and o_orderstatus <> 'F'",
    "match_two_hop": "select c_mktsegment as segment, p_brand as brand, count(*) as n, round(sum(l_quantity), 4) as quantity from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where l_quantity > 45 and p_size > 25 and p_brand like 'Brand#1%' group by all",
    "match_backward": "select 'Part:' || l_partkey as part, count(distinct c_custkey) as customers from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment not in ('BUILDING', 'MACHINERY') group by all order by customers desc, part limit 25",
    "match_edge_types": f"select label as rel, count(*) as n from ({_PLACED} union all {_CONTAINS} union all {_BULK}) group by label",
    "match_shared": f"select x.src as a, y.src as b, count(distinct x.dst) as n from ({_BULK}) x join ({_BULK}) y on x.dst = y.dst and x.src < y.src group by all order by n desc, a, b limit 20 offset 5",
    "graph_catalog_types": """select 'node' as kind, label, n, properties, null as src_label, null as dst_label, true as has_example from (
            select 'Customer' as label, count(*) as n, 'name: STRING, segment: STRING' as properties from customer union all select 'Part', count(*), 'brand: STRING, title: STRING' from part where p_size > 25
            union all select 'Supplier', count(*), 'name: STRING' from supplier union all select 'Order', count(*), 'status: STRING' from orders union all select 'Stock', count(*), '' from (select distinct l_partkey, l_suppkey from lineitem)
            union all select 'Place', count(*), 'name: STRING' from (select n_name from nation union all select r_name from region) union all select 'Seat', count(*), 'nation: STRING, region: STRING' from nation)
        union all select 'edge', 'PLACED', count(*), '', 'Customer', 'Order', true from orders union all select 'edge', 'CONTAINS', count(*), 'quantity: DOUBLE', 'Order', 'Part', true from lineitem
        union all select 'edge', 'BULK', count(*), '', 'Supplier', 'Part', true from lineitem where l_quantity > 45""",
    "graph_lookup_keys": """select 'Supplier:7' as id, 'Supplier' as label, s_name as name from supplier where s_suppkey = 7 union all (select 'Stock:' || l_partkey || '|' || l_suppkey, 'Stock', null from lineitem order by l_partkey, l_suppkey limit 1)
        union all select 'Order:1', 'Order', null from orders where o_orderkey = 1
        union all select 'Part:' || p_partkey, 'Part', case when p_size > 25 then null else 'Unknown_Part' end from part where p_partkey between 1 and 3 and (p_size > 25 or p_partkey in (select l_partkey from lineitem))""",
    "graph_neighbours_keys": "select 'in' as direction, 'CONTAINS' as label, 'Order:' || l_orderkey as other from lineitem where l_partkey = 1 union all select 'in', 'BULK', 'Supplier:' || l_suppkey from lineitem where l_partkey = 1 and l_quantity > 45",
    "entity_logical_names": "select 'Client:' || c_custkey as id, c_name as who, c_mktsegment as \"where\", c_mktsegment || '/' || c_name as title from customer",
    "entity_routes": "select case o_orderstatus when 'F' then 'FINISHED' else 'OPEN' end as label, count(*) as n from orders where o_orderstatus in ('F', 'O') group by all union all select 'HAS', count(*) from orders",
    "schema_problems": "select * from (values ('Line is weak and needs a parent among the entities'), ('relation HAS: no entity Shop'), ('Customer names an entity and a relation'), ('label a b may hold letters, digits and underscores only'), ('duplicate entity Twice'), ('duplicate relation R-Twice-Twice')) t(problem)",
    "mapping_problems": """select * from (values (false, 'entity Line isn''t mapped'), (false, 'relation PLACED isn''t mapped'), (false, 'relation HAS isn''t mapped'), (false, 'relation Customer isn''t mapped'), (false, 'PLACED: no table shops'), (false, 'PLACED: Shop isn''t mapped')) t(partial, problem)
        union all select partial, problem from (values (false), (true)) k(partial), (values ('Customer: key c_name isn''t the primary key of customer'), ('Order: orders has no column o_key'), ('Order: key o_key isn''t the primary key of orders'), ('Order is weak and maps no parent')) t(problem)""",
    "mapping_merge": "select 'upper names' as what, count(*) as n from customer union all select 'nodes', 6 union all select 'edges', 2",
    "reason_upsert_tables": "select p_partkey as id, cast(coalesce(v, 0) as bigint) as version from part left join (select l_partkey, max(l_orderkey * 10 + l_linenumber) as v from lineitem where l_quantity > 40 group by 1) on l_partkey = p_partkey",
    "reason_merge_tables": "select 'c' || c_custkey as id, 'c' || (c_custkey - 1) as merged_into from customer where (c_custkey - 1) % 10 not in (0, 5) and c_custkey - 1 in (select c_custkey from customer)",
    "reason_chain_tables": "select 'c' || c_custkey as id, 'c' || case when (c_custkey - 1) % 10 < 6 then c_custkey - (c_custkey - 1) % 10 + (case when c_custkey % 10 = 1 then 0 else 0 end) else c_custkey - (c_custkey - 1) % 10 + 5 end as merged_into from customer where (c_custkey - 1) % 10 not in (0, 5) and c_custkey > 1",
    "reason_paths_tables": _ONTOLOGY_PATHS,
    "reason_inherited_tables": f"select p.id, count(*) as n from ({_ONTOLOGY_PATHS}) p join supplier s on list_contains(string_split(p.path, '>'), 'n' || s_nationkey) group by p.id",
    "reason_as_graph": "select 'Fact' as label, count(*) as n from part union all select 'ReasoningStep', count(*) from orders union all select 'OSIRef', count(*) from nation union all select 'Source', count(*) from supplier union all select 'input_to', count(*) from lineitem union all select 'outputs', count(*) from orders union all select 'input_to with dependency', count(*) from lineitem union all select 'outputs with dependency', 0",
    "reason_delete": "select 'Fact' as label, count(*) - 1 as n from part union all select 'ReasoningStep', count(*) from orders union all select 'OSIRef', count(*) from nation union all select 'Source', count(*) from supplier union all select 'input_to', count(*) from lineitem where l_partkey <> 1",
    "reason_summary": f"select id, confidence from ({_FACTS}) where p_size <= 40 order by confidence desc, id limit 20",
    "reason_second_page": f"select id, confidence from ({_FACTS}) order by confidence desc, id limit 20 offset 20",
    "redact_keys": "select c_custkey, '***|' || c_name || '|***|Bearer=***|***|' || c_name || '|***|' || c_name || '|***|' || c_name as shown from customer",
    "redact_key_names": """select distinct name, sensitive from (select a || lower(n_name) || b as name,
        regexp_matches(a || lower(n_name) || b, '(^|\\.)(api_key|password|token|secret|authorization|x-api-key|bearer)(\\.|$)') or (b = '-api-key') as sensitive
        from nation, (values (''), ('x-'), ('auth.'), ('token.'), ('api_')) x(a), (values (''), ('-api-key'), ('_token'), ('.token'), ('_count'), ('.password.x'), ('key')) y(b))""",
    "memory_cleared": f"with t as ({_TURNS}), m as (select *, role = 'assistant' and user_turn <= max(user_turn) over (partition by conv_id) - 1 as cleared from t) select conv_id, turn, cleared, md5(case when cleared then '[cleared: ' || role || ']' else text end) as digest from m",
    "score_numbers": "select p_partkey, p_partkey % 3 = 0 as equal from part",
    "score_answers_tables": _RIGHT,
    "score_accuracy_tables": "select p_partkey % 5 as kind, count(*) filter (p_partkey % 3 = 0) as passed, count(*) as total, round(avg(case when p_partkey % 3 = 0 then 1.0 else 0 end), 4) as accuracy from part group by 1",
    "score_last_numbers": "select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, round(cast(cast(l_extendedprice as decimal(18, 2)) as double), 4) as number from lineitem",
    "score_guidelines": "select cast(n_nationkey as bigint) as n_nationkey, cast(k as bigint) as k, kind from nation, (values (0, 'grouped_list'), (1, 'grouped_list'), (2, 'list'), (3, 'list'), (4, 'number'), (5, 'text'), (6, 'text'), (7, 'number'), (8, 'not_applicable')) t(k, kind)",
}

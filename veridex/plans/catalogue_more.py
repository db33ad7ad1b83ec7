"""Catalogue entries beyond logical SQL: graphs, reasoning, traces, memory, scoring, sources, checks and extras."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridex.functions import text as fx
from veridex.operators import entity_graph as eg
from veridex.operators import graph, lineage, scoring, trace
from veridex.plans import ddl
from veridex.plans.catalogue import plain_types, star
from veridex.sources import files
from veridex.streaming import events as streams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A fresh folder under the one that executors share."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or (tempfile.mkdtemp(prefix="veridex-") if spark.sparkContext.master.startswith("local") else None)
    if base is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base}/veridex-source-{uuid.uuid4().hex}"


# --- the model as data -------------------------------------------------------------------


def catalog_fields(spark, sf_dir):
    return star(spark, sf_dir).fields_frame().groupBy("dataset").agg(F.count("*").alias("fields"), F.sum((F.col("kind") == "dimension").cast("long")).alias("dimensions"), F.sum(F.col("is_time").cast("long")).alias("time_dimensions"))


def catalog_metrics(spark, sf_dir):
    return star(spark, sf_dir).metrics_frame().select("metric", "datasets")


def catalog_ddl(spark, sf_dir):
    engine = star(spark, sf_dir)
    rows = [(d.name, ddl.table(engine, d.name).count("[DIMENSION]"), ddl.table(engine, d.name).count("VIRTUAL")) for d in engine.model.datasets]
    return spark.createDataFrame(rows, "dataset string, dimensions long, metrics long")


_WRONG = {
    "sum of metric": "SELECT SUM(net_revenue) FROM sales",
    "ungrouped": "SELECT return_flag, net_revenue FROM sales",
    "missing join": "SELECT avg_order_value FROM sales",
    "metric in where": "SELECT return_flag FROM sales WHERE net_revenue > 1 GROUP BY return_flag",
    "metric in group by": "SELECT return_flag FROM sales GROUP BY return_flag, net_revenue",
    "after a cte": "WITH m AS (SELECT part_key, net_revenue FROM sales GROUP BY part_key) SELECT part_key FROM m WHERE net_revenue > 1",
}


def validate_violations(spark, sf_dir):
    engine = star(spark, sf_dir)
    return spark.createDataFrame([(k, ",".join(x.split(":")[0] for x in engine.validate(q))) for k, q in _WRONG.items()], "name string, rules string")


# --- lineage -----------------------------------------------------------------------------


def lineage_nodes(spark, sf_dir):
    return graph.label_counts(lineage.build(star(spark, sf_dir))[0])


def lineage_edges(spark, sf_dir):
    return graph.label_counts(lineage.build(star(spark, sf_dir))[1])


def lineage_slices(spark, sf_dir):
    return lineage.build(star(spark, sf_dir))[1].where("label = 'SLICES_BY'").groupBy("src").agg(F.count("*").alias("n")).select(F.col("src").alias("metric"), "n")


def lineage_orphans(spark, sf_dir):
    nodes, edges = lineage.build(star(spark, sf_dir))
    broken = edges.where("not (label = 'AGGREGATES_FROM' and src = 'metric:units')").union(spark.createDataFrame([("dataset:none", "dataset:sales", "JOINS_TO", {"on": ""})], lineage.EDGES))
    return lineage.problems(nodes, broken)


# --- entities ----------------------------------------------------------------------------

_MAPPING = eg.Mapping(
    (
        eg.NodeMapping("Customer", ("c_custkey",), ("customer",), properties={"name": "c_name", "segment": "c_mktsegment"}),
        eg.NodeMapping("Part", ("p_partkey",), ("big_part",), properties={"brand": "p_brand", "title": "${p_brand}: ${p_name}"}),
        eg.NodeMapping("Supplier", ("s_suppkey",), ("supplier",), properties={"name": "s_name"}),
        eg.NodeMapping("Order", ("o_orderkey",), ("orders",), properties={"status": "o_orderstatus"}, parent=eg.Parent("Customer", ("o_custkey",))),
        eg.NodeMapping("Stock", ("l_partkey", "l_suppkey"), ("stock",), parent=eg.Parent("Part", ("l_partkey",))),
        eg.NodeMapping("Place", ("name",), ("nation_place", "region_place"), properties={"name": "name"}),
        eg.NodeMapping("Seat", ("n_nationkey",), join=eg.Join("nation", "region", (("n_regionkey", "r_regionkey"),)), properties={"nation": "n_name", "region": "r_name"}),
    ),
    (
        eg.EdgeMapping("PLACED", "orders", "Customer", ("o_custkey",), "Order", ("o_orderkey",)),
        eg.EdgeMapping("CONTAINS", "lineitem", "Order", ("l_orderkey",), "Part", ("l_partkey",), properties={"quantity": "l_quantity"}),
        eg.EdgeMapping("BULK", "lineitem", "Supplier", ("l_suppkey",), "Part", ("l_partkey",), condition="${l_quantity} > 45"),
    ),
)


def _compiler(spark, sf_dir) -> eg.Compiler:
    def get(name: str) -> DataFrame:
        if name == "big_part":
            return table(spark, sf_dir, "part").where("p_size > 25")
        if name == "stock":
            return table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
        if name.endswith("_place"):
            t = name.removesuffix("_place")
            return table(spark, sf_dir, t).select(F.col(f"{t[0]}_name").alias("name"))
        return table(spark, sf_dir, name)

    return eg.Compiler(_MAPPING, get)


def entity_nodes_count(spark, sf_dir):
    return graph.label_counts(_compiler(spark, sf_dir).nodes())


def entity_edges_count(spark, sf_dir):
    return graph.label_counts(_compiler(spark, sf_dir).edges())


def entity_composite_key(spark, sf_dir):
    return _compiler(spark, sf_dir).typed_nodes("Stock").select("id")


def entity_union_source(spark, sf_dir):
    return _compiler(spark, sf_dir).typed_nodes("Place")


def entity_join_source(spark, sf_dir):
    return _compiler(spark, sf_dir).typed_nodes("Seat")


def entity_orphans(spark, sf_dir):
    return _compiler(spark, sf_dir).orphans().select("id", "label", F.col("properties")["name"].alias("name"))


def entity_edge_condition(spark, sf_dir):
    return _compiler(spark, sf_dir).edges("BULK").groupBy("src").agg(F.count("*").alias("n"))


def entity_duplicate_keys(spark, sf_dir):
    mapping = eg.Mapping((eg.NodeMapping("Line", ("l_orderkey", "l_linenumber"), ("lineitem",)),))
    return eg.Compiler(mapping, lambda n: table(spark, sf_dir, n)).duplicates("Line")


# --- graph queries -----------------------------------------------------------------------


def graph_one_hop(spark, sf_dir):
    return _compiler(spark, sf_dir).edges("PLACED").select(F.col("src").alias("customer"), F.col("dst").alias("order"))


def graph_two_hop_count(spark, sf_dir):
    edges = _compiler(spark, sf_dir).edges()
    start = edges.where("label = 'PLACED'").select(F.col("src").alias("customer"), F.col("dst").alias("order"))
    return graph.hop(start, edges, "order", "part", "CONTAINS").groupBy("customer").agg(F.count("*").alias("n")).where("n >= 60")


def graph_common_neighbors(spark, sf_dir):
    links = _compiler(spark, sf_dir).edges("BULK").select("src", "dst")
    return graph.common_neighbours(links, "src", "dst", at_least=3)


def graph_bought_together(spark, sf_dir):
    links = _compiler(spark, sf_dir).edges("CONTAINS").select(F.col("dst").alias("part"), F.col("src").alias("order"))
    return graph.common_neighbours(links, "part", "order", at_least=2)


def graph_single_brand(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return graph.only_one(lines.select(F.col("l_orderkey").alias("order"), F.col("p_brand").alias("brand")), "order", "brand")


def graph_degree(spark, sf_dir):
    return graph.degree(_compiler(spark, sf_dir).edges("PLACED"))


def graph_edge_types(spark, sf_dir):
    return graph.edge_types(_compiler(spark, sf_dir).edges())


def graph_neighbors(spark, sf_dir):
    return _compiler(spark, sf_dir).neighbours("Order:1").select("direction", "label", "other")


def graph_node_lookup(spark, sf_dir):
    return _compiler(spark, sf_dir).lookup("Supplier:7").select("id", "label", F.col("properties")["name"].alias("name"))


def graph_label_scan(spark, sf_dir):
    return graph.scan(_compiler(spark, sf_dir).nodes(check=False, labels=["Customer"]), "Customer", "properties['segment'] = 'BUILDING'", ["name"])


def graph_catalog(spark, sf_dir):
    c = _compiler(spark, sf_dir)
    return graph.catalog(c.nodes(check=False), c.edges()).where("kind = 'edge'").select("label", "src_label", "dst_label", "n")


def graph_store_reload(spark, sf_dir):
    c, path = _compiler(spark, sf_dir), _folder(spark)
    for _ in range(2):
        nodes, edges = files.graph_or_build(spark, path, lambda: (c.nodes(check=False), c.edges("PLACED")))
    return graph.label_counts(nodes).union(graph.label_counts(edges))


# --- traces and memory -------------------------------------------------------------------


def trace_redact_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(fx.redact_values(F.col("text"))).alias("digest"))


def trace_span_tree(spark, sf_dir):
    """Conversations as sessions, user messages as turns and the rest as their inferences."""
    messages = trace.with_turns(table(spark, sf_dir, "conversations"))
    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("user_turn").cast("string"))
    turns = messages.where("role = 'user'").select(key.alias("span_id"), F.col("conv_id").cast("string").alias("parent_span_id"))
    calls = messages.where("role = 'assistant'").select(F.concat(key, F.lit("/"), F.col("turn").cast("string")).alias("span_id"), key.alias("parent_span_id"))
    sessions = messages.select(F.col("conv_id").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id")).distinct()
    return trace.span_tree(sessions.union(turns).union(calls), 3).groupBy("depth").agg(F.count("*").alias("n"), F.sum("n_children").alias("children")).select(F.col("depth").cast("bigint").alias("depth"), "n", "children")


def trace_usage_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("reported", F.when(F.col("turn") % 2 == 0, F.length("text").cast("long")))
    return c.groupBy("role").agg(F.sum(trace.usage(F.col("reported"), F.col("text"))).alias("tokens"))


def memory_turns(spark, sf_dir):
    return trace.with_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "user_turn")


def memory_keep_zone(spark, sf_dir):
    return trace.keep_zone(table(spark, sf_dir, "conversations"), 2).where("kept").select("conv_id", "turn")


def memory_budget(spark, sf_dir):
    return trace.within_budget(table(spark, sf_dir, "conversations"), 500).select("conv_id", "turn")


def memory_last_messages(spark, sf_dir):
    return trace.last_messages(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn")


# --- scoring -----------------------------------------------------------------------------


def score_resultset_equal(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    doubled = n.union(n)
    cases = [("same", n, n), ("reordered rows", n, n.orderBy(F.desc("n_name"))), ("fewer columns", n, n.drop("n_name")), ("one missing", n, n.where("n_nationkey > 0")), ("doubled", doubled, n)]
    return spark.createDataFrame([(k, scoring.same_rows(a, b)) for k, a, b in cases], "name string, equal boolean")


# --- sources -----------------------------------------------------------------------------


def source_csv_infer(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "part").select([F.when(F.col("p_partkey") % 7 != 0, F.col(c).cast("string")).alias(c) for c in ("p_size", "p_retailprice", "p_name")]).write.option("header", True).csv(path)
    read = files.infer_types(files.read_csv(spark, path, schema="p_size string, p_retailprice string, p_name string"))
    kinds = dict(read.dtypes)
    return read.agg(F.count("*").alias("n"), F.count("p_size").alias("n_size"), F.sum("p_size").alias("size"), F.round(F.sum("p_retailprice"), 2).alias("price")).withColumn("types", F.lit(",".join(kinds[c] for c in ("p_size", "p_retailprice", "p_name"))))


def source_schema_scan(spark, sf_dir):
    sources = files.Sources(spark)
    for t in ("nation", "region"):
        sources.add(t, "parquet", f"{sf_dir}/{t}.parquet")
    return spark.createDataFrame([(c.table, c.column, c.type) for c in files.schema_scan(sources)], "table_name string, column_name string, kind string")


def source_auto_model(spark, sf_dir):
    sources = files.Sources(spark)
    for t in ("documents", "labels", "events"):
        sources.add(t, "parquet", f"{sf_dir}/{t}.parquet")
    model = files.model_from_schema("auto", sources, {"documents": ["doc_id"]})
    return spark.createDataFrame([(d.name, sum(f.is_dimension for f in d.fields), len(d.fields)) for d in model.datasets], "dataset string, dimensions long, fields long")


def total_count(spark, sf_dir):
    rows, total = star(spark, sf_dir).rows("SELECT order_key FROM orders", 100)
    return spark.createDataFrame([(len(rows), total)], "returned long, total long")


def ground_truth(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("toxic").cast("long").alias("task_id"), F.col("doc_id").alias("position"), (F.col("quality") == 0).alias("score"))
    return files.first_scored(rows).select("task_id", "position")


# --- extras ------------------------------------------------------------------------------


def extra_tumbling(spark, sf_dir):
    return plain_types(streams.windowed(table(spark, sf_dir, "events"), "1 day").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"))


def extra_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "30 minutes").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"))


_NAMES = """catalog_fields catalog_metrics catalog_ddl validate_violations lineage_nodes lineage_edges lineage_slices lineage_orphans
entity_nodes_count entity_edges_count entity_composite_key entity_union_source entity_join_source entity_orphans entity_edge_condition entity_duplicate_keys
graph_one_hop graph_two_hop_count graph_common_neighbors graph_bought_together graph_single_brand graph_degree graph_edge_types graph_neighbors graph_node_lookup graph_label_scan graph_catalog graph_store_reload
trace_redact_values trace_span_tree trace_usage_fallback memory_turns memory_keep_zone memory_budget memory_last_messages
score_resultset_equal 
source_csv_infer source_schema_scan source_auto_model total_count ground_truth extra_tumbling extra_sessions"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_TURNS = "select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as user_turn from conversations"
_PLACED = "select 'Customer:' || o_custkey as src, 'Order:' || o_orderkey as dst, 'PLACED' as label from orders"
_CONTAINS = "select 'Order:' || l_orderkey as src, 'Part:' || l_partkey as dst, 'CONTAINS' as label from lineitem"
_BULK = "select 'Supplier:' || l_suppkey as src, 'Part:' || l_partkey as dst, 'BULK' as label from lineitem where l_quantity > 45"
_LOST = "select distinct 'Part:' || l_partkey as id from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)"
_NODE_COUNTS = f"""
    select 'Customer' as label, count(*) as n from customer union all select 'Part', (select count(*) from part where p_size > 25) + (select count(*) from ({_LOST}))
    union all select 'Supplier', count(*) from supplier union all select 'Order', count(*) from orders
    union all select 'Stock', count(*) from (select distinct l_partkey, l_suppkey from lineitem)
    union all select 'Place', count(*) from (select n_name from nation union select r_name from region) union all select 'Seat', count(*) from nation"""
ORACLE = {
    "catalog_fields": "from (values ('sales', 13, 4, 2), ('orders', 9, 6, 3), ('customers', 5, 2, 0), ('parts', 6, 3, 0), ('suppliers', 4, 1, 0), ('nations', 3, 1, 0), ('regions', 2, 1, 0), ('activity', 7, 3, 2)) t(dataset, fields, dimensions, time_dimensions) select dataset, cast(fields as bigint) as fields, cast(dimensions as bigint) as dimensions, cast(time_dimensions as bigint) as time_dimensions",
    "catalog_metrics": "select * from (values ('net_revenue', 'sales'), ('gross_revenue', 'sales'), ('line_count', 'sales'), ('units', 'sales'), ('order_count', 'orders'), ('avg_order_value', 'orders'), ('revenue_per_customer', 'orders,sales'), ('return_rate', 'sales'), ('avg_discount', 'sales'), ('event_count', 'activity'), ('active_users', 'activity'), ('event_value', 'activity'), ('total_part_size', 'parts')) t(metric, datasets)",
    "validate_violations": "select * from (values ('sum of metric', 'R1'), ('ungrouped', 'R2'), ('missing join', 'R3'), ('metric in where', 'R4'), ('metric in group by', 'R5'), ('after a cte', '')) t(name, rules)",
    "lineage_orphans": "select * from (values ('dangling', 'dataset:none'), ('metric without source', 'metric:units')) t(problem, id)",
    "entity_nodes_count": _NODE_COUNTS,
    "entity_edges_count": f"select label, count(*) as n from ({_PLACED} union all {_CONTAINS} union all {_BULK}) group by label",
    "entity_composite_key": "select distinct 'Stock:' || l_partkey || '|' || l_suppkey as id from lineitem",
    "entity_union_source": "select 'Place:' || n_name as id, n_name as name from nation union select 'Place:' || r_name, r_name from region",
    "entity_join_source": "select 'Seat:' || n_nationkey as id, n_name as nation, r_name as region from nation join region on n_regionkey = r_regionkey",
    "entity_orphans": f"select id, 'Part' as label, 'Unknown_Part' as name from ({_LOST})",
    "entity_edge_condition": f"select src, count(*) as n from ({_BULK}) group by src",
    "entity_duplicate_keys": "select 'Line:' || l_orderkey || '|' || l_linenumber as id, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1",
    "graph_one_hop": f"select src as customer, dst as \"order\" from ({_PLACED})",
    "graph_two_hop_count": f"select p.src as customer, count(*) as n from ({_PLACED}) p join ({_CONTAINS}) c on p.dst = c.src group by p.src having count(*) >= 60",
    "graph_common_neighbors": f"with l as (select distinct src, dst from ({_BULK})) select x.src as a, y.src as b, count(*) as n from l x join l y on x.dst = y.dst and x.src < y.src group by all having count(*) >= 3",
    "graph_bought_together": f"with l as (select distinct dst as part, src as o from ({_CONTAINS})) select x.part as a, y.part as b, count(*) as n from l x join l y on x.o = y.o and x.part < y.part group by all having count(*) >= 2",
    "graph_single_brand": "select l_orderkey as \"order\", min(p_brand) as brand, count(*) as n from lineitem join part on l_partkey = p_partkey group by l_orderkey having count(*) >= 2 and count(distinct p_brand) = 1",
    "graph_degree": f"with e as ({_PLACED}) select id, cast(sum(o) as bigint) as n_out, cast(sum(i) as bigint) as n_in from (select src as id, 1 as o, 0 as i from e union all select dst, 0, 1 from e) group by id",
    "graph_edge_types": "select * from (values ('PLACED'), ('CONTAINS'), ('BULK')) t(label)",
    "graph_neighbors": f"select 'out' as direction, label, dst as other from ({_PLACED} union all {_CONTAINS} union all {_BULK}) where src = 'Order:1' union all select 'in', label, src from ({_PLACED} union all {_CONTAINS} union all {_BULK}) where dst = 'Order:1'",
    "graph_node_lookup": "select 'Supplier:' || s_suppkey as id, 'Supplier' as label, s_name as name from supplier where s_suppkey = 7",
    "graph_label_scan": "select 'Customer:' || c_custkey as id, c_name as name from customer where c_mktsegment = 'BUILDING'",
    "graph_catalog": f"select label, split_part(src, ':', 1) as src_label, split_part(dst, ':', 1) as dst_label, count(*) as n from ({_PLACED} union all {_CONTAINS} union all {_BULK}) group by all",
    "graph_store_reload": f"select * from ({_NODE_COUNTS}) union all select 'PLACED', count(*) from orders",
    "trace_redact_values": "select doc_id, md5(regexp_replace(text, '(?i)(authorization|x-api-key|password|api_key|secret|bearer|token)\\s*[:=]\\s*[^,;]+', '\\1=***', 'g')) as digest from documents",
    "trace_span_tree": "select cast(0 as bigint) as depth, count(distinct conv_id) as n, count(*) filter (role = 'user') as children from conversations union all select 1, count(*) filter (role = 'user'), count(*) filter (role = 'assistant') from conversations union all select 2, count(*) filter (role = 'assistant'), 0 from conversations",
    "trace_usage_fallback": "select role, cast(sum(case when turn % 2 = 0 then length(text) else ceil(length(text) / 4) end) as bigint) as tokens from conversations group by role",
    "memory_turns": f"select conv_id, turn, cast(user_turn as bigint) as user_turn from ({_TURNS})",
    "memory_keep_zone": f"with t as ({_TURNS}) select conv_id, turn from t where user_turn > (select max(user_turn) from t u where u.conv_id = t.conv_id) - 2",
    "memory_budget": f"with t as (select *, cast(ceil(length(text) / 4) as bigint) as tokens from ({_TURNS})), s as (select *, sum(case when role = 'system' then tokens else 0 end) over (partition by conv_id) as fixed, sum(case when role = 'system' then 0 else tokens end) over (partition by conv_id order by user_turn desc range between unbounded preceding and current row) as after, max(user_turn) over (partition by conv_id) as last from t) select conv_id, turn from s where role = 'system' or user_turn = last or fixed + after <= 500",
    "memory_last_messages": "select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as r from conversations) where r <= 3",
    "score_resultset_equal": "select * from (values ('same', true), ('reordered rows', true), ('fewer columns', false), ('one missing', false), ('doubled', false)) t(name, equal)",
    "source_csv_infer": "select count(*) as n, count(*) filter (p_partkey % 7 <> 0) as n_size, cast(sum(p_size) filter (p_partkey % 7 <> 0) as bigint) as size, round(sum(p_retailprice) filter (p_partkey % 7 <> 0), 2) as price, 'bigint,double,string' as types from part",
    "source_schema_scan": "select * from (values ('nation', 'n_nationkey', 'int'), ('nation', 'n_name', 'string'), ('nation', 'n_regionkey', 'int'), ('region', 'r_regionkey', 'int'), ('region', 'r_name', 'string')) t(table_name, column_name, kind)",
    "source_auto_model": "select d as dataset, cast(x as bigint) as dimensions, cast(f as bigint) as fields from (values ('documents', 3, 5), ('labels', 0, 3), ('events', 3, 6)) t(d, x, f)",
    "total_count": "select cast(100 as bigint) as returned, count(*) as total from orders",
    "ground_truth": "select cast(toxic as bigint) as task_id, min(doc_id) as position from labels where quality = 0 group by toxic",
    "extra_sessions": "with e as (select *, coalesce(ts > lag(ts) over w + interval 30 minutes, true) as opens from events window w as (partition by user_id order by ts)) select user_id, cast(count(*) filter (opens) as bigint) as n_sessions, cast(count(*) as bigint) as n from e group by user_id",
    "extra_tumbling": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
}

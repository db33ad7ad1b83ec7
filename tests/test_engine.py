import warnings

import pytest

from veridex.plans import ddl, planner
from veridex.plans.catalogue import star
from veridex.plans.engine import Engine
from veridex.plans.errors import AmbiguousMetric, DatasetNotFound, FieldNotFound, JoinPathError, QueryNotAllowed, RuleViolation, SemanticError
from veridex.plans.model import Dataset, Expression, Metric, SemanticModel, dimension, plain
from veridex.plans.rules import RULES, Rule


@pytest.fixture(scope="module")
def engine(spark, sf):
    return star(spark, sf)


def rules(engine, sql):
    return [v.split(":")[0] for v in engine.validate(sql)]


@pytest.mark.parametrize(
    "sql, wanted",
    [
        ("SELECT SUM(net_revenue) FROM sales", ["R1"]),
        ("SELECT return_flag, AVG(s.net_revenue) FROM sales s GROUP BY return_flag", ["R1"]),
        ("SELECT return_flag, SUM(net_revenue) OVER (PARTITION BY return_flag) AS x FROM sales GROUP BY return_flag", ["R1"]),
        ("SELECT ROUND(net_revenue, 1) AS r FROM sales", []),
        ("SELECT return_flag, net_revenue FROM sales", ["R2"]),
        ("SELECT return_flag AS f, net_revenue AS r FROM sales", ["R2"]),
        ("SELECT return_flag, line_status, net_revenue FROM sales GROUP BY return_flag", ["R2"]),
        ("SELECT UPPER(return_flag) AS u, net_revenue FROM sales", ["R2"]),
        ("SELECT UPPER(return_flag) AS u, net_revenue FROM sales GROUP BY UPPER(return_flag)", []),
        ("SELECT order_key, net_revenue FROM sales", ["R2"]),
        ("SELECT return_flag, net_revenue FROM sales GROUP BY 1", []),
        ("SELECT return_flag, net_revenue FROM sales GROUP BY ALL", None),
        ("SELECT DISTINCT return_flag, net_revenue FROM sales", []),
        ("SELECT net_revenue, units FROM sales", []),
        ("SELECT return_flag, SUM(gross) AS g, net_revenue FROM sales GROUP BY return_flag", []),
        ("SELECT avg_order_value FROM sales", ["R3"]),
        ("SELECT revenue_per_customer FROM sales", ["R3"]),
        ("SELECT revenue_per_customer FROM sales s JOIN orders o ON s.order_key = o.order_key", []),
        ("SELECT return_flag FROM sales GROUP BY return_flag HAVING order_count > 1", ["R3"]),
        ("SELECT return_flag FROM sales WHERE net_revenue > 1 GROUP BY return_flag", ["R4"]),
        ("SELECT return_flag FROM sales GROUP BY return_flag HAVING net_revenue > 1", []),
        ("WITH m AS (SELECT part_key, net_revenue FROM sales GROUP BY part_key) SELECT part_key FROM m WHERE net_revenue > 1", []),
        ("SELECT t.part_key FROM (SELECT part_key, net_revenue FROM sales GROUP BY part_key) t WHERE t.net_revenue > 1", []),
        ("SELECT return_flag FROM sales GROUP BY return_flag, net_revenue", ["R5"]),
        ("SELECT x FROM (SELECT SUM(net_revenue) AS x FROM sales) t", ["R1"]),
        ("WITH a AS (SELECT return_flag, net_revenue FROM sales) SELECT * FROM a", ["R2"]),
        ("SELECT part_key FROM parts WHERE size > (SELECT net_revenue FROM sales)", []),
        ("SELECT part_key FROM parts WHERE EXISTS (SELECT 1 FROM sales s WHERE s.part_key = parts.part_key AND s.units > 3)", ["R4"]),
        ("SELECT net_revenue FROM sales UNION ALL SELECT SUM(event_value) FROM activity", ["R1"]),
    ],
)
def test_rules(engine, sql, wanted):
    if wanted is not None:
        assert rules(engine, sql) == wanted


def test_all_violations_and_the_first(engine):
    sql = "SELECT line_status, SUM(net_revenue), avg_order_value FROM sales WHERE units > 1"
    assert set(rules(engine, sql)) == {"R1", "R2", "R3", "R4"}
    with pytest.raises(RuleViolation) as found:
        engine.validate_strict(sql)
    assert found.value.rule == "R1"


def test_own_rules(spark, sf):
    class NoStar(Rule):
        name = "X"

        def check(self, scope, checker):
            return ["no star"] if any(i.star for i in scope.items) else []

    base = star(spark, sf)
    own = Engine(spark, base.model, base.sources, rules=(*RULES, NoStar()))
    assert own.validate("SELECT * FROM regions") == ["X: no star"]


def same(engine, logical, physical):
    a, b = engine.sql(logical), physical
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_splice_keeps_aliases_and_text(engine):
    t = engine.translate("SELECT s.return_flag, s.net_revenue FROM sales s GROUP BY s.return_flag HAVING s.net_revenue > 1 ORDER BY s.net_revenue").physical
    assert "SUM(`s`.`net`)" in t and "AS `net_revenue`" in t and t.endswith("ORDER BY (SUM(`s`.`net`))")
    assert engine.translate("SELECT 'net_revenue 🎉' AS t, net_revenue FROM sales").physical.startswith("SELECT 'net_revenue 🎉' AS t, (SUM(")


def test_unqualified_metric_in_having_with_alias(engine, spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    same(engine, "SELECT s.return_flag FROM sales s GROUP BY s.return_flag HAVING line_count > 10", lines.groupBy("l_returnflag").count().where("count > 10").select("l_returnflag"))


def test_metric_from_cte_is_not_expanded_again(engine):
    t = engine.translate("WITH m AS (SELECT part_key, net_revenue FROM sales GROUP BY part_key) SELECT m.net_revenue, net_revenue AS again FROM m").physical
    assert t.count("SUM(") == 1


def test_cte_hides_a_dataset(engine):
    assert engine.sql("WITH sales AS (SELECT 1 AS net_revenue) SELECT net_revenue FROM sales").collect()[0][0] == 1


def test_duplicate_dataset_needs_a_qualifier(engine):
    sql = "SELECT {} FROM nations a JOIN sales s ON a.nation_key = s.line_no JOIN sales t ON s.order_key = t.order_key"
    with pytest.raises(AmbiguousMetric, match="s.net_revenue|s, t"):
        engine.sql(sql.format("net_revenue"))
    assert "`t`.`net`" in engine.translate(sql.format("t.net_revenue")).physical


def test_metric_text_in_physical_names(spark):
    m = SemanticModel("m", (Dataset("cards", "raw", (plain("amount", "eur_amount"), dimension("kind", "type"))),), (), (Metric("a", Expression.parse("SUM(eur_amount)")), Metric("b", Expression.parse("SUM(raw.eur_amount)")), Metric("c", Expression.parse("SUM(cards.amount)"))))
    e = Engine(spark, m, {"raw": spark.createDataFrame([(1.0, "x"), (2.0, "y")], "eur_amount double, type string")})
    assert [tuple(r) for r in e.sql("SELECT a, b, c FROM cards").collect()] == [(3.0, 3.0, 3.0)]


def test_ambiguous_unqualified_metric_column(spark):
    m = SemanticModel("m", (Dataset("p", "p", (plain("x"),)), Dataset("q", "q", (plain("x"),))), (), (Metric("a", Expression.parse("SUM(x)")),))
    with pytest.raises(AmbiguousMetric):
        Engine(spark, m, {"p": spark.range(1).selectExpr("id as x"), "q": spark.range(1).selectExpr("id as x")}).sql("SELECT a FROM p")


def test_errors_name_logical_things(engine):
    with pytest.raises(DatasetNotFound, match="activity"):
        engine.sql("SELECT 1 FROM nowhere")
    with pytest.raises(FieldNotFound, match="segment is a field of customers"):
        engine.sql("SELECT segment FROM sales")
    with pytest.raises(SemanticError, match="empty"):
        engine.sql("  ")
    assert engine.logical_names("no l_extendedprice in lineitem, xl_tax") == "no gross in sales, xl_tax"


@pytest.mark.parametrize("sql", ["DROP TABLE sales", "INSERT INTO sales VALUES (1)", "CREATE TABLE x AS SELECT 1", "SELEC 1", "SET a=b", "SHOW TABLES"])
def test_only_queries(engine, sql):
    with pytest.raises(QueryNotAllowed):
        engine.sql(sql)


def test_star_gives_logical_columns(engine):
    assert engine.sql("SELECT * FROM regions").columns == ["region_key", "region_name"]


def test_scan_is_pruned_and_pushed(engine):
    plan = engine.sql("SELECT return_flag, units FROM sales WHERE return_flag = 'R' GROUP BY return_flag")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_rows_and_markdown(engine):
    rows, total = engine.rows("SELECT nation_name FROM nations", 3)
    assert (len(rows), total) == (3, 25)
    rows, total = engine.rows("SELECT nation_name FROM nations LIMIT 5", 3)
    assert (len(rows), total) == (3, 3)
    assert len(engine.rows("SELECT nation_name FROM nations", 0)[0]) == 25
    assert "3 of 25 rows" in engine.markdown("SELECT nation_name FROM nations", 3)
    assert engine.markdown("SELECT nation_name FROM nations WHERE nation_key < 0") == "no rows"


def test_planner(engine):
    with pytest.raises(JoinPathError, match="several paths"):
        engine.query(["net_revenue"], ["nation_name"])
    with pytest.raises(JoinPathError, match="no path"):
        engine.query(["net_revenue", "event_count"])
    with pytest.raises(FieldNotFound):
        engine.query(["nothing"])
    with pytest.raises(FieldNotFound, match="several datasets"):
        engine.query(["event_count"], ["nation_key"])
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        engine.query(["net_revenue", "total_part_size"], ["return_flag"], via=[])
    assert any("once per row of" in str(w.message) for w in seen)
    assert [r.name for r in planner.direct(engine.model, "orders", "sales")] == ["sales_orders"]
    assert engine.query(["order_count"], ["segment"], order_by=["order_count DESC"], limit=2).count() == 2


def test_ddl(engine):
    text = ddl.table(engine, "sales")
    assert "return_flag STRING, -- [DIMENSION]; Returned" in text and "[TIME_DIMENSION]" in text and "FK to orders.order_key" in text
    assert "revenue_per_customer VIRTUAL" in text and "requires JOIN with orders" in text
    assert "referenced by sales.order_key" in ddl.table(engine, "orders") and "PRIMARY KEY (order_key)" in ddl.table(engine, "orders")
    assert ddl.table(engine, "zz").startswith("-- no dataset zz")
    assert "also called client, buyer" in ddl.prompt(engine, ["customers"]) and "R5" in ddl.prompt(engine)


def test_search(engine):
    assert ("dataset", "customers") in engine.search("buyer") and ("metric", "net_revenue") in engine.search("after discount")

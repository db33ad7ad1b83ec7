"""Graph text, entity mappings, reasoning documents, redaction and answers on small cases."""

import pytest
from pyspark.sql import functions as F

from veridex.functions import text as fx
from veridex.operators import entity_graph as eg
from veridex.operators import pattern, reasoning, trace
from veridex.plans.errors import GraphError


@pytest.fixture(scope="module")
def people(spark):
    nodes = [("P:1", "Person", {"name": "Ann", "age": "31"}), ("P:2", "Person", {"name": "Bo", "age": "9"}), ("P:3", "Person", {"name": "O'Neil {x}"}), ("C:1", "City", {"name": "Ulm"})]
    edges = [("P:1", "P:2", "KNOWS", {"since": "2001"}), ("P:2", "P:3", "KNOWS", {}), ("P:1", "C:1", "LIVES", {}), ("P:3", "C:1", "LIVES", {}), ("P:3", "P:3", "KNOWS", {})]
    return spark.createDataFrame(nodes, "id string, label string, properties map<string,string>"), spark.createDataFrame(edges, "src string, dst string, label string, properties map<string,string>")


def rows(people, text):
    return sorted((tuple(r) for r in pattern.query(*people, text).collect()), key=repr)


@pytest.mark.parametrize(
    "text, want",
    [
        ("MATCH (n) RETURN COUNT(*) AS cnt", [(4,)]),
        ("MATCH ()-[e]->() RETURN COUNT(e) AS cnt", [(5,)]),
        ("MATCH (a:Person)-[:KNOWS]->(b:Person) RETURN a.name, b.name", [("Ann", "Bo"), ("Bo", "O'Neil {x}"), ("O'Neil {x}", "O'Neil {x}")]),
        ("MATCH (a:Person {name: 'Ann'})-[:KNOWS]->()-[:KNOWS]->(c) RETURN c.name AS n", [("O'Neil {x}",)]),
        ('MATCH (a {name: "O\'Neil {x}"}) RETURN a.id', [("P:3",)]),
        ("match (a:Person) where a.age > 10 or a.age is null return a.id order by a.id", [("P:1",), ("P:3",)]),
        ("MATCH (a:Person) WHERE a.age < 10 RETURN a.id", [("P:2",)]),
        ("MATCH (a)-[e:KNOWS {since: 2001}]->(b) RETURN a.id, b.id", [("P:1", "P:2")]),
        ("MATCH (c:City)<-[:LIVES]-(p) RETURN c.name AS city, COUNT(p) AS n", [("Ulm", 2)]),
        ("MATCH (a)-[:LIVES]-(b:Person) RETURN COUNT(*) AS n", [(2,)]),
        ("MATCH (a)-[:KNOWS]->(a) RETURN a.id", [("P:3",)]),
        ("MATCH (a:Person)-[:KNOWS]->(b), (a)-[:LIVES]->(c:City) RETURN a.id, c.id", [("P:1", "C:1"), ("P:3", "C:1")]),
        ("MATCH (a)-[e:KNOWS|LIVES]->(b) RETURN DISTINCT label(e) AS rel", [("KNOWS",), ("LIVES",)]),
        ("MATCH (p:Person) RETURN p.name AS name ORDER BY name DESC SKIP 1 LIMIT 1", [("Bo",)]),
        ("MATCH (p:Person) WHERE p.name CONTAINS 'n' AND NOT p.name ENDS WITH 'o' RETURN SUM(p.age) AS s", [(31.0,)]),
        ("MATCH (p:Person) WHERE p.name IN ['Bo', 'Cy'] OR p.age * 2 = 62 RETURN COUNT(DISTINCT p) AS n", [(2,)]),
    ],
)
def test_patterns(people, text, want):
    assert rows(people, text) == sorted(want, key=repr)


def test_a_whole_node_and_its_default_name(people):
    found = pattern.query(*people, "MATCH (c:City) RETURN c, c.name").first()
    assert found["c"].asDict() == {"id": "C:1", "label": "City", "properties": {"name": "Ulm"}} and found["c.name"] == "Ulm"


@pytest.mark.parametrize("text", ["", "RETURN 1", "MATCH (a RETURN a", "MATCH (a) RETURN b.x", "MATCH (a) RETURN z", "MATCH (a)-[e]->(b) MATCH (e) RETURN e", "MATCH (a) RETURN a LIMIT x", "MATCH (a:B:C) RETURN ;", "MATCH (a) RETURN a extra"])
def test_broken_patterns(people, text):
    with pytest.raises(GraphError):
        pattern.query(*people, text)


# --- entities --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cards(spark):
    frames = {
        "users": spark.createDataFrame([(1, "Alice"), (2, "Bob")], "id int, name string"), "cards": spark.createDataFrame([("C001", 1, 7), ("C002", 2, 8), ("C003", 999, 7)], "card_id string, owner_id int, bank int"),
        "banks": spark.createDataFrame([(7,)], "bank int"),
    }
    return frames.__getitem__


def mapping(**more):
    nodes = (
        eg.NodeMapping("User", ("id",), ("users",), properties={"name": "name"}), eg.NodeMapping("Bank", ("bank",), ("banks",)),
        eg.NodeMapping("BankCard", ("card_id",), ("cards",), parent=eg.Parent("User", ("owner_id",)), parents=(eg.Parent("Bank", ("bank",)),)),
    )
    return eg.Mapping(nodes, (eg.EdgeMapping("OWNS", "cards", "User", ("owner_id",), "BankCard", ("card_id",)),))


def test_orphans_of_several_parents(cards):
    c = eg.Compiler(mapping(), cards)
    found = {r.id: r.properties.get("name") for r in c.nodes().collect()}
    assert found == {"User:1": "Alice", "User:2": "Bob", "User:999": "Unknown_User", "Bank:7": None, "Bank:8": "Unknown_Bank", "BankCard:C001": None, "BankCard:C002": None, "BankCard:C003": None}
    for id_, name in found.items():
        assert [(r.id, r.properties.get("name")) for r in c.lookup(id_).collect()] == [(id_, name)]
    assert c.lookup("User:5").count() == c.lookup("Cat:1").count() == c.lookup("User:x").count() == 0
    assert {r.id for r in c.nodes(labels=["User"]).collect()} == {"User:1", "User:2", "User:999"}
    assert [(r.direction, r.label, r.other) for r in c.neighbours("User:999").collect()] == [("out", "OWNS", "BankCard:C003")]


def test_a_duplicate_key_over_united_tables_is_an_error(cards):
    twice = eg.Mapping((eg.NodeMapping("User", ("id",), ("users", "users")),))
    with pytest.raises(GraphError, match="occurs 2 times"):
        eg.Compiler(twice, cards).nodes()


def test_a_lookup_filters_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) as name").write.parquet(f"{tmp_path}/users")
    c = eg.Compiler(eg.Mapping((eg.NodeMapping("User", ("id",), ("users",), properties={"name": "name"}),)), lambda n: spark.read.parquet(f"{tmp_path}/{n}"))
    df = c.lookup("User:7")
    assert "EqualTo(id,7)" in df._jdf.queryExecution().executedPlan().toString() and df.first().properties["name"] == "7"


# --- reasoning -------------------------------------------------------------------------


def test_synonyms_merge_into_the_fact_that_the_edge_starts_from(spark):
    facts = spark.createDataFrame([("f1", None), ("f2", None), ("f3", "old")], "id string, merged_into string")
    edges = spark.createDataFrame([("f1", "f2", "equivalent_to", None, True), ("f1", "f3", "equivalent_to", None, False), ("f2", "f2", "equivalent_to", None, True)], reasoning.EDGES)
    assert {r.id: r.merged_into for r in reasoning.merge_synonyms(facts, edges).collect()} == {"f1": None, "f2": "f1", "f3": "old"}


def test_cycles_end(spark):
    facts = spark.createDataFrame([(x, None) for x in "abcd"], "id string, merged_into string")
    edges = spark.createDataFrame([(a, b, "equivalent_to", None, True) for a, b in ("ab", "bc", "cd")], reasoning.EDGES)
    assert {r.id: r.merged_into for r in reasoning.merge_synonyms(facts, edges, transitive=True).collect()} == {"a": None, "b": "a", "c": "a", "d": "a"}


def test_two_ontologies_at_once(spark):
    frame = lambda rows: spark.createDataFrame([(i, p, True) for i, p in rows], "id string, parent_id string, is_ontology boolean")
    a, b = reasoning.ontology_paths(frame([("x", None), ("y", "x")])), reasoning.ontology_paths(frame([("z", None)]))
    assert sorted(r.path for r in a.collect()) == ["x", "x>y"] and [r.path for r in b.collect()] == ["z"]


# --- redaction, memory, answers --------------------------------------------------------


@pytest.mark.parametrize("key, sensitive", [("api_key", True), ("API_KEY", True), ("x-api-key", True), ("my_api_key", True), ("auth.token.value", True), ("token_count", False), ("api_key_v2", False), ("authorization_header", False), ("page_token", False), ("bearer", True), ("name", False)])
def test_sensitive_keys(spark, key, sensitive):
    from pyspark.sql import functions as F

    assert fx.is_sensitive(key) is sensitive
    assert spark.range(1).select(fx._sensitive_key(F.lit(key))).first()[0] is sensitive


def test_values_lose_their_secret(spark):
    from pyspark.sql import functions as F

    texts = ["Authorization: Bearer sk-abc123", "a=1; password = x y, b=2", "x-api-key:k;z", "plain"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fx.redact_values(F.col("t"))).collect()]
    assert got == ["Authorization=***", "a=1; password=***, b=2", "x-api-key=***;z", "plain"]


def test_old_results_become_a_marker(spark):
    rows = [(1, 0, "user", None, "q"), (1, 1, "tool", "sql", "long result"), (1, 2, "user", None, "q2"), (1, 3, "tool", "sql", "new result")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, name string, text string")
    assert [r.text for r in trace.clear_results(df, 1).orderBy("turn").collect()] == ["q", "[cleared: sql]", "q2", "new result"]
    assert [r.text for r in trace.clear_results(df, 5).orderBy("turn").collect()] == ["q", "long result", "q2", "new result"]


@pytest.mark.parametrize(
    "kind, given, wanted, equal",
    [
        ("number", "The answer is 7", "7", True), ("number", "5%", "5", True), ("number", "2.50", "2.5", True), ("number", "3.141593", "3.14159265", True), ("number", "8", "7", False), ("number", "none", "none", True),
        ("number", "0.000001", "0", True), ("list", "b a", "a, b", True), ("list", "a;b", "b,a", True), ("list", "A", "a", False), ("grouped_list", "x: 2; y: 1", "y:1.0;x:2.0", True), ("grouped_list", "x: 2", "x: 3", False),
        ("text", " Yes", "yes", True), ("text", "Not Applicable", "not applicable", True), ("number", "Not applicable", "7", False), ("text", None, None, True), ("text", None, "a", False),
    ],
)
def test_answers(spark, kind, given, wanted, equal):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(kind, given, wanted)], "k string, g string, w string")
    assert df.select(fx.answers_match(F.col("g"), F.col("w"), F.col("k"))).first()[0] is equal


@pytest.mark.parametrize("given, wanted, equal", [("1,200", "1200", True), ("5%", "5", True), ("1.00005", "1", True), ("1.0002", "1", False), ("Abc", "abc ", True), ("0", "0.0", True), ("0.1", "0", False), ("a", "b", False), (None, None, True)])
def test_numeric_match(spark, given, wanted, equal):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(given, wanted)], "g string, w string").select(fx.numeric_match(F.col("g"), F.col("w"))).first()[0] is equal


def test_inherited_counts_match_their_sql_on_repeated_rows(spark, sf, tmp_path):
    """Repeated and null keys count row by row, as in the query's SQL."""
    import duckdb

    from veridex.plans.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        if t in ("customer", "supplier"):
            key = {"customer": "c_custkey", "supplier": "s_suppkey"}[t]
            df = df.union(df.where(f"{key} < 3")).union(df.where(f"{key} = 4").withColumn(key, F.lit(None).cast(df.schema[key].dataType)))
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    found = sorted(tuple(r) for r in QUERIES["reason_inherited_tables"](spark, str(tmp_path)).select("id", "n").collect() if r.id is not None)
    assert found == sorted(r for r in con.execute(ORACLE["reason_inherited_tables"]).fetchall() if r[0] is not None)


def test_inherited_counts_never_pair_facts_with_edges(spark):
    """2.5 billion pairs, which would take hours one by one."""
    facts = spark.range(50_000).select(F.concat(F.lit("f"), "id").alias("id"), F.concat(F.lit("top>f"), "id").alias("path"))
    edges = spark.range(50_000).select(F.concat(F.lit("e"), "id").alias("src"), F.when(F.col("id") < 49_999, "top").otherwise("f7").alias("dst"), F.lit("references").alias("label"))
    found = reasoning.inherited_counts(facts, edges)
    assert found.agg(F.count("*"), F.sum("n")).first() == (50_000, 49_999 * 50_000 + 1) and found.where("id = 'f7'").first().n == 50_000
    few = facts.limit(30), edges.limit(40)
    assert sorted(map(tuple, reasoning.inherited_counts(*few).collect())) == sorted(map(tuple, reasoning.inherited_chain(*few).groupBy("id").count().collect()))

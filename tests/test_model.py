import json

import pytest
import yaml

from veridex.plans.catalogue import star_model
from veridex.plans.errors import ModelError
from veridex.plans.model import Dataset, Expression, Extension, Metric, Relationship, SemanticModel, Specification, dimension, plain, resolve_model, time_dimension


def model(**change):
    base = {"name": "m", "datasets": (Dataset("a", "t", (plain("x"), dimension("d"))), Dataset("b", "u", (plain("x"),))), "metrics": (Metric("total", Expression.parse("SUM(a.x)")),)}
    return SemanticModel(**(base | change))


def test_round_trip_by_yaml_and_json(tmp_path):
    for name in ("m.yaml", "m.json"):
        Specification((star_model(),), ("ANSI_SQL",), ("acme",)).save(tmp_path / name)
        back = Specification.load(tmp_path / name)
        assert back.models[0] == star_model() and back.dialects == ("ANSI_SQL",) and back.vendors == ("acme",)


def test_resolve(tmp_path):
    Specification((model(),)).save(tmp_path / "b.yaml")
    Specification((star_model(),)).save(tmp_path / "a.yaml")
    assert resolve_model(tmp_path).name == "star"
    assert resolve_model(str(tmp_path / "b.yaml")).name == "m"
    assert resolve_model(model()).name == "m"
    with pytest.raises(ModelError):
        resolve_model(tmp_path / "..") if not list((tmp_path / "..").glob("*.yaml")) else resolve_model(Specification(()))


def test_duplicates_are_refused():
    with pytest.raises(ModelError, match="duplicate dataset"):
        model(datasets=(Dataset("a", "t", (plain("x"),)), Dataset("a", "u", (plain("x"),))))
    with pytest.raises(ModelError, match="duplicate metric"):
        model(metrics=(Metric("m", Expression.parse("SUM(a.x)")),) * 2)
    with pytest.raises(ModelError, match="duplicate field"):
        Dataset("a", "t", (plain("x"), plain("x")))
    with pytest.raises(ModelError, match="duplicate relationship"):
        model(relationships=(Relationship("r", "a", "b", ("x",), ("x",)),) * 2)


def test_bad_references_are_refused():
    with pytest.raises(ModelError, match="no dataset"):
        model(relationships=(Relationship("r", "a", "zz", ("x",), ("x",)),))
    with pytest.raises(ModelError, match="same number"):
        Relationship("r", "a", "b", ("x", "y"), ("x",))
    with pytest.raises(ModelError):
        model(datasets=())
    with pytest.raises(ModelError, match="JSON"):
        Extension("acme", "{")


def test_unknown_keys_and_versions_are_refused():
    good = Specification((model(),)).to_dict()
    with pytest.raises(ModelError, match="unknown keys"):
        Specification.parse(good | {"extra": 1})
    with pytest.raises(ModelError, match="version"):
        Specification.parse(good | {"version": "9"})
    with pytest.raises(ModelError, match="missing key"):
        SemanticModel.parse({"datasets": [{"name": "a", "source": "t", "fields": []}]})


def test_dialects():
    e = Expression.parse({"SNOWFLAKE": "s", "ANSI_SQL": "CAST(x AS REAL)", "TABLEAU": "t"})
    assert e.sql == "CAST(x AS DOUBLE)"
    assert Expression.parse({"dialects": [{"dialect": "DATABRICKS", "expression": "d"}, {"dialect": "ANSI_SQL", "expression": "a"}]}).sql == "d"
    with pytest.raises(ModelError):
        Expression.parse({"COBOL": "x"})
    with pytest.raises(ModelError):
        Expression.parse({})


def test_fields():
    t = time_dimension("day", "to_date(ts)")
    assert t.is_dimension and t.is_time and t.is_computed and t.column is None
    assert plain("x", "`odd name`").column == "odd name"
    assert Specification.parse(yaml.safe_load(yaml.safe_dump(json.loads(json.dumps(Specification((model(),)).to_dict()))))).models[0] == model()

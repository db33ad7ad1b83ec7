"""DDL text of a model for people and assistants: tables with real types, comments, keys, and metrics as virtual columns."""

from __future__ import annotations

from veridex.plans.engine import Engine
from veridex.plans.model import AIContext

RULES_TEXT = """\
-- Rules
-- R1: a metric is an aggregate already: never put it inside SUM, AVG or another aggregate.
-- R2: dimensions and columns selected beside a metric belong in GROUP BY.
-- R3: join every dataset that a metric needs.
-- R4: filter metrics in HAVING, or in WHERE over a CTE that computed them.
-- R5: never group by a metric."""


def _hints(context: AIContext | None) -> list[str]:
    if context is None:
        return []
    out = [context.instructions] if context.instructions else []
    if context.synonyms:
        out.append("also called " + ", ".join(context.synonyms))
    return out + [f"e.g. {e}" for e in context.examples]


def table(engine: Engine, name: str) -> str:
    """CREATE TABLE of one dataset; an error comment if there is none of that name."""
    model = engine.model
    d = model.get(name)
    if d is None:
        return f"-- no dataset {name}; there are {', '.join(x.name for x in model.datasets)}"
    types = dict(engine.dataset(d.name).dtypes)
    lines = []
    for f in d.fields:
        notes = ["[TIME_DIMENSION]" if f.is_time else "[DIMENSION]"] if f.is_dimension else []
        notes += [f.description or f.label] if f.description or f.label else []
        for r in model.relationships:
            # both ends are told
            for end, own, other, theirs, arrow in ((r.many, r.many_columns, r.one, r.one_columns, "FK to"), (r.one, r.one_columns, r.many, r.many_columns, "referenced by")):
                if end.lower() == d.name.lower():
                    notes += [f"{arrow} {other}.{b}" for a, b in zip(own, theirs) if a.lower() in (f.name.lower(), (f.column or "").lower())]
        notes += _hints(f.ai_context)
        lines.append((f"  {f.name} {types[f.name].upper()}", "; ".join(notes)))
    for m in model.metrics:
        needed = engine.datasets_of(m.name)
        if d.name in needed:
            others = sorted(needed - {d.name})
            notes = ["[METRIC]", *([m.description] if m.description else []), m.expression.sql, *([f"requires JOIN with {', '.join(others)}"] if others else []), *_hints(m.ai_context)]
            lines.append((f"  {m.name} VIRTUAL", "; ".join(notes)))
    keys = [f"  PRIMARY KEY ({', '.join(d.primary_key)})"] * bool(d.primary_key) + [f"  UNIQUE ({', '.join(k)})" for k in d.unique_keys]
    body = [f"{text}{',' if k + 1 < len(lines) or keys else ''}" + (f" -- {note}" if note else "") for k, (text, note) in enumerate(lines)]
    body += [k + "," * (i + 1 < len(keys)) for i, k in enumerate(keys)]
    head = [f"-- {x}" for x in [d.description, *_hints(d.ai_context)] if x]
    return "\n".join([*head, f"CREATE TABLE {d.name} (", *body, ");"])


def tables(engine: Engine, names: list[str] | None = None) -> str:
    return "\n\n".join(table(engine, n) for n in names or [d.name for d in engine.model.datasets])


def prompt(engine: Engine, names: list[str] | None = None) -> str:
    """The rules, then the tables."""
    head = [f"-- Model {engine.model.name}" + (f": {engine.model.description}" if engine.model.description else ""), *[f"-- {h}" for h in _hints(engine.model.ai_context)]]
    return "\n".join([*head, RULES_TEXT, "", tables(engine, names)])

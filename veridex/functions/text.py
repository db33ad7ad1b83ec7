"""Column functions: redaction and answer matching."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

# Names whose values are never shown.
SENSITIVE = ("api_key", "password", "token", "secret", "authorization", "x-api-key", "bearer")
MASK = "***"


def is_sensitive(key: str, names: tuple[str, ...] = SENSITIVE) -> bool:
    """Whether a key names a secret: as a whole, as a dotted segment, or, for names of several words, as the last words of a longer key.

    So x-api-key is one by api_key, while token_count, page_token and api_key_v2 aren't.
    """
    key = key.lower()
    if key in names or set(key.split(".")) & set(names):
        return True
    words = re.split("[_-]", key)
    compound = [parts for n in names if len(parts := re.split("[_-]", n)) > 1]
    return len(words) > 1 and any(words[-len(parts) :] == parts for parts in compound)


def _sensitive_key(key: Column, names: tuple[str, ...] = SENSITIVE) -> Column:
    """is_sensitive as a column."""
    low = F.lower(key)
    plain = "|".join(re.escape(n) for n in names)
    compound = "|".join("[_-]".join(map(re.escape, parts)) for n in names if len(parts := re.split("[_-]", n)) > 1)
    return low.rlike(rf"(^|\.)({plain})(\.|$)") | low.rlike(rf"(^|[_-])({compound})$")


def redact_values(text: Column, names: tuple[str, ...] = SENSITIVE) -> Column:
    """key: value and key = value with a sensitive key become key=***, up to a comma or a semicolon."""
    keys = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)({keys})\s*[:=]\s*[^,;]+", "$1=" + MASK)


def redact_columns(df, names: list[str] | None = None):
    """Masks every column, struct field and map value under a sensitive name, at any depth; other strings lose key=value secrets."""

    def cleaned(c: Column, kind, name: str) -> Column:
        if is_sensitive(name):
            return F.when(c.isNotNull(), F.lit(MASK))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[cleaned(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: cleaned(x, kind.elementType, ""))
        if isinstance(kind, MapType) and isinstance(kind.valueType, StringType):
            return F.transform_values(c, lambda k, v: F.when(_sensitive_key(k), F.lit(MASK)).otherwise(redact_values(v)))
        return redact_values(c) if isinstance(kind, StringType) else c

    chosen = names or df.columns
    return df.select(*[cleaned(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) if f.name in chosen else F.col(f"`{f.name}`") for f in df.schema.fields])


def _double(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def numeric_match(given: Column, wanted: Column, tolerance: float = 1e-4) -> Column:
    """Equal numbers, or numbers within a relative tolerance, whatever their thousands' commas and a percent sign; else equal text whatever its case. Null matches null."""
    a, b = (F.trim(F.regexp_replace(F.trim(c), "%+$", "")) for c in (given, wanted))
    x, y = _double(a), _double(b)
    near = (x == y) | ((y != 0) & (F.abs(x - y) < tolerance * F.abs(y)))
    return F.coalesce(near, F.lit(False)) | F.lower(a).eqNullSafe(F.lower(b))


_NUMBER = r"[-+]?\d*\.?\d+"


def last_number(text: Column) -> Column:
    """The last number in a text, null without one."""
    found = F.regexp_extract_all(text, F.lit(f"({_NUMBER})"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).cast("double")


def normal_list(text: Column) -> Column:
    """The items of a list answer, parted by commas, semicolons or white space, sorted."""
    return F.array_sort(F.filter(F.split(text, r"[,;\s]+"), lambda x: x != ""))


def normal_groups(text: Column) -> Column:
    """A grouped list like a: 1; b: 2 as (value, group) structs, the smallest value first; parts without a number are left out."""
    pattern = rf"^([^:]+):\s*({_NUMBER})"
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x.rlike(pattern))
    pair = lambda x: F.struct(F.regexp_extract(x, pattern, 2).cast("double").alias("value"), F.trim(F.regexp_extract(x, pattern, 1)).alias("name"))
    return F.array_sort(F.transform(parts, pair))


def answer_kind(guideline: Column) -> Column:
    """What a guideline asks for: grouped_list, list, number, text or not_applicable."""
    g = F.lower(guideline)
    has = lambda *words: reduce(or_, [g.contains(w) for w in words])
    return (
        F.when(has("group") & has("broken down", "grouping"), "grouped_list").when(has("list", "comma separated"), "list")
        .when(has("number", "decimal"), "number").when(has("yes or no", "yes/no"), "text").otherwise("not_applicable")
    )


def answers_match(given: Column, wanted: Column, what: Column, tolerance: float = 1e-5) -> Column:
    """Answers compared as their kind asks; "not applicable" matches itself only. Null matches null."""
    a, b = F.trim(given), F.trim(wanted)
    nothing = lambda c: F.coalesce(F.lower(c) == "not applicable", F.lit(False))
    x, y = last_number(a), last_number(b)
    text = F.lower(a).eqNullSafe(F.lower(b))
    close = (F.round(x, 10) == F.round(y, 10)) | F.when(y == 0, F.abs(x) < tolerance).otherwise(F.abs(x - y) < tolerance * F.abs(y))
    # a text without a number stays as it is
    numbers = F.when(x.isNotNull() & y.isNotNull(), close).otherwise(x.isNull() & y.isNull() & a.eqNullSafe(b))
    same = (
        F.when(what == "number", numbers).when(what == "list", normal_list(a).eqNullSafe(normal_list(b)))
        .when(what == "grouped_list", normal_groups(a).eqNullSafe(normal_groups(b))).when(what == "text", text).otherwise(a.eqNullSafe(b))
    )
    return F.when(nothing(a) | nothing(b), nothing(a) & nothing(b)).when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)

"""Extraction and coercion of answers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def first_json(text: pd.Series) -> pd.Series:
    """The first balanced object of a text, strings and escapes honoured; not a regular language, so a vectorised UDF."""

    def find(x):
        if not x:
            return None
        at = x.find("{")
        while at >= 0:
            depth, quoted, skip = 0, False, False
            for k in range(at, len(x)):
                c = x[k]
                if skip:
                    skip = False
                elif quoted:
                    skip, quoted = c == "\\", c != '"'
                elif c == '"':
                    quoted = True
                elif c == "{":
                    depth += 1
                elif c == "}":
                    depth -= 1
                    if not depth:
                        return x[at : k + 1]
            at = x.find("{", at + 1)
        return None

    return text.map(find)


def as_number(value: Column) -> Column:
    return value.try_cast("double")


def as_flag(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin("true", "yes"), True).when(low.isin("false", "no"), False)


def class_match(value: Column, classes: Sequence[str]) -> Column:
    """The class a text equals, else the first class, in list order, that it contains."""
    low = F.lower(value)
    return F.coalesce(*[F.when(low == c, c) for c in classes], *[F.when(F.contains(low, F.lit(c)), c) for c in classes])


def typed_equal(kind: Column, a: Column, b: Column) -> Column:
    """Equality by kind: numbers by value, strings without case and spaces, arrays as sets, else exact."""
    number = F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) < 1e-9, F.lit(False))
    bare = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    as_set = lambda c: F.sort_array(F.array_distinct(F.split(c, ",")))
    return F.when(kind == "number", number).when(kind == "string", bare(a) == bare(b)).when(kind == "array", as_set(a) == as_set(b)).otherwise(a == b)


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first rule whose substring occurs."""
    out = F.lit(default)
    for needle, name in reversed(rules):
        out = F.when(F.contains(text, F.lit(needle)), name).otherwise(out)
    return out


def remapped(m: Column, keys: dict[str, str], values: dict[str, str]) -> Column:
    """A map with keys renamed, known values renamed, and blank values NULL."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    renamed = F.transform_keys(m, lambda k, _: F.coalesce(F.try_element_at(table(keys), k), k))
    return F.transform_values(renamed, lambda _, v: F.coalesce(F.try_element_at(table(values), v), F.nullif(F.trim(v), F.lit(""))))

"""Predicates and projections that the load, drift and view jobs share."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of the schemas under governance."""
    return df.filter(F.col(column).isin(list(names)))


def exclude_like(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose name matches none of the LIKE patterns (``_`` stands for any character)."""
    return df.filter(reduce(and_, [~F.col(column).like(p) for p in patterns]))


def exclude_kinds(df: DataFrame, column: str, kinds: list[str], missing: str) -> DataFrame:
    """Rows whose kind is not in the list; NULL counts as ``missing``."""
    return df.filter(~F.coalesce(F.col(column), F.lit(missing)).isin(list(kinds)))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns set to constants, and NULLs of existing columns filled with them."""
    have = set(df.columns)
    return df.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value)
            for name, value in defaults.items()
        }
    )


def conform(df: DataFrame, schema, defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns of ``schema`` in its order; one that the frame lacks takes its default or a typed
    NULL. As in a database, a NULL that the frame does carry stays NULL."""
    have = set(df.columns)
    given = defaults or {}
    return df.select(
        [
            (F.col(f.name) if f.name in have else F.lit(given.get(f.name))).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def attr_mismatch(pairs: list[tuple[Column, Column, object]]) -> Column:
    """True when a pair differs. With a sentinel, NULL counts as the sentinel on both sides;
    without one, NULL on either side leaves the pair unreported."""
    terms = []
    for left, right, sentinel in pairs:
        if sentinel is not None:
            left, right = F.coalesce(left, F.lit(sentinel)), F.coalesce(right, F.lit(sentinel))
        terms.append(left != right)
    return F.coalesce(reduce(or_, [F.coalesce(t, F.lit(False)) for t in terms]), F.lit(False))

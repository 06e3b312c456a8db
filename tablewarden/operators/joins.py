"""Guarded inserts, membership flags and key lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(df: DataFrame, on: dict[str, str], unique: bool) -> DataFrame:
    # Renamed, so that both sides may stem from one frame.
    keys = df.select([F.col(b).alias(f"_of_{a}") for a, b in on.items()])
    return keys if unique else keys.distinct()


def _same(on: dict[str, str], nulls: bool = False) -> list[Column]:
    return [F.col(a).eqNullSafe(F.col(f"_of_{a}")) if nulls else F.col(a) == F.col(f"_of_{a}") for a in on]


def not_in(
    source: DataFrame, registry: DataFrame, on: dict[str, str], unique: bool = False
) -> DataFrame:
    """Source rows whose key is not in the registry; a NULL key is never there.

    ``on`` maps source columns to registry columns. Unless the registry's keys are declared
    unique, they are made distinct first: the map-side part of that keeps a key with many copies
    from reaching one task, and the join reuses the partitioning of the distinct.
    """
    keys = _keys(registry, on, unique)
    return source.join(keys, _same(on), "left_anti")


def in_set(
    source: DataFrame, members: DataFrame, on: dict[str, str], unique: bool = False, nulls: bool = False
) -> DataFrame:
    """Source rows whose key is among the members; with ``nulls`` a NULL is found among NULLs."""
    keys = _keys(members, on, unique)
    return source.join(keys, _same(on, nulls), "left_semi")


def membership_flags(
    base: DataFrame, members: DataFrame, keys: list[str], flags: dict[str, Column]
) -> DataFrame:
    """Base rows plus one Y/N flag per predicate over the members of the same key.

    All flags come from one aggregate and one join, and the aggregate is combined map-side, so a
    key with very many members adds one row per task.
    """
    found = members.groupBy(*keys).agg(
        *[F.max(F.when(test, F.lit("Y"))).alias(name) for name, test in flags.items()]
    )
    joined = base.join(found, keys, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit("N")) for name in flags})


def resolve_ids(
    requests: DataFrame, registry: DataFrame, on: dict[str, str], id_column: str
) -> DataFrame:
    """Requests plus the surrogate id of the object they name, NULL when there is none.

    The registry's keys are unique, so no request is multiplied.
    """
    ids = registry.select(
        F.col(id_column), *[F.col(b).alias(f"_of_{a}") for a, b in on.items()]
    )
    return requests.join(ids, _same(on), "left").drop(*[f"_of_{a}" for a in on])

"""Ordered text lists per group, built in pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_text(
    df: DataFrame,
    keys: list[str],
    order_by: list[Column],
    value: Column,
    name: str,
    separator: str = ", ",
    piece: list[Column] | None = None,
) -> DataFrame:
    """One text per key: the values in order, with a separator between them.

    ``piece`` are columns that never fall as the order rises (such as an ordinal divided by a
    width). With them the rows of a key are first sorted and joined piece by piece, in as many
    tasks as there are pieces, and only the finished pieces meet to form the text.
    """
    item = F.struct(
        *[c.alias(f"o{i}") for i, c in enumerate(order_by)],
        F.coalesce(value.cast("string"), F.lit("")).alias("v"),
    )

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(items), lambda x: x["v"]), separator)

    if not piece:
        return df.groupBy(*keys).agg(joined(F.collect_list(item)).alias(name))
    slots = [f"_slot{i}" for i in range(len(piece))]
    parts = (
        df.withColumns(dict(zip(slots, piece)))
        .groupBy(*keys, *slots)
        .agg(joined(F.collect_list(item)).alias("_text"))
    )
    ordered = F.struct(
        *[F.col(s).alias(f"o{i}") for i, s in enumerate(slots)], F.col("_text").alias("v")
    )
    return parts.groupBy(*keys).agg(joined(F.collect_list(ordered)).alias(name))

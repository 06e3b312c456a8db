"""Dense numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablewarden.session import durable, shuffles_dropped

_ROW_BITS = 33


def _numbered(df: DataFrame, name: str, order_by: list[Column] | None, start: Column) -> DataFrame:
    """Rows with a dense number, following ``order_by`` or else the rows' present places.

    Rows are range-partitioned and sorted in place, then written once with their place
    (task number and row number inside the task). The running sum goes over one count per
    task, so no task and not the driver sees more than that.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = durable(df.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    place = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    # One row per task of the stage above, so its size is bounded by the number of tasks.
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, (start + F.col("_before") + place + 1).cast("long")).drop(
        "_place", "_part", "_before"
    )


def last_id(registry: DataFrame, id_column: str) -> int:
    """Highest id in use, 0 for an empty registry."""
    with shuffles_dropped(registry.sparkSession):
        return registry.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("last")).first().last


def assign_ids(
    df: DataFrame, id_column: str, last: int = 0, order_by: list[str] | None = None
) -> DataFrame:
    """Rows with new ids ``last + 1, last + 2, ...`` in the order of ``order_by``."""
    order = [F.col(c) for c in order_by] if order_by else None
    return _numbered(df, id_column, order, F.lit(last).cast("long"))


def ordinal_in_parent(
    df: DataFrame, parent: list[str], order_by: list[str], name: str
) -> DataFrame:
    """Position 1, 2, ... of each row among the rows of its parent.

    The rows of one parent lie next to each other in the dense numbering, so the position is the
    distance to the parent's first number. A parent with very many rows spans several tasks.
    """
    order = [F.col(c) for c in [*parent, *order_by]]
    ranked = _numbered(df, "_rank", order, F.lit(0).cast("long"))
    first = ranked.groupBy(*[F.col(c).alias(f"_of_{c}") for c in parent]).agg(
        F.min("_rank").alias("_first")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in parent]
    return ranked.join(first, same).select(
        *df.columns, (F.col("_rank") - F.col("_first") + 1).cast("int").alias(name)
    )


def next_ordinals(
    requests: DataFrame,
    existing: DataFrame,
    parent: list[str],
    ordinal: str,
    order_by: list[str],
    name: str,
) -> DataFrame:
    """Requests with the ordinal after the parent's highest one; several requests for one parent
    get successive ordinals in request order."""
    highest = existing.groupBy(*parent).agg(F.max(ordinal).alias("_highest"))
    placed = ordinal_in_parent(requests, parent, order_by, "_position")
    return placed.join(highest, parent, "left").withColumn(
        name, F.coalesce(F.col("_highest"), F.lit(0)) + F.col("_position")
    ).drop("_highest", "_position")

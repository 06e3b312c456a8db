"""Values carried along an order within a key, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.session import durable


def fold_in_order(
    rows: DataFrame, key: list[str], order_by: list[str], fields: list[str], last: str
) -> DataFrame:
    """Rows with, for each of ``fields``, its latest value that is not NULL among the key's rows up to this one.

    ``order_by`` must tell the rows of a key apart, and neither it nor the key may be NULL. ``last`` marks the
    key's last row. Rows are range-partitioned by key and order and written once with their piece, so a key with
    very many rows spans many pieces. Within a piece the values run along; between pieces only one row per piece
    and key counts: what the pieces before it end with. Pieces of one key are as many as tasks at most.
    """
    ranged = rows.repartitionByRange(*key, *order_by)
    placed = durable(ranged.withColumn("_piece", F.spark_partition_id()))
    turn = F.struct(*order_by)
    ends = placed.groupBy("_piece", *key).agg(
        F.max(turn).alias("_end"), *[F.max_by(f, F.when(F.col(f).isNotNull(), turn)).alias(f) for f in fields]
    )
    pieces = Window.partitionBy(*key).orderBy("_piece")
    before = pieces.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("_piece").alias("_of_piece"), *[F.col(k).alias(f"_of_{k}") for k in key],
        *[F.last(f, ignorenulls=True).over(before).alias(f"_before_{f}") for f in fields],
        F.when(F.lead("_piece").over(pieces).isNull(), F.col("_end")).alias("_end"),
    )
    same = [F.col("_piece") == F.col("_of_piece"), *[F.col(k) == F.col(f"_of_{k}") for k in key]]
    within = Window.partitionBy("_piece", *key).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.withColumns({f: F.last(f, ignorenulls=True).over(within) for f in fields})
    return run.join(carried, same).withColumns(
        {f: F.coalesce(f, f"_before_{f}") for f in fields} | {last: F.coalesce(turn == F.col("_end"), F.lit(False))}
    ).select(*rows.columns, last)

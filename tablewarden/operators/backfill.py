"""Expressions of function-based indexes, filled in after the load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.text import cut
from tablewarden.operators.history import BACKFILL


def _hidden():
    return F.col("COLUMN_NAME").like("SYS_NC%")


def pending_expressions(
    index_columns: DataFrame, indexes: DataFrame, tables: DataFrame, expressions: DataFrame
) -> DataFrame:
    """Hidden index columns without an expression, beside the catalog's expression."""
    pending = index_columns.filter(_hidden() & F.col("FUNC_EXPRESSION").isNull()).select(
        "INDEX_ID", "COLUMN_POS"
    )
    named = (
        pending.join(indexes.select("INDEX_ID", "TABLE_ID", "INDEX_NAME"), "INDEX_ID")
        .join(tables.select("TABLE_ID", F.col("SCHEMA_NAME").alias("INDEX_OWNER")), "TABLE_ID")
        .withColumn("COLUMN_POSITION", F.col("COLUMN_POS"))
    )
    return (
        named.join(expressions, ["INDEX_OWNER", "INDEX_NAME", "COLUMN_POSITION"])
        .select(
            "INDEX_OWNER", "INDEX_NAME", "COLUMN_POSITION", "COLUMN_EXPRESSION", "INDEX_ID", "COLUMN_POS"
        )
        .orderBy("INDEX_OWNER", "INDEX_NAME", "COLUMN_POSITION")
    )


def apply_expressions(index_columns: DataFrame, pending: DataFrame) -> DataFrame:
    """Index columns with their empty expressions filled, cut to the column's 2000 characters."""
    found = pending.select("INDEX_ID", "COLUMN_POS", cut(F.col("COLUMN_EXPRESSION")).alias("_new"))
    joined = index_columns.join(found, ["INDEX_ID", "COLUMN_POS"], "left")
    return joined.withColumn("FUNC_EXPRESSION", F.coalesce("FUNC_EXPRESSION", "_new")).select(
        index_columns.columns
    )


def backfill_phases(index_columns: DataFrame, history: DataFrame) -> DataFrame:
    """Counts of pending and filled expressions, and of the backfill history: (phase, cnt)."""
    filled = F.col("FUNC_EXPRESSION").isNotNull()
    state = index_columns.filter(_hidden()).select(
        F.when(filled, "BACKFILLED").otherwise("PENDING").alias("phase")
    )
    written = history.filter((F.col("HIST_TYPE") == "U") & (F.col("CHANGE_REASON") == BACKFILL))
    return phase_counts(
        state.unionByName(written.select(F.lit("HIST_BACKFILL").alias("phase"))),
        ["PENDING", "BACKFILLED", "HIST_BACKFILL"],
    )


def phase_counts(states: DataFrame, phases: list[str]) -> DataFrame:
    """Rows per phase, with 0 for a phase that has none; one aggregate without a key."""
    counts = states.agg(
        *[F.count(F.when(F.col("phase") == p, 1)).alias(p) for p in phases]
    )
    pairs = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("cnt")) for p in phases])
    return counts.select(F.inline(pairs))

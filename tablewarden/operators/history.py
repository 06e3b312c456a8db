"""Append-only history: full-row snapshots with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.operators.filters import conform
from tablewarden.operators.ids import assign_ids
from tablewarden.operators.joins import not_in
from tablewarden.schemas import Entity

INITIAL_LOAD = "INITIAL_LOAD"
BACKFILL = "FUNC_EXPRESSION_BACKFILL"


def _column(value):
    return value if not isinstance(value, str) else F.lit(value)


def snapshot(rows: DataFrame, entity: Entity, op: str, reason, actor, as_of) -> DataFrame:
    """History rows of the given rows, still without ids.

    ``rows`` are the rows as they are after an insert or update, and before a delete.
    ``reason`` and ``actor`` are texts, or columns of ``rows`` where requests differ in them.
    """
    return rows.select(
        F.lit(op).alias("HIST_TYPE"),
        F.lit(as_of).cast("timestamp").alias("HIST_AT"),
        _column(actor).alias("HIST_BY"),
        _column(reason).alias("CHANGE_REASON"),
        *entity.names,
    )


def snapshot_values(
    values: DataFrame, entity: Entity, op: str, reason: str, actor: str, as_of
) -> DataFrame:
    """History rows of values that are given directly; columns that are not given are NULL."""
    return snapshot(conform(values, entity.schema), entity, op, reason, actor, as_of)


def with_history_ids(rows: DataFrame, last: int) -> DataFrame:
    """History rows with dense ids after ``last``, in no particular order."""
    numbered = assign_ids(rows, "HIST_ID", last)
    return numbered.select("HIST_ID", *[c for c in rows.columns if c != "HIST_ID"])


def _guarded(rows, history, keys, op, reason) -> DataFrame:
    done = history.filter((F.col("HIST_TYPE") == op) & (F.col("CHANGE_REASON") == reason))
    return not_in(rows, done, {k: k for k in keys})


def initial_history(
    main: DataFrame,
    history: DataFrame,
    entity: Entity,
    as_of,
    actor: str,
    only_new: DataFrame | None = None,
) -> DataFrame:
    """Insert history of every row that has none from an initial load.

    Rows that a change request added have no initial-load history either, so a later load
    writes a second insert row for them. ``only_new`` (the rows loaded now) avoids that.
    """
    rows = main if only_new is None else only_new
    missing = _guarded(rows, history, entity.primary_key, "I", INITIAL_LOAD)
    return snapshot(missing, entity, "I", INITIAL_LOAD, actor, as_of)


def backfill_history(
    index_columns: DataFrame, history: DataFrame, entity: Entity, as_of, actor: str
) -> DataFrame:
    """Update history of filled index expressions that have none yet."""
    filled = index_columns.filter(
        F.col("COLUMN_NAME").like("SYS_NC%") & F.col("FUNC_EXPRESSION").isNotNull()
    )
    missing = _guarded(filled, history, entity.primary_key, "U", BACKFILL)
    return snapshot(missing, entity, "U", BACKFILL, actor, as_of)

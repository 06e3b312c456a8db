"""Restricted and masked views: their DDL, the reports around it, and their effect on data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.masking import mask, mask_function_name
from tablewarden.functions.text import blank_to_null, is_blank
from tablewarden.operators.text_lists import ordered_text

# The identifier limit in bytes and the prefix of generated views.
NAME_LIMIT = 128
VIEW_PREFIX = "VW_"
_PIECE = 256


def _active_views(tables: DataFrame) -> DataFrame:
    return tables.filter((F.col("VIEW_YN") == "Y") & (F.col("STATUS_CD") == "ACTIVE"))


def _view_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Active columns of active views; a view without one is not there."""
    views = _active_views(tables).select("TABLE_ID", "SCHEMA_NAME", "TABLE_NAME")
    active = columns.filter(F.col("STATUS_CD") == "ACTIVE").select(
        "TABLE_ID", "COLUMN_NAME", "COLUMN_ORDER", "PCI_YN"
    )
    return views.join(active, "TABLE_ID")


def restricted_view_ddl(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One view statement per active view, with its columns free of personal data, in column order.

    Equal column orders are told apart by name.
    """
    open_columns = _view_columns(tables, columns).filter(F.col("PCI_YN") == "N")
    listed = ordered_text(
        open_columns,
        ["SCHEMA_NAME", "TABLE_NAME"],
        [F.col("COLUMN_ORDER"), F.col("COLUMN_NAME")],
        F.col("COLUMN_NAME"),
        "_list",
        piece=[F.floor(F.col("COLUMN_ORDER") / _PIECE)],
    )
    target = F.concat_ws(".", "SCHEMA_NAME", F.concat(F.lit(VIEW_PREFIX), "TABLE_NAME"))
    origin = F.concat_ws(".", "SCHEMA_NAME", "TABLE_NAME")
    ddl = F.concat(
        F.lit("CREATE OR REPLACE VIEW "), target, F.lit(" AS SELECT "), "_list",
        F.lit(" FROM "), origin, F.lit(";"),
    )
    return listed.select("SCHEMA_NAME", "TABLE_NAME", ddl.alias("DDL")).orderBy(
        "SCHEMA_NAME", "TABLE_NAME"
    )


def closed_views(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Views all of whose active columns hold personal data, with their column counts."""
    flagged = _view_columns(tables, columns)

    def count_of(letter):
        return F.sum(F.when(F.col("PCI_YN") == letter, 1).otherwise(0))

    return (
        flagged.groupBy("SCHEMA_NAME", "TABLE_NAME")
        .agg(
            F.count(F.lit(1)).alias("TOTAL_COL"),
            count_of("N").alias("NON_PCI_COL"),
            count_of("Y").alias("PCI_COL"),
        )
        .filter(F.col("NON_PCI_COL") == 0)
        .orderBy("SCHEMA_NAME", "TABLE_NAME")
    )


def long_view_names(tables: DataFrame, limit: int = NAME_LIMIT) -> DataFrame:
    """Active views whose generated name exceeds the limit in bytes, longest first."""
    size = F.octet_length("TABLE_NAME") + len(VIEW_PREFIX)
    return (
        _active_views(tables)
        .select("SCHEMA_NAME", "TABLE_NAME", size.alias("GEN_NAME_BYTES"))
        .filter(F.col("GEN_NAME_BYTES") > limit)
        .orderBy(F.desc("GEN_NAME_BYTES"))
    )


def masked_view_ddl(tables: DataFrame, columns: DataFrame, view_name: str | None = None) -> DataFrame:
    """View statement per table with every column, the ones flagged for masking wrapped in their
    masking function. Without a ``view_name`` column, ``TB_`` gives way to ``VW_``."""
    named = tables.select(
        "TABLE_ID", "SCHEMA_NAME", "TABLE_NAME",
        (blank_to_null(F.col(view_name)) if view_name else F.lit(None).cast("string")).alias("_given"),
    ).withColumn(
        "_view", F.coalesce(F.upper("_given"), F.regexp_replace("TABLE_NAME", "^TB_", VIEW_PREFIX))
    )
    masked = (F.col("MASKING_YN") == "Y") & ~is_blank(F.col("MASKING_RULE_CD"))
    expression = F.when(
        masked,
        F.concat(
            F.lit("    "), mask_function_name(F.col("MASKING_RULE_CD")),
            F.lit("("), "COLUMN_NAME", F.lit(") AS "), "COLUMN_NAME",
        ),
    ).otherwise(F.concat(F.lit("    "), "COLUMN_NAME"))
    listed = ordered_text(
        named.join(columns.select("TABLE_ID", "COLUMN_NAME", "COLUMN_ORDER", "MASKING_YN", "MASKING_RULE_CD"), "TABLE_ID"),
        ["SCHEMA_NAME", "TABLE_NAME", "_view"],
        [F.col("COLUMN_ORDER"), F.col("COLUMN_NAME")],
        expression,
        "_list",
        separator=",\n",
        piece=[F.floor(F.col("COLUMN_ORDER") / _PIECE)],
    )
    ddl = F.concat(
        F.lit("CREATE OR REPLACE VIEW "), F.concat_ws(".", "SCHEMA_NAME", "_view"),
        F.lit(" AS\nSELECT\n"), "_list", F.lit("\nFROM "),
        F.concat_ws(".", "SCHEMA_NAME", "TABLE_NAME"), F.lit(";"),
    )
    return listed.select("SCHEMA_NAME", "TABLE_NAME", ddl.alias("DDL"))


def _column_list(df: DataFrame, meta: DataFrame) -> list:
    """The active described columns that the table has, in order: a projection's names are in the driver anyway.

    Of several descriptions of one column, whatever the case of its name, the strictest holds: it is free of personal
    data only if all say so, masked if one says so, and masked by a rule that none names if their rules differ.
    """
    own = [c.upper() for c in df.columns]
    rule = F.when((F.col("MASKING_YN") == "Y") & ~is_blank(F.col("MASKING_RULE_CD")), F.col("MASKING_RULE_CD"))
    return (
        meta.filter((F.col("STATUS_CD") == "ACTIVE") & F.upper("COLUMN_NAME").isin(own))
        .groupBy(F.upper("COLUMN_NAME").alias("COLUMN_NAME"))
        .agg(
            F.min("COLUMN_ORDER").alias("COLUMN_ORDER"),
            F.min(F.coalesce(F.col("PCI_YN") == "N", F.lit(False))).alias("open"),
            F.min(rule).alias("rule"),
            (F.min(rule) != F.max(rule)).alias("differ"),
        )
        .orderBy("COLUMN_ORDER", "COLUMN_NAME")
        .collect()
    )


def _actual(df: DataFrame) -> dict[str, str]:
    return {c.upper(): c for c in df.columns}


def masked_view(df: DataFrame, meta: DataFrame) -> DataFrame:
    """The data table as its masked view shows it: one projection of native expressions.

    Masking hides flagged columns only; a column with personal data and no flag stays as it is.
    """
    have = _actual(df)
    shown = []
    for c in _column_list(df, meta):
        name = have[c.COLUMN_NAME]
        shown.append((mask(F.col(name), "" if c.differ else c.rule) if c.rule else F.col(name)).alias(name))
    return df.select(shown)


def restricted_view(df: DataFrame, meta: DataFrame) -> DataFrame:
    """The data table without its columns that hold personal data."""
    have = _actual(df)
    return df.select([have[c.COLUMN_NAME] for c in _column_list(df, meta) if c.open])

"""Report and statement files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str) -> None:
    """Report as CSV part files with a header."""
    df.write.option("header", "true").option("escape", '"').csv(path)


def export_text(statements: DataFrame, path: str) -> None:
    """One generated statement per row of the frame's single text column."""
    statements.write.text(path)

"""The identifier rule and the error lists that validation reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden.functions.text import is_blank

# The identifier rule.
IDENTIFIER = r"\A[A-Z][A-Z0-9_]*\z"
IDENTIFIER_LENGTH = 128

ERROR_TYPE = "array<struct<field:string,value:string,rule:string>>"


def problem(field: str | Column, value: Column | None, rule: str) -> Column:
    return F.struct(
        (field if isinstance(field, Column) else F.lit(field)).cast("string").alias("field"),
        (F.lit(None) if value is None else value).cast("string").alias("value"),
        F.lit(rule).alias("rule"),
    )


def name_rule(name: Column) -> Column:
    """Rule that an already upper-cased name breaks, or NULL."""
    return (
        F.when(is_blank(name), F.lit("required"))
        .when(~F.rlike(name, F.lit(IDENTIFIER)), F.lit("charset"))
        .when(F.length(name) > IDENTIFIER_LENGTH, F.lit("length"))
    )


def check_name(field: str | Column, value: Column, required: bool = True) -> Column:
    """Error struct for a name, or NULL when the name is good."""
    upper = F.upper(value)
    broken = (
        F.when(~F.rlike(upper, F.lit(IDENTIFIER)), problem(field, value, "charset"))
        .when(F.length(upper) > IDENTIFIER_LENGTH, problem(field, value, "length"))
    )
    if required:
        return F.when(is_blank(value), problem(field, None, "required")).otherwise(broken)
    return F.when(~is_blank(value), broken)


def check_present(field: str, value: Column) -> Column:
    return F.when(is_blank(value), problem(field, None, "required"))


def errors(*checks: Column) -> Column:
    """All errors of one row, in check order."""
    return F.filter(F.array(*checks), lambda e: e.isNotNull()).cast(ERROR_TYPE)

"""Text form of a column type and parsing of index column lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden.functions.text import WHITESPACE, is_blank, trim_all


def render_type(
    data_type: Column,
    length: Column,
    precision: Column,
    scale: Column,
    semantics: Column | None = None,
) -> Column:
    """Type as it stands in DDL; text and raw types without a length get 1."""
    name = F.upper(F.coalesce(data_type, F.lit("")))
    size = F.when(is_blank(length.cast("string")), F.lit("1")).otherwise(length.cast("string"))
    unit = F.lit("")
    if semantics is not None:
        unit = F.when(
            F.upper(semantics).isin("BYTE", "CHAR"), F.concat(F.lit(" "), F.upper(semantics))
        ).otherwise(F.lit(""))
    digits, decimals = precision.cast("string"), scale.cast("string")
    number = (
        F.when(is_blank(digits), F.lit("NUMBER"))
        .when(is_blank(decimals), F.concat(F.lit("NUMBER("), digits, F.lit(")")))
        .otherwise(F.concat(F.lit("NUMBER("), digits, F.lit(","), decimals, F.lit(")")))
    )
    return (
        F.when(name.isin("VARCHAR2", "CHAR"), F.concat(name, F.lit("("), size, unit, F.lit(")")))
        .when(name == "RAW", F.concat(F.lit("RAW("), size, F.lit(")")))
        .when(name == "NUMBER", number)
        .otherwise(name)
    )


_SPACE = rf"[{WHITESPACE}]"
_ITEM = rf"(?i)\A([^{WHITESPACE}]+)(?:{_SPACE}+(ASC|DESC))?\z"


def parse_index_columns(items: Column) -> Column:
    """``NAME [ASC|DESC]`` items of a comma list as an array of (name, sort); bad items drop out."""

    def parse(item):
        text = trim_all(item)
        sort = F.upper(F.regexp_extract(text, _ITEM, 2))
        return F.when(
            F.rlike(text, F.lit(_ITEM)),
            F.struct(
                F.upper(F.regexp_extract(text, _ITEM, 1)).alias("name"),
                F.when(sort == "", F.lit("ASC")).otherwise(sort).alias("sort"),
            ),
        )

    return F.filter(F.transform(F.split(items, ",", -1), parse), lambda c: c.isNotNull())

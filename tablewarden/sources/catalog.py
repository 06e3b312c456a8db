"""Catalog snapshots and change requests, read with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.text import blank_to_null, trim_all
from tablewarden.schemas import CATALOG, REQUESTS


def _read(spark: SparkSession, path: str, schema: str, fmt: str, options: dict) -> DataFrame:
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def read_snapshot(
    spark: SparkSession, path: str, kind: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """One catalog snapshot (``tables``, ``views``, ``tab_columns`` ...) from files."""
    options = {"header": "true"} | options if fmt == "csv" else options
    return _read(spark, path, CATALOG[kind], fmt, options)


def read_snapshot_jdbc(
    spark: SparkSession, url: str, query: str, kind: str, split_on: str | None = None,
    bounds: tuple[int, int] = (0, 0), splits: int = 1, **options: str,
) -> DataFrame:
    """The same snapshot from a live catalog view; ``split_on`` reads it in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if split_on:
        reader = reader.option("dbtable", f"({query}) snapshot").option(
            "partitionColumn", split_on
        ).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", splits)
    else:
        reader = reader.option("query", query)
    schema = T.StructType.fromDDL(CATALOG[kind])
    rows = reader.load()
    return rows.select([F.col(f.name).cast(f.dataType) for f in schema.fields])


def _clean(field: T.StructField):
    column = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return blank_to_null(column).alias(field.name)
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
        inner = field.dataType.elementType.fields

        def tidy(row):
            return F.struct(
                *[
                    (F.nullif(trim_all(row[f.name]), F.lit("")) if isinstance(f.dataType, T.StringType)
                     else row[f.name]).alias(f.name)
                    for f in inner
                ]
            )

        named = F.transform(column, tidy)
        if "colName" in field.dataType.elementType.names:
            named = F.filter(named, lambda row: row["colName"].isNotNull())
        return named.alias(field.name)
    return column


def tidy_requests(requests: DataFrame, kind: str) -> DataFrame:
    """Requests with trimmed text and blanks as NULL; column rows without a name drop out.

    Fields that the frame lacks are NULL, so a request file may leave optional fields out.
    """
    schema = T.StructType.fromDDL(REQUESTS[kind])
    have = set(requests.columns)
    full = requests.select(
        [
            F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
    return full.select([_clean(f) for f in schema.fields])


def read_requests(
    spark: SparkSession, path: str, kind: str, fmt: str = "json", **options: str
) -> DataFrame:
    """Change requests of one kind, tidied."""
    return tidy_requests(_read(spark, path, REQUESTS[kind], fmt, options), kind)

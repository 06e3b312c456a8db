"""Code values, counts and declared constraints."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.text import join_text
from tablewarden.operators.history import INITIAL_LOAD
from tablewarden.operators.joins import in_set, not_in
from tablewarden.schemas import HISTORY_RULES, HISTORY_TYPES, Entity
from tablewarden.sources.codes import CODE_SEED

LABEL = "잘못된 {column}: "


@dataclass(frozen=True)
class CodeRule:
    """A code column and the group its values must come from."""

    column: str
    group: str
    skip_null: bool = False


# The checked code columns of each entity, and which of them may be NULL.
TABLE_CODES = [
    CodeRule("SERVICE_CD", "CD_SERVICE"),
    CodeRule("RETENTION_PERIOD_CD", "CD_RETENTION_PERIOD"),
    CodeRule("STATUS_CD", "CD_STATUS"),
]
COLUMN_SENSITIVITY = [CodeRule("SENSITIVITY_CD", "CD_SENSITIVITY")]
COLUMN_CODES = [
    CodeRule("STATUS_CD", "CD_STATUS"),
    CodeRule("PCI_CATEGORY_CD", "CD_PCI_CATEGORY", skip_null=True),
    CodeRule("MASKING_RULE_CD", "CD_MASKING_RULE", skip_null=True),
]
INDEX_CODES = [
    CodeRule("INDEX_TYPE_CD", "CD_INDEX_TYPE"),
    CodeRule("PURPOSE_CD", "CD_INDEX_PURPOSE"),
]
SEQUENCE_CODES = [CodeRule("PURPOSE_CD", "CD_SEQUENCE_PURPOSE")]


def code_violations(
    df: DataFrame,
    id_columns: list[str],
    rules: list[CodeRule],
    codes: DataFrame,
    label: str = LABEL,
) -> DataFrame:
    """One row per id and code column whose value is not in its group.

    All rules share one pass: each row yields one (group, value) per rule, and one anti-join
    against the codes keeps the bad ones. A NULL value is bad unless its rule allows it.
    A code counts as valid whether or not it is still in use.
    """
    checks = F.array(
        *[
            F.struct(
                F.lit(r.group).alias("grp"),
                F.col(r.column).cast("string").alias("val"),
                F.lit(label.format(column=r.column)).alias("lbl"),
                F.lit(r.skip_null).alias("skip"),
            )
            for r in rules
        ]
    )
    values = (
        df.select(*id_columns, F.explode(checks).alias("_check"))
        .select(
            *id_columns,
            F.col("_check.grp").alias("_grp"),
            F.col("_check.val").alias("_val"),
            F.col("_check.lbl").alias("_lbl"),
            F.col("_check.skip").alias("_skip"),
        )
        .filter(~F.col("_skip") | F.col("_val").isNotNull())
    )
    bad = not_in(values, codes, {"_grp": "CODE_GROUP", "_val": "CODE_VALUE"})
    return bad.select(*id_columns, join_text(F.col("_lbl"), F.col("_val")).alias("issue"))


def sensitivity_violations(columns: DataFrame, codes: DataFrame) -> DataFrame:
    """Columns whose sensitivity code is unknown, with the code itself."""
    valid = codes.filter(F.col("CODE_GROUP") == "CD_SENSITIVITY")
    return not_in(columns, valid, {"SENSITIVITY_CD": "CODE_VALUE"}).select(
        "COLUMN_ID", "TABLE_ID", "COLUMN_NAME", "SENSITIVITY_CD"
    )


def count_per_group(df: DataFrame, group: str) -> DataFrame:
    """Rows per group, in group order."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("cnt")).orderBy(group)


def code_group_report(codes: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Rows per code group beside the expected number; groups without one have NULL there."""
    wanted = expected or {group: len(values) for group, values in CODE_SEED.items()}
    spark = codes.sparkSession
    # As many rows as there are code groups in the seed.
    target = spark.createDataFrame(list(wanted.items()), "CODE_GROUP STRING, expected BIGINT")
    counted = codes.groupBy("CODE_GROUP").agg(F.count(F.lit(1)).alias("cnt"))
    return (
        counted.join(target, "CODE_GROUP", "full")
        .select("CODE_GROUP", F.coalesce("cnt", F.lit(0)).alias("cnt"), "expected")
        .orderBy("CODE_GROUP")
    )


# Report names of the entities, in report order.
COUNT_LABELS = {
    "table": "TABLE",
    "column": "COLUMN",
    "index": "INDEX",
    "index_column": "INDEX_COL",
    "sequence": "SEQUENCE",
    "code": "CODE",
}


def count_pair(label: str, main: DataFrame, history: DataFrame) -> DataFrame:
    """One row (src, main, hist) with the row counts of two frames."""
    pieces = main.select(F.lit(1).alias("_m"), F.lit(0).alias("_h")).unionByName(
        history.select(F.lit(0).alias("_m"), F.lit(1).alias("_h"))
    )
    return pieces.agg(
        F.coalesce(F.sum("_m"), F.lit(0)).cast("long").alias("main"),
        F.coalesce(F.sum("_h"), F.lit(0)).cast("long").alias("hist"),
    ).select(F.lit(label).alias("src"), "main", "hist")


def main_history_counts(
    main: dict[str, DataFrame], history: dict[str, DataFrame]
) -> DataFrame:
    """Row counts of every entity beside its initial-load history. They agree right after a load;
    hard deletes lower the first and not the second."""
    loaded = (F.col("HIST_TYPE") == "I") & (F.col("CHANGE_REASON") == INITIAL_LOAD)
    parts = [
        count_pair(label, main[name], history[name].filter(loaded))
        for name, label in COUNT_LABELS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1)
    )


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str], unique: bool = False) -> DataFrame:
    """Child rows whose key is not among the parents; a NULL key refers to nothing and passes."""
    named = child.dropna(subset=list(on))
    return not_in(named, parent, on, unique)


def outside_values(df: DataFrame, allowed: dict[str, tuple]) -> DataFrame:
    """Rows with a value outside its allowed set. NULL passes, as it does in a CHECK constraint."""
    bad = reduce(
        lambda a, b: a | b,
        [F.coalesce(~F.col(c).isin(list(values)), F.lit(False)) for c, values in allowed.items()],
    )
    return df.filter(bad)


def failing_check(df: DataFrame, condition) -> DataFrame:
    """Rows for which a CHECK condition is false; unknown passes."""
    return df.filter(~condition)


def _column_problem(column):
    value = F.col(column.name)
    broken = F.lit(None).cast("string")
    if column.size is not None and column.kind in ("text", "flag"):
        broken = F.when(F.octet_length(value) > column.size, F.lit("too long"))
    elif column.size is not None:
        broken = F.when(F.abs(value) >= F.lit(10**column.size).cast("decimal(38,0)"), F.lit("too large"))
    if column.required:
        broken = F.when(value.isNull(), F.lit("null")).otherwise(broken)
    return F.struct(F.lit(column.name).alias("column"), broken.alias("rule"))


def declared_violations(df: DataFrame, entity: Entity, history: bool = False) -> DataFrame:
    """Every declared rule a row breaks: missing value, size, value set. One pass, no shuffle."""
    columns = entity.columns
    value_sets = dict(entity.value_sets)
    key = list(entity.primary_key)
    if history:
        # Snapshot columns are nullable; only their header is required.
        columns = HISTORY_RULES + tuple(
            type(c)(c.name, c.kind, c.size, False, c.default) for c in columns
        )
        value_sets = {"HIST_TYPE": HISTORY_TYPES}
        key = ["HIST_ID"]
    found = [_column_problem(c) for c in columns]
    found += [
        F.struct(
            F.lit(name).alias("column"),
            F.when(~F.col(name).isin(list(values)), F.lit("value")).alias("rule"),
        )
        for name, values in value_sets.items()
    ]
    broken = F.filter(F.array(*found), lambda p: p["rule"].isNotNull())
    return df.select(*key, F.explode(broken).alias("_p")).select(*key, "_p.column", "_p.rule")


def key_violations(df: DataFrame, entity: Entity) -> dict[str, DataFrame]:
    """Repeated primary and unique keys of an entity."""
    checks = {"primary_key": duplicate_keys(df, list(entity.primary_key))}
    if entity.unique_key:
        checks["unique_key"] = duplicate_keys(df, list(entity.unique_key))
    return checks


def _first(rows: DataFrame, entity: Entity, key: list[str], rule: Column) -> DataFrame:
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in key])
    return rows.select(F.lit(entity.name).alias("entity"), rule.alias("rule"), named.alias("key"))


def publish_violations(
    entity: Entity, added: DataFrame, known: DataFrame, parents: DataFrame | None = None
) -> DataFrame:
    """(entity, rule, key) of added rows that break a declared rule.

    Missing values, sizes and value sets in one pass; keys by counting the added rows and by looking
    the known ones up; the parent by one anti-join. Known rows are never checked again.
    """
    key = list(entity.primary_key)
    rules = _first(declared_violations(added, entity), entity, key, F.concat_ws(" ", "column", "rule"))
    for name, columns in (("primary key", key), ("unique key", list(entity.unique_key or ()))):
        if columns:
            repeated = duplicate_keys(added.dropna(subset=columns), columns)
            taken = added.select(columns).join(known.select(columns), columns, "left_semi")
            both = repeated.select(columns).unionByName(taken)
            rules = rules.unionByName(_first(both, entity, columns, F.lit(name)))
    if parents is not None and entity.parent:
        column = entity.parent[1]
        lost = orphans(added, parents, {column: column}, unique=True)
        rules = rules.unionByName(_first(lost, entity, key, F.lit("foreign key")))
    return rules


def children_of(rows: DataFrame, entity: Entity, gone: DataFrame) -> DataFrame:
    """(entity, rule, key) of an entity's rows whose parent is among the removed keys.

    A semi-join: few removed keys are broadcast by their bytes, and more of them reach the scan of the rows as a
    Bloom filter where Spark's runtime filters are on, so that the rows of other parents are not shuffled.
    """
    column = entity.parent[1]
    left = in_set(rows, gone, {column: column})
    return _first(left, entity, list(entity.primary_key), F.lit("parent removed"))

"""Sequence requests: create, alter and drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.names import check_name
from tablewarden.functions.text import ensure_prefix, is_blank, number_or_null, yes_no
from tablewarden.operators.filters import conform
from tablewarden.operators.history import snapshot
from tablewarden.operators.ids import assign_ids, last_id
from tablewarden.operators.joins import not_in
from tablewarden.plans.changes.common import (
    Change, audit, begin, find_object, fold_patches, patch, reject_repeats, reject_same_turns, settle,
    statements, with_errors, with_request,
)
from tablewarden.schemas import AUDIT_COLUMNS, SEQUENCE

_KEY = {"_schema": "SCHEMA_NAME", "_sequence": "SEQUENCE_NAME"}
_NUMBER = "decimal(38,0)"


def _named(requests: DataFrame, kind: str) -> DataFrame:
    return begin(requests, kind).withColumns(
        {"_schema": F.upper("schema"), "_sequence": ensure_prefix(F.col("seqName"), "SEQ")}
    )


def _name_checks() -> list:
    return [check_name("schema", F.col("schema")), check_name("seqName", F.col("_sequence"))]


def _use_checks() -> list:
    return [
        check_name("usedForTable", F.col("usedForTable"), required=False),
        check_name("usedForColumn", F.col("usedForColumn"), required=False),
    ]


def _ddl(verb: str):
    """Statement with the options that the request states, in the dialect's usual order."""

    def option(word, field):
        return F.when(
            ~is_blank(F.col(field)), F.concat(F.lit(f"\n  {word} "), F.col(field))
        ).otherwise(F.lit(""))

    def switch(field, word):
        return F.when(F.coalesce(F.col(field), F.lit(False)), F.lit(f"\n  {word}")).otherwise(
            F.lit(f"\n  NO{word}")
        )

    start = [option("START WITH", "startWith")] if verb == "CREATE" else []
    return F.concat(
        F.lit(f"{verb} SEQUENCE "), F.concat_ws(".", "_schema", "_sequence"), *start,
        option("INCREMENT BY", "incrementBy"), option("MINVALUE", "minValue"),
        option("MAXVALUE", "maxValue"), switch("cycleYn", "CYCLE"),
        option("CACHE", "cacheSize"), switch("orderYn", "ORDER"), F.lit(";"),
    )


# What a sequence form starts with.
FORM_DEFAULTS = {"incrementBy": "1", "startWith": "1", "cacheSize": "20"}


def sequence_create(main: dict[str, DataFrame], requests: DataFrame, as_of) -> Change:
    """New sequences; increment and start default to 1, the cache to 20."""
    rows = with_errors(_named(requests, "sequence_create"), [*_name_checks(), *_use_checks()])
    rows = reject_repeats(rows, ["_schema", "_sequence"])
    rows = find_object(rows, main["sequence"], _KEY, "seqName", expected=False)
    rows = rows.withColumns({f: F.coalesce(F.col(f), F.lit(v)) for f, v in FORM_DEFAULTS.items()})
    batch = settle(rows.withColumn("_ddl", _ddl("CREATE")))
    good = batch.good
    placed = assign_ids(
        good, "SEQUENCE_ID", last_id(main["sequence"], "SEQUENCE_ID"), ["_schema", "_sequence"]
    )
    sequences = with_request(
        audit(placed, as_of).select(
            "SEQUENCE_ID", "reason", "_actor", *AUDIT_COLUMNS,
            F.col("_schema").alias("SCHEMA_NAME"),
            F.col("_sequence").alias("SEQUENCE_NAME"),
            number_or_null(F.col("minValue"), _NUMBER).alias("MIN_VALUE"),
            number_or_null(F.col("maxValue"), _NUMBER).alias("MAX_VALUE"),
            number_or_null(F.col("incrementBy"), _NUMBER).alias("INCREMENT_BY"),
            number_or_null(F.col("startWith"), _NUMBER).alias("START_WITH"),
            number_or_null(F.col("cacheSize"), _NUMBER).alias("CACHE_SIZE"),
            yes_no(F.col("cycleYn")).alias("CYCLE_YN"),
            yes_no(F.col("orderYn")).alias("ORDER_YN"),
            F.col("purposeCd").alias("PURPOSE_CD"),
            F.upper("usedForTable").alias("USED_FOR_TABLE"),
            F.upper("usedForColumn").alias("USED_FOR_COLUMN"),
            F.col("_ddl").alias("CREATE_DDL"),
            F.lit("ACTIVE").alias("STATUS_CD"),
        ),
        SEQUENCE,
    )
    return Change(
        ddl=statements(good, [(F.lit(True), F.col("_ddl"))]),
        rejects=batch.rejects,
        append={"sequence": conform(sequences, SEQUENCE.schema)},
        history={"sequence": snapshot(sequences, SEQUENCE, "I", F.col("reason"), F.col("_actor"), as_of)},
    )


# Fields that change the sequence itself, not only what is noted about it.
DDL_FIELDS = ["incrementBy", "minValue", "maxValue", "cacheSize", "cycleYn", "orderYn"]


def sequence_alter(main: dict[str, DataFrame], requests: DataFrame, as_of) -> Change:
    """Sequences with the stated fields overwritten; a field left empty keeps its value.

    The two switches are written when touched, the statement when any of its fields was. Several requests for one
    sequence take effect in the order of their turns, each with its own history row.
    """
    rows = with_errors(_named(requests, "sequence_alter"), [*_name_checks(), *_use_checks()])
    rows = reject_same_turns(rows)
    rows = find_object(rows, main["sequence"], _KEY, "seqName", expected=True)
    touched = F.coalesce(F.col("touched"), F.array().cast("array<string>"))
    rows = rows.withColumns(
        {
            "_ddl": _ddl("ALTER"),
            "_ddl_changed": F.arrays_overlap(touched, F.array(*[F.lit(f) for f in DDL_FIELDS])),
        }
    )
    batch = settle(rows)
    good = batch.good
    stated = {
        "PURPOSE_CD": F.col("purposeCd"),
        "USED_FOR_TABLE": F.upper("usedForTable"),
        "USED_FOR_COLUMN": F.upper("usedForColumn"),
    }
    numbers = {
        "INCREMENT_BY": "incrementBy",
        "MIN_VALUE": "minValue",
        "MAX_VALUE": "maxValue",
        "CACHE_SIZE": "cacheSize",
    }
    fields = {name: (~is_blank(value), value) for name, value in stated.items()}
    fields |= {
        name: (~is_blank(F.col(f)), number_or_null(F.col(f), _NUMBER)) for name, f in numbers.items()
    }
    fields["CYCLE_YN"] = (F.array_contains(touched, "cycleYn"), yes_no(F.col("cycleYn")))
    fields["ORDER_YN"] = (F.array_contains(touched, "orderYn"), yes_no(F.col("orderYn")))
    fields["CREATE_DDL"] = (F.col("_ddl_changed"), F.col("_ddl"))
    folded = fold_patches(good, _KEY, fields)
    images = patch(main["sequence"], folded, _KEY, as_of, "every")
    return Change(
        ddl=statements(good, [(F.col("_ddl_changed"), F.col("_ddl"))]),
        rejects=batch.rejects,
        replace={"sequence": patch(main["sequence"], folded, _KEY, as_of).select(*SEQUENCE.names)},
        history={"sequence": snapshot(images, SEQUENCE, "U", F.col("_reason"), F.col("_actor"), as_of)},
        update={"sequence": patch(main["sequence"], folded, _KEY, as_of, "changed").select(*SEQUENCE.names)},
    )


def sequence_drop(main: dict[str, DataFrame], requests: DataFrame, as_of) -> Change:
    """Sequences removed, with their last state as history."""
    rows = with_errors(_named(requests, "sequence_drop"), _name_checks())
    rows = reject_repeats(rows, ["_schema", "_sequence"])
    batch = settle(find_object(rows, main["sequence"], _KEY, "seqName", expected=True))
    good = batch.good
    gone = good.select(
        F.col("_schema").alias("SCHEMA_NAME"), F.col("_sequence").alias("SEQUENCE_NAME"), "reason", "_actor"
    )
    same = {"SCHEMA_NAME": "SCHEMA_NAME", "SEQUENCE_NAME": "SEQUENCE_NAME"}
    removed = main["sequence"].join(gone, list(same))
    drop = F.concat(F.lit("DROP SEQUENCE "), F.concat_ws(".", "_schema", "_sequence"), F.lit(";"))
    return Change(
        ddl=statements(good, [(F.lit(True), drop)]),
        rejects=batch.rejects,
        replace={"sequence": not_in(main["sequence"], gone, same, unique=True)},
        history={"sequence": snapshot(removed, SEQUENCE, "D", F.col("reason"), F.col("_actor"), as_of)},
        remove={"sequence": removed},
    )

"""What all kinds of change requests share: screening, patching, removal and publishing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.names import ERROR_TYPE, check_present, errors, problem
from tablewarden.operators.fold import fold_in_order
from tablewarden.operators.history import with_history_ids
from tablewarden.operators.ids import last_id
from tablewarden.operators.joins import in_set, resolve_ids
from tablewarden.session import durable
from tablewarden.sources.catalog import tidy_requests
from tablewarden.sources.registry import current_version, publish, read_all

UNKNOWN_ACTOR = "UNKNOWN"
OUT_OF_USE = "DEPRECATED"
_ON_TABLE = {"_schema": "SCHEMA_NAME", "_table": "TABLE_NAME"}


@dataclass
class Change:
    """Effect of a batch: added rows, changed rows and rows that go per entity, history rows without ids,
    statements (request_id, step, statement), and rejected requests with all their errors.

    ``replace`` shows whole entities as they are after the batch; publishing needs ``update`` and ``remove`` only."""

    ddl: DataFrame
    rejects: DataFrame
    append: dict[str, DataFrame] = field(default_factory=dict)
    replace: dict[str, DataFrame] = field(default_factory=dict)
    history: dict[str, DataFrame] = field(default_factory=dict)
    update: dict[str, DataFrame] = field(default_factory=dict)
    remove: dict[str, DataFrame] = field(default_factory=dict)


def begin(requests: DataFrame, kind: str) -> DataFrame:
    """Tidied requests with the actor filled in, written once: screening goes back to them several times."""
    rows = durable(tidy_requests(requests, kind))
    return rows.withColumn("_actor", F.coalesce("emp_id", F.lit(UNKNOWN_ACTOR)))


def asked_for(registry: DataFrame, rows: DataFrame, on: dict[str, str]) -> DataFrame:
    """The registry rows that a batch can refer to.

    Spark knows the bytes of the requests and broadcasts their keys where these are few, so that the
    registry is not shuffled; else this join shuffles it by the key that the next one needs as well.
    """
    return in_set(registry, rows, {b: a for a, b in on.items()})


def with_errors(rows: DataFrame, checks: list[Column], more: Column | None = None) -> DataFrame:
    """Rows with the list of all their errors; a request needs a reason, an id and its turn."""
    stated = [check_present(f, F.col(f).cast("string")) for f in ("reason", "request_id", "request_seq")]
    found = errors(*stated, *checks)
    if more is not None:
        found = F.concat(found, more.cast(ERROR_TYPE))
    return rows.withColumn("errors", found)


def add_error(rows: DataFrame, failed: Column, field_name: str, value: Column, rule: str) -> DataFrame:
    """Rows with one more error where ``failed`` holds."""
    one = F.array(problem(field_name, value, rule)).cast(ERROR_TYPE)
    return rows.withColumn("errors", F.when(failed, F.concat("errors", one)).otherwise(F.col("errors")))


def reject_same_turns(rows: DataFrame) -> DataFrame:
    """Requests that share their id and turn are all in error, so that turns order the others.

    These are few, as a rule, and written once: Spark knows their bytes then, and the requests are not shuffled for them."""
    met = rows.groupBy(F.col("request_id").alias("_id"), F.col("request_seq").alias("_seq")).agg(F.count(F.lit(1)).alias("_n"))
    names = rows.columns
    rows = rows.join(durable(met.where("_n > 1")), (F.col("request_id") == F.col("_id")) & (F.col("request_seq") == F.col("_seq")), "left")
    return add_error(rows, F.col("_n").isNotNull(), "request_id", F.col("request_id"), "duplicate").select(*names)


def _reject_later(rows: DataFrame, key: list[str], ends: Column, failed: tuple[str, str]) -> DataFrame:
    """An error for good requests that come after their object's earliest good one for which ``ends`` holds.

    Only objects with such requests meet the batch again. They are written once, so that Spark knows their bytes."""
    turn = F.struct("request_seq", "request_id")
    # The test stays inside the aggregate: as a filter it would be pushed below the error list
    # and evaluate all the checks twice.
    good = F.size("errors") == 0
    earliest = rows.groupBy(*[F.col(k).alias(f"_of{k}") for k in key]).agg(
        F.min(F.when(good & ends, turn)).alias("_earliest"), F.max(F.when(good, turn)).alias("_latest")
    )
    ended = durable(earliest.where("_latest > _earliest").drop("_latest"))
    same = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in key]
    joined = rows.join(ended, same, "left")
    later = F.coalesce((F.size("errors") == 0) & (turn > F.col("_earliest")), F.lit(False))
    marked = add_error(joined, later, failed[0], F.col(key[-1]), failed[1])
    return marked.select(*rows.columns)


def reject_repeats(rows: DataFrame, key: list[str]) -> DataFrame:
    """Only the earliest good request per object goes on, where a batch can make an object once."""
    return _reject_later(reject_same_turns(rows), key, F.lit(True), ("request", "duplicate"))


def reject_after_removal(rows: DataFrame, key: list[str], removes: Column, field_name: str) -> DataFrame:
    """Requests take effect one after the other: those behind the one that removes their object find it no more."""
    return _reject_later(reject_same_turns(rows), key, F.coalesce(removes, F.lit(False)), (field_name, "unknown"))


def find_table(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows with the TABLE_ID of the table they name; an unknown table is an error.

    Written once: the next lookup needs them by another key, and so starts with free disks."""
    found = resolve_ids(rows, asked_for(tables, rows, _ON_TABLE), _ON_TABLE, "TABLE_ID")
    return durable(add_error(found, F.col("TABLE_ID").isNull(), "tableName", F.col("_table"), "unknown"))


def find_object(
    rows: DataFrame, registry: DataFrame, on: dict[str, str], field_name: str, expected: bool
) -> DataFrame:
    """Error for a missing object (``expected``) or for one that is already there."""
    known = asked_for(registry, rows, on).select(
        F.lit(True).alias("_found"), *[F.col(b).alias(f"_of{a}") for a, b in on.items()]
    )
    joined = rows.join(known, [F.col(a) == F.col(f"_of{a}") for a in on], "left")
    failed = F.col("_found").isNull() if expected else F.col("_found").isNotNull()
    marked = add_error(
        joined, failed, field_name, F.col(list(on)[-1]), "unknown" if expected else "exists"
    )
    return marked.select(*rows.columns)


@dataclass(frozen=True)
class Batch:
    """Screened requests of one batch."""

    good: DataFrame
    rejects: DataFrame


def settle(rows: DataFrame) -> Batch:
    """The good requests and the rejects. The screened requests are written once, because the
    rows, history and statements all go back to them, and screening joins the registry."""
    kept = durable(rows)
    rejects = kept.filter(F.size("errors") > 0).select("request_id", "request_seq", "errors")
    return Batch(kept.filter(F.size("errors") == 0), rejects)


def audit(rows: DataFrame, as_of) -> DataFrame:
    """Audit columns of new rows."""
    at = F.lit(as_of).cast("timestamp")
    return rows.withColumns(
        {
            "CREATED_BY": F.col("_actor"), "CREATED_AT": at,
            "UPDATED_BY": F.col("_actor"), "UPDATED_AT": at,
        }
    )


def with_request(rows: DataFrame, entity) -> DataFrame:
    """Rows in the entity's schema that keep the request's reason and actor."""
    whole = {f.name: f.dataType for f in entity.schema.fields}
    have = set(rows.columns)
    return rows.select(
        *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in whole.items()],
        "reason", "_actor",
    )


def fold_patches(good: DataFrame, on: dict[str, str], fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Requests with what they and the earlier ones of their object write together, in the order of their turns.

    ``on`` maps request columns to the registry's. ``fields`` maps a registry column to (when to write it, its
    value), both over the request's columns; of several requests that write a field, the latest holds.
    ``_is_last`` marks the request after which the object is done. Written once: rows and history go back to it.
    """
    new = {f"_new_{c}": F.when(cond, F.struct(value.alias("v"))) for c, (cond, value) in fields.items()}
    named = good.select(
        *[F.col(k).alias(f"_of{k}") for k in on], "request_seq", "request_id", F.col("reason").alias("_reason"), "_actor",
        *[value.alias(name) for name, value in new.items()],
    )
    key = [f"_of{k}" for k in on]
    return durable(fold_in_order(named, key, ["request_seq", "request_id"], list(new), "_is_last"))


def patch(main: DataFrame, folded: DataFrame, on: dict[str, str], as_of, how: str = "left") -> DataFrame:
    """Main rows with the patches of ``fold_patches`` written into them.

    The default gives every row, as it is after its last request, and keeps ``_reason`` and ``_actor`` of that
    request, NULL where there was none. ``"every"`` gives one image of the row per request instead, for the
    history, and ``"changed"`` only the rows that have a request.
    """
    new = folded if how == "every" else folded.filter("_is_last")
    joined = main.join(
        new, [F.col(b) == F.col(f"_of{a}") for a, b in on.items()], "left" if how == "left" else "inner"
    )
    hit = F.col("_actor").isNotNull()
    types = {f.name: f.dataType for f in main.schema.fields}
    changes = {
        c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v").cast(types[c])).otherwise(F.col(c))
        for c in [n.removeprefix("_new_") for n in folded.columns if n.startswith("_new_")]
    }
    changes["UPDATED_BY"] = F.when(hit, F.col("_actor")).otherwise(F.col("UPDATED_BY"))
    changes["UPDATED_AT"] = F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("UPDATED_AT"))
    return joined.withColumns(changes).select(*main.columns, "_reason", "_actor")


def statements(good: DataFrame, steps: list[tuple[Column, Column]]) -> DataFrame:
    """One row per statement of each request: those steps whose condition holds, numbered."""
    all_steps = F.array(
        *[F.when(cond, F.struct(F.lit(i).alias("step"), text.alias("statement"))) for i, (cond, text) in enumerate(steps, 1)]
    )
    kept = F.filter(all_steps, lambda s: s.isNotNull())
    return good.select("request_id", F.inline(kept))


def run_changes(spark: SparkSession, root: str, apply, requests: DataFrame, as_of, **options) -> Change:
    """Apply one batch to the registry at ``root``; rows and history become visible together, or, where a new
    row breaks a declared rule or another version was published meanwhile, not at all."""
    version = current_version(spark, root)
    main, history = read_all(spark, root, version)
    change = apply(main, requests, as_of, **options)
    numbered = {
        name: with_history_ids(rows, last_id(history[name], "HIST_ID"))
        for name, rows in change.history.items()
    }
    publish(
        spark, root, as_of, append=change.append, history=numbered, base=version.number, check=True,
        update=change.update, remove=change.remove,
    )
    return change

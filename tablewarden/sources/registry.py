"""The registry on shared storage: Parquet rows, and one manifest row per published version.

Rows are first written to folders of their own; only the manifest row, written last, makes them
part of the registry. A job that fails before that leaves the current version as it was.
There is one writer at a time; any number of readers see whole versions only.

The rows of an entity lie in parts by the hash of their primary key, so that a change finds the parts that
it touches from its keys alone: those are written anew, without reading the others.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.operators.integrity import children_of, publish_violations
from tablewarden.operators.joins import not_in
from tablewarden.schemas import ENTITIES, Entity
from tablewarden.session import durable

_MANIFEST = (
    "version BIGINT, published_at TIMESTAMP, "
    "main MAP<STRING, ARRAY<STRING>>, history MAP<STRING, ARRAY<STRING>>, parts INT"
)
# A registry keeps the number of parts of its first version; versions from before parts count as this.
PARTS = 32


@dataclass
class Version:
    """Folders that make up one version: parts per entity, and history batches per entity."""

    number: int = 0
    main: dict[str, list[str]] = field(default_factory=dict)
    history: dict[str, list[str]] = field(default_factory=dict)
    parts: int = PARTS


def current_version(spark: SparkSession, root: str) -> Version:
    try:
        manifest = spark.read.schema(_MANIFEST).json(f"{root}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return Version()
    row = manifest.orderBy(F.desc("version")).first()
    if row is None:
        return Version()
    return Version(row.version, dict(row.main or {}), dict(row.history or {}), row.parts or PARTS)


def _rows(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read_registry(spark: SparkSession, root: str, entity: str, version: Version | None = None) -> DataFrame:
    """Current rows of one entity."""
    version = version or current_version(spark, root)
    return _rows(spark, version.main.get(entity, []), ENTITIES[entity].schema)


def read_history(spark: SparkSession, root: str, entity: str, version: Version | None = None) -> DataFrame:
    """All history rows of one entity."""
    version = version or current_version(spark, root)
    return _rows(spark, version.history.get(entity, []), ENTITIES[entity].history_schema)


def read_all(
    spark: SparkSession, root: str, version: Version | None = None
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Main and history rows of every entity, all of one version."""
    version = version or current_version(spark, root)
    return (
        {name: read_registry(spark, root, name, version) for name in ENTITIES},
        {name: read_history(spark, root, name, version) for name in ENTITIES},
    )


def _write(df: DataFrame, schema, path: str, sort_by: list[str]) -> str:
    rows = df.select([F.col(f.name).cast(f.dataType) for f in schema.fields])
    rows.sortWithinPartitions(*sort_by).write.parquet(path)
    return path


def part_of(entity: Entity, parts: int) -> Column:
    """The part of a row, by its primary key in the declared types."""
    key = [F.col(k).cast(entity.schema[k].dataType) for k in entity.primary_key]
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def _named_part(path: str) -> int | None:
    """The part that a folder holds; one written before there were parts may hold rows of any."""
    found = re.search(r"/part=(\d+)$", path)
    return int(found[1]) if found else None


def _write_parts(df: DataFrame, entity: Entity, parts: int, path: str) -> list[str]:
    """One folder per part that has rows. The rebalance splits a part with very many rows over tasks and files."""
    schema = entity.schema
    rows = df.select([F.col(f.name).cast(f.dataType) for f in schema.fields]).withColumn("part", part_of(entity, parts))
    spread = rows.hint("rebalance", F.col("part"))
    spread.sortWithinPartitions("part", *entity.primary_key).write.partitionBy("part").parquet(path)
    written = df.sparkSession.read.schema(schema.add("part", T.IntegerType())).parquet(path)
    return [f"{path}/part={r.part}" for r in written.select("part").distinct().orderBy("part").collect()]


def _rewrite_parts(
    spark: SparkSession, version: Version, entity: Entity, update: DataFrame | None, removed: DataFrame | None, path: str
) -> list[str]:
    """The entity's folders after rows were changed or removed: touched parts written anew, the others as they were.

    What the driver gets is the numbers of the touched parts, at most as many as there are parts.
    """
    key = list(entity.primary_key)
    keys = [df.select(*key) for df in (update, removed) if df is not None]
    keys = reduce(DataFrame.unionByName, keys).distinct()
    touched = {r.part for r in keys.select(part_of(entity, version.parts).alias("part")).distinct().collect()}
    held = version.main.get(entity.name, [])
    if not touched:
        return held
    old = [p for p in held if _named_part(p) in touched | {None}]
    after = not_in(_rows(spark, old, entity.schema), keys, {k: k for k in key}, unique=True)
    if update is not None:
        after = after.unionByName(update.select(*entity.names))
    return [p for p in held if p not in old] + _write_parts(after, entity, version.parts, path)


def _refuse_violations(
    spark: SparkSession, new: Version, update: dict[str, DataFrame], removed: dict[str, DataFrame],
    appended: dict[str, list[str]], replaced: set[str], as_of,
) -> None:
    """Fail if the rows just written break a declared rule, or if a removed row still has children.

    Other rows of older versions are not checked again. The keys of removed rows are written already, so Spark
    knows their bytes: where they are few the children are scanned, not shuffled.
    """
    found = []
    for name in sorted({*appended, *replaced, *update}):
        entity = ENTITIES[name]
        parent = entity.parent and _rows(spark, new.main.get(entity.parent[0], []), ENTITIES[entity.parent[0]].schema)
        if name in appended:
            added = _rows(spark, appended[name], entity.schema)
            known = _rows(spark, [p for p in new.main[name] if p not in appended[name]], entity.schema)
        elif name in update:
            added, known = update[name], _rows(spark, [], entity.schema)
        elif "UPDATED_AT" in entity.names:
            added = _rows(spark, new.main[name], entity.schema).filter(F.col("UPDATED_AT") == F.lit(as_of).cast("timestamp"))
            known = _rows(spark, [], entity.schema)
        else:
            continue
        found.append(publish_violations(entity, added, known, parent))
    for name, gone in sorted(removed.items()):
        for child in ENTITIES.values():
            if child.parent and child.parent[0] == name:
                rows = _rows(spark, new.main.get(child.name, []), child.schema)
                found.append(children_of(rows, child, gone))
    if found:
        broken = reduce(DataFrame.unionByName, found).take(5)
        if broken:
            raise ValueError("rows break declared rules, for example " + "; ".join(f"{r.entity} {r.key}: {r.rule}" for r in broken))


def publish(
    spark: SparkSession,
    root: str,
    as_of,
    append: dict[str, DataFrame] | None = None,
    replace: dict[str, DataFrame] | None = None,
    history: dict[str, DataFrame] | None = None,
    base: int | None = None,
    check: bool = False,
    update: dict[str, DataFrame] | None = None,
    remove: dict[str, DataFrame] | None = None,
    parts: int = PARTS,
) -> Version:
    """Write new, changed and history rows, then publish them together.

    ``append`` adds rows, ``replace`` gives whole entities. ``update`` gives whole rows by primary key, which take the
    place of the present ones (or are added), and ``remove`` the primary keys of rows that go: only the parts with
    such keys are read and written. ``parts`` counts for the first version alone. ``base`` is the version that the
    rows were computed from: if another one has been published since,
    nothing becomes visible and the call fails. With ``check`` the same happens where an appended or updated row, or a
    replaced one that carries this time of change, breaks a declared rule, or a removed row still has children. The
    version is compared once more when all rows are written, so that a version published meanwhile is not lost from
    the manifest.
    """
    sets = [set(append or {}), set(replace or {}), set(update or {}) | set(remove or {})]
    both = sorted(n for n in set.union(*sets) if sum(n in s for s in sets) > 1)
    if both:
        raise ValueError(f"rows both appended to and replacing {', '.join(both)}")
    old = current_version(spark, root)
    if base is not None and base != old.number:
        raise RuntimeError(f"version {old.number} was published after version {base} had been read")
    batch = uuid.uuid4().hex
    new = Version(
        old.number + 1,
        {k: list(v) for k, v in old.main.items()},
        {k: list(v) for k, v in old.history.items()},
        old.parts if old.number else parts,
    )
    appended = {}
    for name, df in (append or {}).items():
        appended[name] = _write_parts(df, ENTITIES[name], new.parts, f"{root}/main/{name}/{batch}-add")
        new.main.setdefault(name, []).extend(appended[name])
    for name, df in (replace or {}).items():
        new.main[name] = _write_parts(df, ENTITIES[name], new.parts, f"{root}/main/{name}/{batch}-all")
    # Written once: the parts, the rows that stay, and the checks all go back to them.
    updated = {n: durable(df.select([F.col(f.name).cast(f.dataType) for f in ENTITIES[n].schema.fields])) for n, df in (update or {}).items()}
    removed = {n: durable(df.select(*ENTITIES[n].primary_key)) for n, df in (remove or {}).items()}
    for name in sorted({*updated, *removed}):
        path = f"{root}/main/{name}/{batch}-part"
        new.main[name] = _rewrite_parts(spark, new, ENTITIES[name], updated.get(name), removed.get(name), path)
    for name, df in (history or {}).items():
        entity = ENTITIES[name]
        # Sorted by key and time, so that Parquet's min/max statistics prune a lookup of one object.
        path = _write(
            df, entity.history_schema, f"{root}/history/{name}/{batch}",
            [*entity.primary_key, "HIST_AT"],
        )
        new.history.setdefault(name, []).append(path)
    if check:
        _refuse_violations(spark, new, updated, removed, appended, set(replace or {}), as_of)
    now = current_version(spark, root).number
    if now != old.number:
        raise RuntimeError(f"version {now} was published while rows on version {old.number} were being written")
    row = [(new.number, as_of, new.main, new.history, new.parts)]
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return new


def append_rows(df: DataFrame, root: str, entity: str, as_of) -> Version:
    """Publish new rows of one entity."""
    return publish(df.sparkSession, root, as_of, append={entity: df})


def append_history(df: DataFrame, root: str, entity: str, as_of) -> Version:
    """Publish new history rows of one entity."""
    return publish(df.sparkSession, root, as_of, history={entity: df})

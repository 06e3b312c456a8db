"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk on the texts themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoded, frugal, joined, own_names, passing, ship, slices, stage

# A fingerprint is a polynomial in the bytes, modulo two primes; values stay below 2**31.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1299709)
CHUNK_CHARS = 1 << 18
KEY = ["n_bytes", "h1", "h2"]


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


_TABLES: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo the prime, by doubling; kept for the next slice."""
    out = _TABLES.get((base, prime), np.ones(1, np.int64))
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    _TABLES[base, prime] = out
    return out


def fingerprints(parts: list[bytes]) -> dict[str, np.ndarray]:
    """Of each part: its length, its hashes, and the factors that shift what stands before it by its length.

    hash(x + y) = hash(x) * shift(y) + hash(y), so hashes of chunks made in different tasks combine.
    """
    out = {"n_bytes": np.array([len(p) for p in parts], np.int64)}
    for k, (base, prime) in enumerate(zip(BASES, PRIMES), start=1):
        out[f"h{k}"], out[f"shift{k}"] = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for i, j in slices(out["n_bytes"]):
        buffer, bounds = joined(parts[i:j])
        values = buffer.astype(np.int64) + 1
        size = out["n_bytes"][i:j]
        full = np.flatnonzero(size)
        for k, (base, prime) in enumerate(zip(BASES, PRIMES), start=1):
            up = _powers(base, prime, len(buffer) + 1)
            out[f"shift{k}"][i:j] = up[size]
            if len(full):
                # Weights fall towards the end of the slice; dividing by what follows a part leaves its own hash.
                sums = np.add.reduceat(values * up[: len(buffer)][::-1], bounds[:-1][full]) % prime
                back = _powers(pow(base, -1, prime), prime, len(buffer) + 1)
                out[f"h{k}"][i:j][full] = sums * back[len(buffer) - bounds[1:][full]] % prime
    return out


_CHUNK = "uid long, doc_id long, pos int, text_sha256 string, n_bytes long, h1 long, shift1 long, h2 long, shift2 long"


def _hash_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        found = fingerprints(encoded(frame["chunk"].to_pylist()))
        names = ["uid", "doc_id", "pos", "text_sha256"]
        yield pa.RecordBatch.from_arrays([*(frame[n] for n in names), *map(pa.array, found.values())], [*names, *found])


def _combined(k: int) -> Column:
    prime = PRIMES[k - 1]
    return F.aggregate(
        "chunks", F.lit(0).cast("long"), lambda h, c: F.pmod(h * c[f"shift{k}"] + c[f"h{k}"], F.lit(prime))
    ).alias(f"h{k}")


def chunked(docs: DataFrame, *names: str) -> DataFrame:
    """One row for each CHUNK_CHARS characters of ``norm`` (one for an empty text): the named columns, pos, chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.length("norm") / CHUNK_CHARS)).cast("int")
    place = F.explode(F.sequence(F.lit(0), n - 1)).alias("pos")
    return docs.select(*names, "norm", place).select(
        *names, "pos", F.substring(F.col("norm"), F.col("pos") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("chunk")
    )


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text_sha256, n_bytes, h1, h2) for each row; chunks of one text may be hashed anywhere."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm")).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "norm", F.sha2("norm", 256).alias("text_sha256")
    )
    hashed = chunked(texts, "uid", "doc_id", "text_sha256").mapInArrow(frugal(_hash_batches), _CHUNK)
    chunks = F.array_sort(F.collect_list(F.struct("pos", "n_bytes", "h1", "shift1", "h2", "shift2")))
    return (
        hashed.groupBy("uid", "doc_id", "text_sha256").agg(F.sum("n_bytes").alias("n_bytes"), chunks.alias("chunks"))
        .select("uid", "doc_id", "text_sha256", "n_bytes", _combined(1), _combined(2))
    )


def unequal(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of members whose text differs from their group's first, compared in chunks.

    ``members``: doc_id, text_sha256, the key, and the first's doc_id and sha of each group. The chunks of
    a group meet its first's chunks by (group, place), which a skewed join can split; no group is gathered.
    """
    texts = docs.select(
        "doc_id", normalised(F.col("text")).alias("norm")
    ).withColumn("text_sha256", F.sha2("norm", 256))
    wanted = members.distinct()
    found = texts.join(wanted, (texts.doc_id.eqNullSafe(wanted.doc_id)) & (texts.text_sha256 == wanted.text_sha256)).select(
        wanted.doc_id, wanted.text_sha256, *KEY, "first_id", "first_sha", "norm"
    )
    chunks = stage(chunked(found, "doc_id", "text_sha256", *KEY, "first_id", "first_sha"), "chunks")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_sha256") == F.col("first_sha"))
    first = stage(chunks.where(is_first).select(*KEY, "pos", F.col("chunk").alias("like")).dropDuplicates([*KEY, "pos"]), "firsts")
    return (
        chunks.where(~is_first).join(first, [*KEY, "pos"], "left")
        .where(~F.col("chunk").eqNullSafe(F.col("like"))).select("doc_id", "text_sha256").distinct()
    )


def _order() -> Column:
    """Ascending doc_id, null last; of repeated ids the row met first."""
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "uid", "text_sha256")


def groups_of(rows: DataFrame, key: list[str]) -> DataFrame:
    """Groups of more than one row: their key, first row and size."""
    return (
        rows.groupBy(*key).agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs`` (doc_id, text).

    Texts are equal when identical after ``normalised``. The row with the smallest doc_id stays (null ids
    come last; of repeated rows exactly one stays). Rows with equal fingerprints are compared with the first
    of their group chunk by chunk; those that differ are grouped by their own digest instead.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    prints = stage(fingerprint_table(docs), "prints")
    alike = stage(groups_of(prints, KEY), "alike")
    members = prints.join(alike, KEY).select(
        "doc_id", "text_sha256", *KEY, F.col("first.doc_id").alias("first_id"), F.col("first.text_sha256").alias("first_sha")
    )
    odd = stage(unequal(docs, stage(members, "members")), "unequal").withColumn("own", F.col("text_sha256"))
    odd = odd.select(F.col("doc_id").alias("odd_id"), F.col("text_sha256").alias("odd_sha"), "own")
    rows = stage(
        prints.join(odd, F.col("doc_id").eqNullSafe(F.col("odd_id")) & (F.col("text_sha256") == F.col("odd_sha")), "left")
        .select(prints["*"], F.coalesce("own", F.lit("")).alias("own")),
        "rows",
    )
    groups = stage(groups_of(rows, [*KEY, "own"]), "groups")
    alone = F.col("first").isNull()
    return rows.join(groups, [*KEY, "own"], "left").select(
        "uid", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("first.uid"))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.

    Decisions are carried by (doc_id, digest); rows repeated with the same id and text are told apart by
    numbering just those.
    """
    keep, sha, copied = own_names(docs, "keep", "sha", "copied")
    with passing(docs.sparkSession, "kept"):
        found = exact_groups(docs).where("kept")
        kept = stage(
            found.select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(sha), (F.col("group_size") > 1).alias(copied)), "kept"
        )
    same = docs["doc_id"].cast("long").eqNullSafe(kept[keep]) & (F.sha2(normalised(docs["text"]), 256) == kept[sha])
    rows = docs.join(kept, same)
    single = rows.where(~kept[copied]).select(docs["*"])
    first = rows.where(kept[copied]).dropDuplicates([keep, sha]).select(docs["*"])
    return single.unionByName(first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the row that stays for its text, the number of equal texts, and the digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).drop("uid")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""

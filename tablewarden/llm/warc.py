"""WARC archives: written by Spark's text writer, read back in splits with a chain of record boundaries verified.

A record's start is certain only from the file's start on: payloads may hold the magic line, or whole records.
Tasks therefore note every place of the magic with the place its record would end, and pointer jumping from
the start of each file keeps those that the chain reaches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, shared_path, ship, stage

MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

# The digits of base 32 (RFC 4648) and those of Spark's conv.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32(hex_sha1: Column) -> Column:
    """Base 32 of a SHA-1 given as 40 hexadecimal digits, four digits for every five."""
    parts = [F.lpad(F.conv(F.substring(hex_sha1, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _CONV, _BASE32)


def record_id(page_id: Column) -> Column:
    """A urn that holds the page's number; a null number has its own."""
    h = F.lower(F.lpad(F.hex(F.coalesce(page_id, F.lit(0).cast("long"))), 16, "0"))
    end = F.when(page_id.isNull(), F.lit("000000000001")).otherwise(F.lit("000000000000"))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.lit("8000"), end]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def classified(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to, response) for each row of ``pages`` (page_id, url, html).

    Of equal payloads the row with the largest page_id is the response (nulls count as smallest; of rows
    that repeat that id one is). Only ids and digests of equal payloads are gathered; what is joined to
    the pages is the list of those rows, and Spark picks the kind of join by its size.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    prints = stage(rows.groupBy("sha1", "size", "page_id").agg(F.count(F.lit(1)).alias("n")), "payloads")
    groups = stage(
        prints.groupBy("sha1", "size").agg(
            F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "n")).alias("top"), F.sum("n").alias("rows")
        ).where("rows > 1"),
        "equal-payloads",
    )
    marks = stage(
        prints.join(groups, ["sha1", "size"]).select(
            "sha1", "page_id", F.col("top.page_id").alias("top_id"), (F.col("top.n") > 1).alias("repeated")
        ),
        "marks",
    )
    m = marks.select(F.col("sha1").alias("m_sha1"), F.col("page_id").alias("m_id"), "top_id", "repeated")
    marked = rows.join(m, (F.col("sha1") == F.col("m_sha1")) & F.col("page_id").eqNullSafe(F.col("m_id")), "left")
    is_top = F.col("m_sha1").isNull() | F.col("page_id").eqNullSafe(F.col("top_id"))
    marked = marked.withColumn("response", is_top)
    if not marks.where("repeated").isEmpty():
        again = F.coalesce(F.col("repeated"), F.lit(False)) & is_top
        number = F.row_number().over(Window.partitionBy("sha1", "page_id").orderBy("url"))
        marked = marked.where(~again).unionByName(marked.where(again).withColumn("response", number == 1))
    return marked.select(
        "page_id", "url", "payload", "sha1", "size", F.when(~F.col("response"), F.col("top_id")).alias("refers_to"), "response"
    )


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """One record for each row: a response with its payload, or a revisit that names the response."""
    rows = classified(pages)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(GAP)
    )
    block = F.when(F.col("response"), F.concat(http, F.col("payload"))).otherwise(http)
    url = F.regexp_replace("url", "[\\x00-\\x20]", "%20")
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(F.col("response"), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.when(url.isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), url)).otherwise(""),
        F.when(~F.col("response"), F.concat(F.lit("\r\nWARC-Refers-To: "), record_id(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    value = F.concat(head, F.octet_length("block").cast("string"), F.lit(GAP), F.col("block"))
    rows.withColumn("block", block).select(value.alias("value")).write.option("lineSep", GAP).text(path)


_SEGMENT = (
    "path string, split long, nth long, rel long, size long, next_rel long, exit_rel long, complete boolean, "
    "type string, id string, refers string, digest string, payload_bytes long"
)
_NAMES = [c.split()[0] for c in _SEGMENT.split(", ")]
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r$", re.M)


def _parsed(value: bytes) -> tuple | None:
    """Header fields, where the block begins and how long it is; None if this is no record."""
    end = value.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(value[: end + 2])}
    size = fields.get(b"content-length", b"")
    return (fields, end + 4, int(size)) if size.isdigit() and b"warc-type" in fields else None


def _payload(fields: dict, block: bytes) -> tuple[int, str]:
    """Length and digest of the full payload; a revisit states both in its headers."""
    at = block.find(b"\r\n\r\n")
    if fields.get(b"warc-type") == b"revisit":
        stated = dict(_FIELD.findall(block[: at + 2])).get(b"Content-Length", b"0")
        return int(stated), fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
    body = block[at + 4 :] if at >= 0 else block
    return len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two places of the magic, split by split, in the order of the file."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """path, split, number and place within the split, bytes."""
    here, nth, rel = None, 0, 0
    for batch in batches:
        for value, path, split in zip(*(batch[c].to_pylist() for c in ("value", "path", "split"))):
            if (path, split) != here:
                here, nth, rel = (path, split), 0, 0
            yield path, split, nth, rel, value
            nth, rel = nth + 1, rel + len(value) + len(MAGIC)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment with the place where its record would end and where the chain would leave this split."""
    rows, here = [], None

    def flush() -> pa.RecordBatch:
        leaves = {}
        for row in reversed(rows):
            if row["next_rel"] is not None:
                row["exit_rel"] = leaves[row["rel"]] = leaves.get(row["next_rel"], row["next_rel"])
        return pa.RecordBatch.from_pylist(rows, _ARROW)

    for path, split, nth, rel, value in _numbered(batches):
        if here != (path, split) and rows:
            yield flush()
            rows.clear()
        here = path, split
        row = dict.fromkeys(_NAMES) | {"path": path, "split": split, "nth": nth, "rel": rel, "size": len(value), "complete": False}
        found = None if split == 0 and nth == 0 else _parsed(value)
        if found:
            fields, start, size = found
            row["next_rel"] = rel + start + size + len(GAP) + len(MAGIC)
            row["complete"] = len(value) >= start + size
            row["type"] = fields[b"warc-type"].decode("ascii", "replace")
            row["id"] = fields.get(b"warc-record-id", b"").decode("ascii", "replace")
            row["refers"] = fields[b"warc-refers-to"].decode("ascii", "replace") if b"warc-refers-to" in fields else None
            if row["complete"]:
                row["payload_bytes"], row["digest"] = _payload(fields, value[start : start + size])
        rows.append(row)
    if rows:
        yield flush()


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _SEGMENT.split(", ")])


def _reached(nodes: DataFrame) -> DataFrame:
    """(path, at): places that the chain from the start of each file reaches, among ``nodes`` (path, at, to).

    Pointer jumping: each round joins the reached places with pointers twice as long as before, so the number
    of rounds is the logarithm of the number of splits of a file.
    """
    first = nodes.groupBy("path").agg(F.min("at").alias("at")).where(F.col("at") == len(MAGIC))
    reached, jumps = stage(first, "reached"), nodes
    n = reached.count()
    while True:
        ahead = reached.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        wider = stage(reached.union(ahead.join(nodes.select("path", "at"), ["path", "at"], "left_semi")).distinct(), "reached")
        size = wider.count()
        if size == n:
            return wider
        reached, n = wider, size
        far = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("far"))
        jumps = stage(jumps.join(far, ["path", "to"]).select("path", "at", F.col("far").alias("to")), "jumps")


def _follow(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one split's segments: those on the chain from the entry, and for the others the one they belong to."""
    frame = frame.sort_values("nth")
    place, owners, owner = frame["entry"].iloc[0], [], None
    for rel, nth, to in zip(frame["rel"], frame["nth"], frame["next_rel"]):
        if rel == place:
            owner, place = nth, to
        owners.append(-1 if owner is None else owner)
    return frame.assign(owner=owners).drop(columns="entry")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each record that the chain reaches.

    Payloads that hold the magic lie in several segments; those few are read again and put together by record.
    """
    ship(spark)
    found = stage(_segments(spark, path).mapInArrow(frugal(_candidates), _SEGMENT), "segments")
    sizes = found.groupBy("path", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(sizes.select("path", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "bases")
    placed = found.join(bases, ["path", "split"])
    # A record that begins at `at` (just behind its magic) sends the chain to `to` (behind the next magic).
    links = stage(
        placed.where("next_rel IS NOT NULL").select(
            "path", "split", "rel", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("exit_rel")).alias("to")
        ),
        "links",
    )
    starts = links.select("path", F.col("to").alias("at")).union(
        links.select("path").distinct().select("path", F.lit(len(MAGIC)).cast("long").alias("at"))
    ).distinct()
    nodes = stage(links.join(starts, ["path", "at"], "left_semi").select("path", "at", "to"), "nodes")
    entries = links.join(_reached(nodes), ["path", "at"], "left_semi").groupBy("path", "split").agg(F.min("rel").alias("entry"))
    kept = ["path", "split", "nth", "rel", "next_rel", "complete", "type", "id", "refers", "digest", "payload_bytes"]
    marked = stage(
        found.select(*kept).join(stage(entries, "entries"), ["path", "split"]).groupBy("path", "split")
        .applyInPandas(_follow, "path string, split long, nth long, rel double, next_rel double, complete boolean, type string, id string, refers string, digest string, payload_bytes double, owner long"),
        "marked",
    )
    records = marked.where("owner = nth")
    whole = records.where("complete").select("type", "id", "refers", F.col("payload_bytes").cast("long").alias("payload_bytes"), "digest")
    cut = records.where("NOT complete")
    if not cut.isEmpty():
        whole = whole.union(_put_together(spark, path, found, bases, marked))
    number = lambda c: F.when(
        F.col(c).endswith("1>"), F.lit(None).cast("long")
    ).otherwise(F.conv(F.translate(F.substring(c, 11, 18), "-", ""), 16, -10).cast("long"))
    return whole.select(
        number("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(F.col("refers").isNotNull(), number("refers")).alias("refers_to"),
    )


def _put_together(spark: SparkSession, path: str, found: DataFrame, bases: DataFrame, marked: DataFrame) -> DataFrame:
    """The records whose payload holds the magic, from all their segments, also over the ends of splits."""
    at = found.select("path", "split", "nth", "rel").join(bases, ["path", "split"]).select("path", "split", "nth", (F.col("base") + F.col("rel")).alias("at"))
    chain = at.join(marked.where("owner = nth").select("path", "split", "nth", "complete"), ["path", "split", "nth"], "left")
    # Places between two records of the chain belong to the earlier one.
    last = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = chain.select(
        "path", "split", "nth", "at",
        F.last(F.when(F.col("complete").isNotNull(), F.struct(F.col("at").alias("record"), "complete")), True).over(last).alias("of"),
    ).where("NOT of.complete")
    wanted = stage(owned.select("path", "split", "nth", "at", "of.record"), "cut")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, split, nth, _, value in _numbered(batches):
            yield pa.RecordBatch.from_pydict({"path": [p], "split": [split], "nth": [nth], "value": [value]})

    parts = _segments(spark, path).mapInArrow(frugal(numbered), "path string, split long, nth long, value binary")

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        value = MAGIC.encode().join(frame.sort_values("at")["value"])
        fields, start, size = _parsed(value)
        n, digest = _payload(fields, value[start : start + size])
        text = lambda k: fields[k].decode("ascii", "replace") if k in fields else None
        return pd.DataFrame([[text(b"warc-type"), text(b"warc-record-id"), text(b"warc-refers-to"), n, digest]], columns=["type", "id", "refers", "payload_bytes", "digest"])

    return parts.join(wanted, ["path", "split", "nth"]).groupBy("path", "record").applyInPandas(
        joined, "type string, id string, refers string, payload_bytes long, digest string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record for every page, read the archives back, and give what they say about each page."""
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path)


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string([substr('{_BASE32}', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)
                        FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM t
"""

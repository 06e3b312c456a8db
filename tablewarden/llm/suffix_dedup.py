"""Repeated passages across documents: prefix-free parsing at rolling-hash triggers, and sorted dictionary suffixes.

Every WINDOW-byte string has a trigger, the place of the smallest rolling hash of K bytes among those it holds
(the leftmost of equals); equal strings have it at equal places. The windows with one trigger start next to
each other, and the phrase that they reach over, the trigger's zone, decides all of them. So the corpus is
parsed into zones, and only zones that differ around the same trigger need a look at single windows:

* Documents stand in blocks of bounded size. For each distinct trigger a block announces its zone's hash (or
  that the zones differ within the block) and the smallest document with it.
* Per trigger, blocks learn of a smaller document elsewhere with the same zone, which covers theirs; else whether
  other zones have that trigger.
* For those, each block, the first to hold its zone, sorts the suffixes of its dictionary of zones that begin at a
  window (a suffix array, which WINDOW bytes suffice to order), takes equal neighbours together, and announces
  each distinct window once, with the smallest document; smaller documents elsewhere come back.
* A window is removed where its trigger's zone, or the window itself, has a smaller document.

What travels is one entry a block for each distinct trigger or window, so that a passage which a third of all
documents share costs one entry a block, and no task gathers its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, mix64, parts_for, prefix_hash, ship, stage, stretch_hash, text_bytes

WINDOW = 50
K = 18
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
SLICE = 1 << 18
SORTED_AT_ONCE = 1 << 16
_RUN = WINDOW - K + 1  # rolling hashes in a window
_NO_ID = np.iinfo(np.int64).max  # a null doc_id comes after all others
_DIFFER = np.iinfo(np.int64).min


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


class Parse:
    """The triggers of a block of texts: text, hash, zone hash, and first and last window start in the buffer."""

    def __init__(self, buffer: np.ndarray, bounds: np.ndarray):
        self.buffer, self.bounds = buffer, bounds
        parts: list[tuple] = []
        i, n = 0, len(bounds) - 1
        while i < n:
            j = i + 1
            while j < n and bounds[j + 1] - bounds[i] <= SLICE:
                j += 1
            start, end = int(bounds[i]), int(bounds[j])
            # A long text is parsed in pieces that overlap by what a window reaches.
            for at in range(start, max(start + 1, end - WINDOW + 1), SLICE):
                self._parse(at, min(end, at + SLICE + WINDOW - 1), i, j, parts)
            i = j
        columns = list(zip(*parts)) or [()] * 5
        kinds = (np.int64, np.uint64, np.uint64, np.int64, np.int64)
        self.text, self.key, self.zone, self.first, self.last = (
            np.concatenate([np.zeros(0, k), *c]) for c, k in zip(columns, kinds)
        )

    def _parse(self, base: int, end: int, i: int, j: int, parts: list) -> None:
        n = end - base
        if n < WINDOW:
            return
        h = prefix_hash(self.buffer[base:end])
        grams = np.arange(n - K + 1, dtype=np.int32)
        rolled = stretch_hash(h, grams, grams + np.int32(K))
        least, at, size = rolled, grams, 1
        while size < _RUN:  # the smallest of each run, by doubling
            step = min(size, _RUN - size)
            later = least[step:] < least[:-step]
            least, at = np.where(later, least[step:], least[:-step]), np.where(later, at[step:], at[:-step])
            size += step
        edges = np.clip(self.bounds[i : j + 1] - base, 0, n)
        text = np.repeat(np.arange(i, j, dtype=np.int32), np.diff(edges))
        windows = n - WINDOW + 1
        inside = text[:windows] == text[WINDOW - 1 :]
        start = np.flatnonzero(inside)
        if not len(start):
            return
        trigger = at[:windows][inside]
        new = np.append(True, (trigger[1:] != trigger[:-1]) | (start[1:] != start[:-1] + 1))
        first, place = start[new], trigger[new]
        last = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
        zone = stretch_hash(h, first, last + WINDOW) ^ mix64((place - first).astype(np.uint64))
        parts.append((text[first].astype(np.int64), rolled[place], zone, first + base, last + base))

    def windows_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All window starts of the chosen triggers, and for each the trigger it came from."""
        n = self.last[chosen] - self.first[chosen] + 1
        owner = np.repeat(chosen, n)
        return self.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def _hashes(buffer: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the windows at these starts."""
    out = np.zeros(len(start), np.uint64)
    order = np.argsort(start)
    edges = np.searchsorted(start[order], np.arange(0, len(buffer) + SLICE, SLICE))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if b > a:
            at = start[order[a:b]] - k * SLICE
            h = prefix_hash(buffer[k * SLICE : k * SLICE + int(at[-1]) + WINDOW])
            out[order[a:b]] = stretch_hash(h, at, at + WINDOW)
    return out


class Windows:
    """The distinct windows of some triggers of a block: hash and smallest document of each, and all their places.

    Equal windows have equal triggers, so the suffixes are sorted for some triggers at a time.
    """

    def __init__(self, parse: Parse, chosen: np.ndarray, doc: np.ndarray):
        chosen = chosen[np.argsort(parse.key[chosen], kind="stable")]
        self.start, owner = parse.windows_of(chosen)
        self.doc = doc[owner]
        self.of = np.zeros(len(owner), np.int64)  # which distinct window each place has
        key, first, least, found = parse.key[owner], [], [], 0
        at = 0
        while at < len(owner):
            end = min(len(owner), at + SORTED_AT_ONCE)
            end = int(np.searchsorted(key, key[end - 1], "right"))
            start = self.start[at:end]
            rows = np.lib.stride_tricks.sliding_window_view(parse.buffer, WINDOW)[start]
            order = np.argsort(rows.view(f"V{WINDOW}").ravel(), kind="stable")
            rows = rows[order]
            begin = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
            self.of[at + order] = found + np.repeat(np.arange(len(begin)), np.diff(np.append(begin, end - at)))
            first.append(start[order[begin]])
            least.append(np.minimum.reduceat(self.doc[at:end][order], begin))
            found, at = found + len(begin), end
        self.hash = _hashes(parse.buffer, np.concatenate([np.zeros(0, np.int64), *first]))
        self.least = np.concatenate([np.zeros(0, np.int64), *least])


_BLOCK = "block long, ids binary, lengths binary, texts binary, rest binary"


def blocks(docs: DataFrame, keep: list[str], block_bytes: int) -> DataFrame:
    """Rows of ``block_bytes`` of text or one longer text: ids (null as the largest), byte lengths (negative for
    a null text), packed texts, and the columns to keep as an Arrow stream."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, texts, rest, size, n = [], [], [], [], 0, 0
        task = TaskContext.get().partitionId()
        schema = pa.schema([("block", pa.int64()), *((c.split()[0], pa.binary()) for c in _BLOCK.split(", ")[1:])])

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest[0].schema) as out:
                for part in rest:
                    out.write_batch(part)
            packed = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            row = [task << 32 | n, np.array(ids, np.int64).tobytes(), np.array(lengths, np.int64).tobytes(), packed, sink.getvalue().to_pybytes()]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema)

        for frame in frames:
            first = 0
            kept = frame.drop_columns(["own_id", "own_text"])
            for at, (doc_id, text) in enumerate(zip(frame["own_id"].to_pylist(), frame["own_text"].to_pylist())):
                data = text.encode() if text else b""
                if texts and size + len(data) > block_bytes:
                    rest.append(kept.slice(first, at - first))
                    yield block()
                    ids, lengths, texts, rest, size, n, first = [], [], [], [], 0, n + 1, at
                ids.append(_NO_ID if doc_id is None else doc_id)
                lengths.append(-1 if text is None else len(data))
                texts.append(data)
                size += len(data)
            rest.append(kept.slice(first))
        if texts:
            yield block()

    own = [F.col("doc_id").cast("long").alias("own_id"), F.col("text").alias("own_text")]
    return docs.select(*(docs[c] for c in keep), *own).mapInArrow(frugal(batches), _BLOCK)


class Block:
    def __init__(self, row: dict, n_buckets: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.null = lengths < 0
        bounds = np.append(0, np.cumsum(np.maximum(lengths, 0)))
        data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(bounds[-1]) + 1) if bounds[-1] else b""
        self.parse = Parse(np.frombuffer(data, np.uint8), bounds)
        p = self.parse
        self.doc = self.ids[p.text] if len(p.text) else np.zeros(0, np.int64)
        # Distinct triggers, each named by its whole hash; the zone's hash is 0 where zones differ here.
        order = np.lexsort((p.zone, p.key))
        key, zone, doc = p.key[order], p.zone[order], self.doc[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        end = np.append(begin[1:], len(key))
        self.group = np.zeros(len(key), np.int64)
        self.group[order] = np.repeat(np.arange(len(begin)), end - begin)
        differ = zone[begin] != zone[end - 1] if len(key) else np.zeros(0, bool)
        self.differ = differ
        self.zone = np.where(differ, np.uint64(0), np.maximum(zone[begin], np.uint64(1)))
        self.least = np.minimum.reduceat(doc, begin) if len(key) else doc
        self.bucket = ((key[begin] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        self.name = key[begin]
        self.n_buckets = n_buckets

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and key under which each trigger is announced and told."""
        return self.bucket, self.name

    def of_windows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ((hashes >> np.uint64(32)) % np.uint64(self.n_buckets)).astype(np.int64), hashes


def _announced(block: int, bucket: np.ndarray, key: np.ndarray, doc: np.ndarray, zone: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows (bucket, block, keys, zones, docs) with each bucket's entries, in the order of their documents."""
    order = np.lexsort((key, doc, bucket))
    bucket, key, doc = bucket[order], key[order], doc[order]
    zone = np.zeros(0, np.uint64) if zone is None else zone[order]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[a]), block, key[a:b].tobytes(), zone[a:b].tobytes(), _pack(np.diff(doc[a:b], prepend=0))


_ENTRIES = "bucket long, block long, keys binary, zones binary, docs binary"
_ANSWERS = "block long, buckets long, keys binary, docs binary"


def _frame(rows, schema: str) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=[c.split()[0] for c in schema.split(", ")])


def _announce_triggers(n_buckets: int):
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                b = Block(row, n_buckets)
                yield _frame(_announced(row["block"], *b.asked(), b.least, b.zone), _ENTRIES)

    return batches


def _gathered(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = [np.frombuffer(k, np.uint64) for k in frame["keys"]]
    docs = [np.cumsum(_unpack(d, np.int64)) for d in frame["docs"]]
    return np.concatenate(keys), np.concatenate(docs), np.repeat(frame["block"].to_numpy(np.int64), [len(k) for k in keys])


def _answers(bucket: int, block: np.ndarray, key: np.ndarray, doc: np.ndarray) -> pd.DataFrame:
    """Rows (block, buckets, keys, docs) of one bucket's entries sorted by key."""
    order = np.lexsort((key, block))
    block, key, doc = block[order], key[order], doc[order]
    edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else []
    return _frame(((int(block[a]), bucket, key[a:b].tobytes(), _pack(doc[a:b])) for a, b in zip(edges[:-1], edges[1:])), _ANSWERS)


def _compare_triggers(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: to each block the triggers with an equal zone in a smaller document, which covers all of them
    there; and of those whose zones differ, the ones whose zone the block is the first to hold."""
    key, doc, block = _gathered(frame)
    zone = np.concatenate([np.frombuffer(z, np.uint64) for z in frame["zones"]])
    order = np.lexsort((zone, key))
    key, zone, doc, block = key[order], zone[order], doc[order], block[order]

    def runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(np.append(True, new))
        return begin, np.diff(np.append(begin, len(key)))

    other = key[1:] != key[:-1]
    begin, n = runs(other | (zone[1:] != zone[:-1]))
    least = np.repeat(np.minimum.reduceat(doc, begin), n)
    covered = (zone != 0) & (least < doc)
    begin, n = runs(other)
    differ = np.repeat((zone[begin] != zone[begin + n - 1]) | (zone[begin] == 0), n) & (np.repeat(n, n) > 1)
    told, tell = np.where(covered, least, _DIFFER), covered | differ
    return _answers(int(frame["bucket"].iloc[0]), block[tell], key[tell], told[tell])


def _compare_windows(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: to each block the windows that a smaller document elsewhere holds."""
    key, doc, block = _gathered(frame)
    order = np.argsort(key, kind="stable")
    key, doc, block = key[order], doc[order], block[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    told = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(key))))
    tell = told < doc
    return _answers(int(frame["bucket"].iloc[0]), block[tell], key[tell], told[tell])


def _told(buckets: list | None, keys: list | None, docs: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What several buckets told a block: bucket, key and document."""
    if keys is None or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = [np.frombuffer(k, np.uint64) for k in keys]
    bucket = np.repeat(np.array(buckets, np.int64), [len(k) for k in key])
    return bucket, np.concatenate(key), np.concatenate([_unpack(d, np.int64) for d in docs])


def _look_up(bucket: np.ndarray, key: np.ndarray, told: tuple[np.ndarray, np.ndarray, np.ndarray], missing: int) -> np.ndarray:
    """The document told for each bucket and key."""
    n = len(told[1])
    if not n or not len(key):
        return np.full(len(key), missing)
    buckets, keys = np.concatenate([told[0], bucket]), np.concatenate([told[1], key])
    order = np.lexsort((keys, buckets))  # stable: what was told comes before who asks
    buckets, keys = buckets[order], keys[order]
    begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])))
    docs = np.append(told[2], np.full(len(key), missing))[order[begin]]
    out = np.zeros(len(order), np.int64)
    out[order] = np.repeat(docs, np.diff(np.append(begin, len(order))))
    return out[n:]


def _announce_windows(n_buckets: int):
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                b = Block(row, n_buckets)
                told = _look_up(*b.asked(), _told(row["t_buckets"], row["t_keys"], row["t_docs"]), _NO_ID)
                w = Windows(b.parse, np.flatnonzero((told == _DIFFER)[b.group]), b.doc)
                yield _frame(_announced(row["block"], *b.of_windows(w.hash), w.least), _ENTRIES)

    return batches


def _removed(b: Block, triggers: tuple, windows: tuple) -> np.ndarray:
    """For each byte of the block whether it goes."""
    p = b.parse
    told = _look_up(*b.asked(), triggers, _NO_ID)
    single = (b.differ | (told == _DIFFER))[b.group]
    gone = ~single & (np.minimum(b.least, told)[b.group] < b.doc)
    edges = np.zeros(len(p.buffer) + 1, np.int32)
    np.add.at(edges, p.first[gone], 1)
    np.add.at(edges, p.last[gone] + WINDOW, -1)
    w = Windows(p, np.flatnonzero(single), b.doc)
    least = np.minimum(w.least, _look_up(*b.of_windows(w.hash), windows, _NO_ID))
    start = w.start[least[w.of] < w.doc]
    np.add.at(edges, start, 1)
    np.add.at(edges, start + WINDOW, -1)
    return np.cumsum(edges[:-1]) > 0


def _joined_lists(answers: DataFrame, prefix: str) -> DataFrame:
    return answers.groupBy("block").agg(
        F.collect_list(F.struct("buckets", "keys", "docs")).alias("a")
    ).select("block", *(F.col(f"a.{c}").alias(f"{prefix}_{c}") for c in ("buckets", "keys", "docs")))


def _solved(docs: DataFrame, keep: list[str], block_bytes: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """The blocks with what other blocks told them, and the number of buckets."""
    ship(docs.sparkSession)
    n_buckets = parts_for(text_bytes(docs), bucket_bytes)
    held = stage(blocks(docs, keep, block_bytes), "blocks", "none")
    entries = held.mapInPandas(frugal(_announce_triggers(n_buckets)), _ENTRIES)
    told = stage(entries.groupBy("bucket").applyInPandas(_compare_triggers, _ANSWERS), "triggers", "none")
    lists = _joined_lists(told, "t")
    asked = held.join(lists, "block").mapInPandas(frugal(_announce_windows(n_buckets)), _ENTRIES)
    windows = stage(asked.groupBy("bucket").applyInPandas(_compare_windows, _ANSWERS), "windows", "none")
    both = lists.join(_joined_lists(windows, "w"), "block", "left")
    return held.join(both, "block", "left"), n_buckets


def _applied(docs: DataFrame, keep: list[str], schema: str, made, block_bytes: int, bucket_bytes: int) -> DataFrame:
    """For each row the columns to keep and those that ``made(text bytes, removed flags, null)`` gives."""
    solved, n_buckets = _solved(docs, keep, block_bytes, bucket_bytes)
    fields = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                b = Block(row, n_buckets)
                gone = _removed(b, *(_told(*(row[f"{p}_{c}"] for c in ("buckets", "keys", "docs"))) for p in "tw"))
                edges = zip(b.parse.bounds[:-1], b.parse.bounds[1:], b.null)
                found = zip(*(made(b.parse.buffer[s:e], gone[s:e], null) for s, e, null in edges))
                rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks().to_batches()[0]
                columns = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(found, fields)]
                yield pa.RecordBatch.from_arrays([*rest.columns, *columns], [*rest.schema.names, *(n for n, _ in fields)])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(docs[c] for c in keep)).schema]
    return solved.mapInArrow(frugal(batches), ", ".join([*kept, schema]))


def _digest(data: np.ndarray, gone: np.ndarray, null: bool) -> tuple:
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]) if len(gone) else 0
    return len(data), int(np.count_nonzero(gone)), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()


def repeated(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text).

    Removed is each byte covered by a WINDOW-byte string that also starts in a document with a smaller doc_id.
    Null texts are empty; null ids come after all others and never make each other smaller; rows that repeat an
    id are one document, none smaller than another.
    """
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _applied(docs.select("doc_id", "text"), ["doc_id"], schema, _digest, block_bytes, bucket_bytes)


def _rest(data: np.ndarray, gone: np.ndarray, null: bool) -> tuple:
    return (None if null else data[~gone].tobytes().decode("utf-8", "ignore"),)


def replaced(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows with all their columns, each text without its removed bytes; of a character cut apart nothing stays."""
    keep = [c for c in docs.columns if c != "text"]
    return _applied(docs, keep, "text string", _rest, block_bytes, bucket_bytes).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to smaller ones, and the digest of the rest."""
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Token ids in files: one wavelet matrix per shard, with rank and select on compressed bit-planes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, parts_for, shared_path, ship, stage, text_bytes
from .word_cache import byte_level

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
KEPT_WORDS = 650_000
SHARD_TEXT_BYTES = 16 << 20
SHARD_TOKENS = 8 << 20

# File format, little-endian. Head: magic, documents, levels, tokens, bytes of the packed document table.
# Then the table (zstd: doc_id int64 each, absent-flag uint8 each, tokens uint32 each), then for each
# bit-plane from the highest bit: number of zeros, blocks, for each block its end in the data and the ones
# before it, and the blocks (zstd) of BLOCK_BITS bits. Bytes after that are padding.
_MAGIC = b"WVLTMX01"
_HEAD = struct.Struct("<8sIIQQ")
BLOCK_BITS = 1 << 19


def write_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of the ids of some documents, one document after the other."""
    pack = zstandard.ZstdCompressor(level=1).compress
    table = pack(
        np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + np.array([d is None for d in doc_ids], np.uint8).tobytes()
        + np.array(lengths, "<u4").tobytes()
    )
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    out = [_HEAD.pack(_MAGIC, len(doc_ids), levels, len(ids), len(table)), table]
    x = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    for level in range(levels - 1, -1, -1):
        ones = ((x >> x.dtype.type(level)) & x.dtype.type(1)).astype(bool)
        blocks, ends, before, n_before, at = [], [], [], 0, 0
        for i in range(0, len(x), BLOCK_BITS):
            part = ones[i : i + BLOCK_BITS]
            blocks.append(pack(np.packbits(part, bitorder="little").tobytes()))
            before.append(n_before)
            n_before += int(np.count_nonzero(part))
            at += len(blocks[-1])
            ends.append(at)
        out.append(struct.pack("<QQ", len(x) - n_before, len(blocks)))
        out += [np.array(ends, "<u8").tobytes(), np.array(before, "<u8").tobytes(), *blocks]
        x = np.concatenate([np.compress(~ones, x), np.compress(ones, x)])
    return b"".join(out)


class Shard:
    """A shard's file: documents, and access, rank, select and count on its tokens without unpacking it whole."""

    def __init__(self, data: bytes):
        magic, n_docs, self._levels, self.n_tokens, size = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        table = zstandard.ZstdDecompressor().decompress(data[_HEAD.size : _HEAD.size + size], n_docs * 13)
        self.doc_ids = np.frombuffer(table, "<i8", n_docs)
        self.absent = np.frombuffer(table, np.uint8, n_docs, n_docs * 8).astype(bool)
        self.lengths = np.frombuffer(table, "<u4", n_docs, n_docs * 9)
        self._planes, at = [], _HEAD.size + size
        for _ in range(self._levels):
            zeros, n_blocks = struct.unpack_from("<QQ", data, at)
            ends = np.frombuffer(data, "<u8", n_blocks, at + 16).astype(np.int64)
            before = np.frombuffer(data, "<u8", n_blocks, at + 16 + 8 * n_blocks).astype(np.int64)
            start = at + 16 + 16 * n_blocks
            self._planes.append((zeros, ends, before, start))
            at = start + (int(ends[-1]) if n_blocks else 0)
        self._data = memoryview(data)
        self._block = lru_cache(maxsize=64)(self._read_block)

    def _read_block(self, plane: int, k: int) -> np.ndarray:
        _, ends, _, start = self._planes[plane]
        packed = self._data[start + (int(ends[k - 1]) if k else 0) : start + int(ends[k])]
        bits = zstandard.ZstdDecompressor().decompress(packed, BLOCK_BITS // 8)
        n = min(BLOCK_BITS, self.n_tokens - k * BLOCK_BITS)
        return np.unpackbits(np.frombuffer(bits, np.uint8), count=n, bitorder="little").astype(bool)

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, BLOCK_BITS)
        _, ends, before, _ = self._planes[plane]
        if k == len(ends):
            return self.n_tokens - self._planes[plane][0]
        return int(before[k]) + int(np.count_nonzero(self._block(plane, k)[:rest]))

    def access(self, i: int) -> int:
        """The token at place i."""
        token = 0
        for plane in range(self._levels):
            bit = bool(self._block(plane, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._ones(plane, i)
            i = self._planes[plane][0] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences among the first i places end up below the last plane."""
        low, high = 0, i
        for plane in range(self._levels):
            ones = self._ones(plane, low), self._ones(plane, high)
            if token >> (self._levels - 1 - plane) & 1:
                low, high = (self._planes[plane][0] + o for o in ones)
            else:
                low, high = low - ones[0], high - ones[1]
        return low, high

    def rank(self, token: int, i: int) -> int:
        """How often the token occurs in the first i places."""
        if token >> self._levels:
            return 0
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n_tokens)

    def _place_of(self, plane: int, bit: bool, nth: int) -> int:
        """Where the nth (from 0) such bit of a plane stands."""
        _, _, before, _ = self._planes[plane]
        held = before if bit else np.arange(len(before)) * BLOCK_BITS - before
        k = int(np.searchsorted(held, nth, "right")) - 1
        return k * BLOCK_BITS + int(np.flatnonzero(self._block(plane, k) == bit)[nth - int(held[k])])

    def select(self, token: int, nth: int) -> int:
        """The place of the token's nth occurrence, from 0."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        i = self._range(token, self.n_tokens)[0] + nth
        for plane in range(self._levels - 1, -1, -1):
            bit = bool(token >> (self._levels - 1 - plane) & 1)
            i = self._place_of(plane, bit, i - self._planes[plane][0] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order, built up from the lowest plane."""
        kind = np.uint16 if self._levels <= 16 else np.uint32
        x = np.zeros(self.n_tokens, kind)
        for plane in range(self._levels - 1, -1, -1):
            blocks = [self._read_block(plane, k) for k in range(len(self._planes[plane][1]))]
            ones = np.concatenate(blocks) if blocks else np.zeros(0, bool)
            zeros = self._planes[plane][0]
            up = np.empty_like(x)
            up[np.flatnonzero(~ones)] = x[:zeros]
            up[np.flatnonzero(ones)] = x[zeros:] | kind(1 << (self._levels - 1 - plane))
            x = up
        return x.astype(np.uint32)


def write_store(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text), end each document with ``end_id``, and write shard files under ``path``.

    Rows are dealt out by ascending doc_id (null first; rows of one id by their text), so files in the
    order of their names hold the documents in order. Each file is one task's row, written and committed by
    Spark; a lost task is written anew.
    """
    ship(docs.sparkSession)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = byte_level(tokenizer, KEPT_WORDS).encode, np.array([end_id], "<u4").tobytes()
        ids, doc_ids, lengths, n = [], [], [], 0
        for frame in frames:
            for doc_id, absent, text in zip(frame["doc_id"], frame["absent"], frame["text"]):
                found = (encode(text) if text else b"") + end
                size = len(found) // 4
                if n and n + size > SHARD_TOKENS:
                    yield pd.DataFrame({"value": [write_shard(np.frombuffer(b"".join(ids), "<u4"), doc_ids, lengths)]})
                    ids, doc_ids, lengths, n = [], [], [], 0
                ids.append(found)
                doc_ids.append(None if absent else int(doc_id))
                lengths.append(size)
                n += size
        if doc_ids:
            yield pd.DataFrame({"value": [write_shard(np.frombuffer(b"".join(ids), "<u4"), doc_ids, lengths)]})

    n_parts = parts_for(text_bytes(docs), SHARD_TEXT_BYTES)
    keys = (F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "text").repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("absent"), F.coalesce("text", F.lit("")).alias("text"))
    # The text writer puts a row's bytes into the file as they are, and a line break, which is padding.
    rows.mapInPandas(frugal(batches), "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone; start counts the ids of all documents before."""
    ship(spark)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                shard = Shard(bytes(content))
                data = shard.tokens().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths, dtype=np.int64)
                starts = ends - shard.lengths
                yield pd.DataFrame({
                    "path": path,
                    "doc_id": pd.array(np.where(shard.absent, 0, shard.doc_ids), "Int64").copy(),
                    "absent": shard.absent,
                    "inside": starts,
                    "n_tokens": shard.lengths.astype(np.int64),
                    "ids_crc32": [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(starts, ends)],
                })

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = stage(
        files.mapInPandas(frugal(batches), "path string, doc_id long, absent boolean, inside long, n_tokens long, ids_crc32 long")
        .select("path", F.when(~F.col("absent"), F.col("doc_id")).alias("doc_id"), "inside", "n_tokens", "ids_crc32"),
        "tokens",
    )
    # One row per file, in the order of its task and of its number within the task.
    number = [F.regexp_extract("path", "part-(\\d+)-.*-c(\\d+)", k).cast("long") for k in (1, 2)]
    before = Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("path").agg(F.sum("n_tokens").alias("n")).select(
        "path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    return rows.join(files, "path").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids into shard files, read them back, and give each document's place and checksum."""
    path = shared_path(spark, "shards")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path)

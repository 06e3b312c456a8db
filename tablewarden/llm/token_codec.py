"""Byte-level BPE with the tiktoken library: ranks from a local file, exact on texts of any length."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, ship

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_CHARS = 1 << 16
# The library's pattern engine recurses over white space; longer runs go by another way.
LONGEST_BLANK = 256

# Before a single space that a visible character follows, a new match always begins: no match but one
# of white space ends in a space, and those leave the last space to what follows.
_SAFE = re.compile(r" (?=\S)")
_BLANK = re.compile(r"\s{%d}" % LONGEST_BLANK)


class Codec:
    """Encodes as the library does with the given ranks and pattern and no special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._pattern = regex.compile(pattern)

    @staticmethod
    def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
        """The text cut at safe boundaries, each piece about ``size`` long; without one it stays whole."""
        start = 0
        while len(text) - start > size:
            cut = _SAFE.search(text, start + size)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= PIECE_CHARS and not _BLANK.search(text):
            return self._library.encode_to_numpy(text, disallowed_special=())
        return np.concatenate([self._encode_piece(p) for p in self.pieces(text)])

    def _encode_piece(self, piece: str) -> np.ndarray:
        if not _BLANK.search(piece):
            return self._library.encode_to_numpy(piece, disallowed_special=())
        found: list[int] = []
        for match in self._pattern.finditer(piece):
            found += self._library._encode_single_piece(match.group())
        return np.array(found, np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, also where they are no whole characters."""
        return self._library.decode_bytes(ids.tolist())


@lru_cache(maxsize=4)
def codec(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One for each Python worker."""
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids binary): the token ids of each whole text as little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for frame in frames:
            ids = [c.encode(t).astype("<u4").tobytes() if t else b"" for t in frame["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([frame["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(batches), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, decoded binary): the raw bytes that the ids stand for."""
    ship(encoded.sparkSession)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for frame in frames:
            texts = [c.decode_bytes(np.frombuffer(ids, "<u4")) for ids in frame["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(frugal(batches), "doc_id long, ids binary, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and digest of the decoded bytes; null text is empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decode(encode(docs)).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


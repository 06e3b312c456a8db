"""Shared helpers: durable intermediate tables, byte slices of bounded size, hashing in numpy."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that a task turns into numpy arrays at once.
SLICE_BYTES = 2 << 20


# Rows of an Arrow batch; Spark's own default suits short rows, not texts.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it wherever they run,
    and have them get BATCH_ROWS rows at a time unless the session asks for another number than the default.

    Needed before a function is handed to Spark, which notes then what its workers get.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        if package.is_dir():
            name = f"{tempfile.mkdtemp(prefix='ship-')}/{package.name}-{context.applicationId}"
            context.addPyFile(shutil.make_archive(name, "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)


def frugal(batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function over a partition's batches, giving freed memory back to the system when it ends: Python
    workers live on for the next tasks, also those of other operators."""

    @wraps(batches)
    def run(frames: Iterator) -> Iterator:
        try:
            yield from batches(frames)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only a local session without it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once and go on from the written rows, so that a lost executor costs no recomputation,
    row positions stay as they are, and Spark knows the size of what it joins."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    blocks = getattr(_PASSING, "blocks", [])
    if blocks:
        blocks[-1].append((name, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


_PASSING = threading.local()


@contextmanager
def passing(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Remove the tables staged within, but for those named, once the block is done: what goes on from it may read
    only these, and they are removed by a block around this one, if there is one. After a failure all stay."""
    blocks = _PASSING.blocks = getattr(_PASSING, "blocks", [])
    blocks.append([])
    done = False
    try:
        yield
        done = True
    finally:
        made = blocks.pop()
        if done:
            if blocks:
                blocks[-1].extend(m for m in made if m[0] in kept)
            for name, path in made:
                if name not in kept:
                    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def parts_for(total: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-total // per_part))


def slices(sizes: Sequence[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``limit`` at most; a larger row comes alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encoded(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def joined(parts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts one after the other, and where each begins (with the end as last entry)."""
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return np.frombuffer(b"".join(parts), np.uint8), bounds


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(buffer: np.ndarray) -> np.ndarray:
    """h[i] covers the first i bytes; any stretch's hash follows from two of them (``stretch_hash``)."""
    up, _ = _powers(len(buffer) + 1)
    h = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=h[1:])
    return h


def stretch_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, end), the same wherever they stand."""
    _, down = _powers(len(h))
    length = (end - start).astype(np.uint64)
    return mix64((h[end] - h[start]) * down[start] + length * np.uint64(0xD6E8FEB86659FD93))


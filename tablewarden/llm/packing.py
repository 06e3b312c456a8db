"""Best-fit packing of token pieces into sequences by a configuration linear program over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, ship, stage
from .word_cache import word_level

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 0
CAPACITY = 2048
ROUNDS = 300


def best_pattern(weight: np.ndarray) -> np.ndarray:
    """How many of each length make up the heaviest pattern within the capacity (len(weight) - 1), by dynamic
    programming over the filled size; weight[l] is what length l counts."""
    capacity = len(weight) - 1
    lengths = np.flatnonzero(weight > 0)
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for size in range(1, capacity + 1):
        fit = lengths[: np.searchsorted(lengths, size, "right")]
        best[size] = best[size - 1]
        if len(fit):
            value = weight[fit] + best[size - fit]
            k = int(value.argmax())
            if value[k] > best[size]:
                best[size], choice[size] = value[k], fit[k]
    pattern, size = np.zeros(capacity + 1, np.int64), capacity
    while size > 0:
        if choice[size]:
            pattern[choice[size]] += 1
            size -= choice[size]
        else:
            size -= 1
    return pattern


@dataclass
class Plan:
    """Patterns with their numbers of copies; a pattern is a list of (length, how many)."""

    patterns: list[tuple[list[tuple[int, int]], int]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def slots(self) -> pd.DataFrame:
        """For each length, runs of ranks: from ``rank`` on, they go to ``sequence``, ``sequence`` + 1 ... at ``offset``."""
        rows, next_rank, base = [], {}, 0
        for pattern, copies in self.patterns:
            offset = 0
            for length, times in pattern:
                for _ in range(times):
                    rank = next_rank.get(length, 0)
                    rows.append((length, rank, base, offset))
                    next_rank[length] = rank + copies
                    offset += length
            base += copies
        return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).astype("int64")


def _fit(counts: np.ndarray, capacity: int, begun: list[tuple[list[tuple[int, int]], int]] = ()) -> Plan:
    """Best-fit decreasing on a histogram, into the begun patterns first; bins of equal content are handled together."""
    open_bins: dict[int, list[list]] = {}  # room left -> [content, copies]
    room = np.zeros(capacity + 1, bool)

    def add(rest: int, content: list, copies: int) -> None:
        open_bins.setdefault(rest, []).append([content, copies])
        room[rest] = rest > 0

    for content, copies in begun:
        add(capacity - sum(n * k for n, k in content), content, copies)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                r, each = int(fits[0]) + length, 1
                content, copies = open_bins[r].pop()
                room[r] = bool(open_bins[r])
                used = min(copies, left)
                if used < copies:
                    add(r, content, copies - used)
            else:
                r, content, each = capacity, [], min(capacity // length, left)
                used = left // each
            left -= used * each
            add(r - length * each, [*content, (length, each)], used)
    return Plan([(c, n) for bins in open_bins.values() for c, n in bins])


def _rounded(shares: list[tuple[np.ndarray, float]], counts: np.ndarray, scale: float) -> Plan:
    """Whole copies of the scaled shares as far as pieces last, then the rest best-fit into them and new sequences."""
    left, begun = counts.astype(np.int64).copy(), []
    for pattern, share in shares:
        copies = int(share * scale)
        while copies:
            part = np.minimum(pattern, left)
            used = part > 0
            if not used.any():
                break
            n = int(min(copies, (left[used] // part[used]).min()))
            left -= n * part
            begun.append(([(int(k), int(part[k])) for k in np.flatnonzero(used)[::-1]], n))
            copies -= n
    return _fit(left, len(counts) - 1, begun)


def solve(counts: np.ndarray, rounds: int = ROUNDS) -> Plan:
    """Pack ``counts[l]`` pieces of each length l into few sequences of len(counts) - 1.

    The covering program over all patterns is solved by multiplicative weights: each round prices the best
    pattern under the lengths' present weights and takes a share of it; covered lengths lose weight. The
    shares are rounded, at the scale that covers every length and at the one that covers none twice, and
    the better result stays; so does plain best-fit, if it needs no more sequences.
    """
    capacity = len(counts) - 1
    plans = [_fit(counts, capacity)]
    need, present = counts.astype(np.float64), counts > 0
    if plans[0].sequences > -(-int((counts * np.arange(capacity + 1)).sum()) // capacity):
        weight = np.where(present, np.arange(capacity + 1) / capacity, 0.0)
        shares: dict[bytes, list] = {}
        covered = np.zeros(capacity + 1)
        for k in range(rounds):
            pattern = best_pattern(weight)
            used = pattern > 0
            amount = (need[used] / pattern[used]).min() / (2 + k / 25)
            shares.setdefault(pattern.tobytes(), [pattern, 0.0])[1] += amount
            covered += amount * pattern
            weight[used] *= np.exp(-amount * pattern[used] / need[used])
        ordered = sorted(map(tuple, shares.values()), key=lambda s: -s[1])
        reached = covered[present] / need[present]
        plans += [_rounded(ordered, counts, 1 / r) for r in (reached.min(), reached.max()) if r > 0]
    return min(plans, key=lambda p: p.sequences)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
_PIECE_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): each document's ids and ``end_id``, cut at the capacity.

    ``task`` and ``nth`` number the pieces of one length within the task that made them.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_level(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        task, met = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for frame in frames:
            rows = []
            for at, text in enumerate(frame["text"].to_pylist()):
                ids = (encode(text) if text else b"") + end
                for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[i : i + 4 * capacity]
                    length = len(part) // 4
                    rows.append((at, k, i // 4, length, zlib.crc32(part), task, int(met[length])))
                    met[length] += 1
            at, *columns = zip(*rows)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([frame["doc_id"].take(pa.array(at)), *made], _PIECE_NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(batches), _PIECE)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of ``docs`` (doc_id, text).

    Null text is empty and takes one token, the end id. What the driver gets is one count per length; the
    plan it makes from them has a bounded number of slots whatever the number of pieces.
    """
    ship(docs.sparkSession)
    made = stage(pieces(docs, tokenizer, end_id, capacity), "pieces")
    per_task = stage(made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    slots = solve(counts).slots().sort_values(["length", "rank"])
    table = {n: g for n, g in slots.groupby("length")}
    runs = {int(n): tuple(g[c].to_numpy() for c in ("rank", "sequence", "offset")) for n, g in table.items()}
    shared = made.sparkSession.sparkContext.broadcast(runs)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = stage(per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "piece-firsts")
    ranked = made.join(firsts, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank")
    )

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            sequence, offset = np.zeros(frame.num_rows, np.int64), np.zeros(frame.num_rows, np.int64)
            lengths, ranks = (np.asarray(frame[c]) for c in ("length", "rank"))
            order = np.argsort(lengths, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(group):
                    first, base, at = shared.value[int(lengths[group[0]])]
                    k = np.searchsorted(first, ranks[group], "right") - 1
                    sequence[group], offset[group] = base[k] + ranks[group] - first[k], at[k]
            yield pa.RecordBatch.from_arrays(
                [*frame.columns[:5], pa.array(sequence), pa.array(offset)],
                [*frame.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        frugal(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Exact top-k by inner product: segment statistics at several resolutions rule out most candidates first.

With a vector cut into segments, each with its mean m and deviation s over its n components, the inner
product is at most the sum of n * (m * m' + s * s'). One segment gives the coarsest bound, more segments give
finer ones; whatever no bound rules out gets its exact product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, ship, stage

SCALE = 256
K = 5
QUERY_EVERY = 50
RESOLUTIONS = (1, 4, 16)
BLOCK_ROWS = 2000
QUERY_ROWS = 1000
BLOCKS_PER_TASK = 4


def quantised(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of the usable vectors and their places; null or non-finite components make a vector
    unusable, shorter vectors count as filled up with zeros. Values too large for exact products stay exact."""
    rows, places = [], []
    for place, v in enumerate(vectors):
        if v is None:
            continue
        v = np.asarray([np.nan if x is None else x for x in v] if None in list(v) else v, np.float64)
        if np.isfinite(v).all():
            rows.append(np.floor(v * SCALE))
            places.append(place)
    width = max((len(v) for v in rows), default=0)
    out = np.zeros((len(rows), width))
    for r, v in zip(out, rows):
        r[: len(v)] = v
    return out, np.array(places, np.int64)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(n) * mean and sqrt(n) * deviation of each segment: their products bound inner products."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    parts = []
    for a, b in zip(edges, edges[1:]):
        if b > a:
            mean = x[:, a:b].mean(axis=1)
            parts += [np.sqrt(b - a) * mean, np.sqrt(b - a) * x[:, a:b].std(axis=1)]
    return np.stack(parts, axis=1) if parts else np.zeros((len(x), 0))


class Best:
    """The k best (score, then smaller id and row) found so far for each query of a block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query = self.row = self.id = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, row: np.ndarray, ident: np.ndarray, score: np.ndarray) -> None:
        query, row, ident, score = (
            np.concatenate(p) for p in ((self.query, query), (self.row, row), (self.id, ident), (self.score, score))
        )
        order = np.lexsort((row, ident, ~score, query))  # ~score falls as score rises, without overflow
        query, row, ident, score = (a[order] for a in (query, row, ident, score))
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = rank < self.k
        self.query, self.row, self.id, self.score = query[keep], row[keep], ident[keep], score[keep]
        full = rank == self.k - 1
        self.least[query[full]] = score[full]


def survivors(q: np.ndarray, x: np.ndarray, least: np.ndarray, resolutions=RESOLUTIONS) -> np.ndarray:
    """Which pairs no bound rules out, from the coarsest resolution to the finest."""
    floor = (least - 1e-9 * np.abs(least) - 1e-3)[:, None]  # rounding must not rule out a tie
    left = np.ones((len(q), len(x)), bool)
    for segments in (s for s in resolutions if s <= max(1, q.shape[1])):
        u, v = statistics(q, segments), statistics(x, segments)
        if left.mean() > 0.1:
            left &= u @ v.T >= floor
        else:
            qi, xi = np.nonzero(left)
            left[qi, xi] = np.einsum("ij,ij->i", u[qi], v[xi]) >= floor[qi, 0]
    return left


def search_block(
    best: Best, q: np.ndarray, q_row: np.ndarray, x: np.ndarray, x_row: np.ndarray, x_id: np.ndarray, resolutions=RESOLUTIONS
) -> int:
    """Add what a block of candidates holds to ``best``; how many exact products it took."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(a, ((0, 0), (0, width - a.shape[1]))).astype(np.float64) for a in (q, x))
    order = np.lexsort((x_row, x_id))
    x, x_row, x_id = x[order], x_row[order], x_id[order]
    left = survivors(q, x, best.least, resolutions)
    _, own_q, own_x = np.intersect1d(q_row, x_row, assume_unique=True, return_indices=True)
    left[own_q, own_x] = False
    qi, xi = np.nonzero(left)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, width)
    if most * len(x) >= 2.0**52:
        # Beyond what a double holds exactly; sums beyond a long are held at its ends.
        exact = [sum(int(a) * int(b) for a, b in zip(q[i], x[j])) for i, j in zip(qi, xi)]
        best.add(qi, x_row[xi], x_id[xi], np.array([max(-(2**63), min(2**63 - 1, e)) for e in exact], np.int64))
        return len(qi)
    # One number orders a pair by its score and then by the candidate's place, which is that of its id.
    key = np.full(left.shape, -np.inf)
    if len(qi) > 0.2 * left.size:
        score = q @ x.T
        key[left] = (score * len(x) + np.arange(len(x) - 1, -1, -1))[left]
    else:
        for i in range(0, len(qi), 65536):
            a, b = qi[i : i + 65536], xi[i : i + 65536]
            key[a, b] = np.einsum("ij,ij->i", q[a], x[b]) * len(x) + (len(x) - 1 - b)
    k = min(best.k, len(x))
    top = np.argpartition(-key, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(key, top, axis=1)
    query, at = np.nonzero(np.isfinite(value))
    found = top[query, at]
    best.add(query, x_row[found], x_id[found], np.floor(value[query, at] / len(x)).astype(np.int64))
    return len(qi)


_BLOCK = "block long, ids binary, rows binary, width int, data binary"


def _packed(size: int):
    """Blocks of usable vectors; single precision where it holds the integers exactly."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), size):
                part = frame.iloc[i : i + size]
                x, places = quantised(part["embedding"].tolist())
                if len(x):
                    ids, rows = (part[c].to_numpy(np.int64)[places] for c in ("vec_id", "uid"))
                    small = x.astype(np.float32) if np.abs(x).max(initial=0) < 1 << 24 else x
                    block = [int(rows[0]), ids.tobytes(), rows.tobytes(), x.shape[1], small.tobytes()]
                    yield pd.DataFrame([block], columns=["block", "ids", "rows", "width", "data"])

    return batches


def _unpacked(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
    size = len(row["data"]) // max(1, len(ids) * row["width"])
    kind = np.float32 if size == 4 else np.float64
    return ids, rows, np.frombuffer(row["data"], kind).reshape(len(ids), row["width"])


def _search(k: int):
    def group(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, asked in queries.iterrows():
            q_id, q_row, q = _unpacked(asked)
            best = Best(len(q), k)
            for _, block in candidates.iterrows():
                x_id, x_row, x = _unpacked(block)
                search_block(best, q, q_row, x, x_row, x_id)
            found.append(pd.DataFrame({
                "q_row": q_row[best.query], "query_id": q_id[best.query],
                "row": best.row, "vec_id": best.id, "score": best.score,
            }))
        return pd.concat(found) if found else pd.DataFrame(columns=["q_row", "query_id", "row", "vec_id", "score"])

    return group


def top_k(vectors: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is a multiple of ``every`` the k best other rows.

    Ties go to the smaller vec_id. Rows with a null id take no part, nor do those with unusable vectors; a
    row that repeats an id is another row. Each block of queries meets the candidates in groups of
    BLOCKS_PER_TASK blocks; a task keeps k rows for each of its queries, whatever it reads.
    """
    ship(vectors.sparkSession)
    rows = stage(
        vectors.where("vec_id IS NOT NULL").select(
            F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")
        ),
        "vectors",
    )
    blocks = stage(rows.mapInPandas(frugal(_packed(BLOCK_ROWS)), _BLOCK), "candidates")
    asked = rows.where(F.col("vec_id") % every == 0)
    # Queries are spread over the files; dealing them out first makes full blocks.
    asked = stage(asked.repartition(max(1, -(-asked.count() // QUERY_ROWS)), "uid").mapInPandas(frugal(_packed(QUERY_ROWS)), _BLOCK), "queries")
    n_parts = max(1, -(-blocks.count() // BLOCKS_PER_TASK))
    parts = F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))
    numbers = asked.select(F.col("block").alias("q"))
    spread = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(n_parts)))
    # Each candidate block goes once to each block of queries: a stated query set, in blocks.
    held = numbers.agg(F.sort_array(F.collect_list("q")).alias("qs")).first()["qs"]
    candidates = spread.withColumn("q", F.explode(F.lit(held).cast("array<long>")))
    found = (
        asked.withColumn("q", F.col("block")).withColumn("part", F.explode(parts)).groupBy("q", "part")
        .cogroup(candidates.groupBy("q", "part"))
        .applyInPandas(_search(k), "q_row long, query_id long, row long, vec_id long, score long")
    )
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every fiftieth."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
    SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)])::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

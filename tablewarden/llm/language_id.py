"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, ship, slices

UNDETERMINED = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MODEL_BYTES = 256 << 20
# Characters that a worker turns into n-grams at once: about a hundred bytes of arrays for each.
SLICE_CHARS = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed n-grams of the texts as a sparse matrix whose entries are all one: buckets, where each row
    begins, and each row's number of letters. Upper case counts as lower, every run of non-letters as a space."""
    points = np.frombuffer("".join(" " + t.lower() + " " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t.lower()) + 2 for t in texts])
    letter = _letters()[points]
    points = np.where(letter, points, np.uint32(32))
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    points, row = points[keep], row[keep]
    n_letters = np.bincount(row, weights=letter[keep], minlength=len(texts)).astype(np.int64)
    h = np.zeros(len(points), np.uint32)
    buckets, rows = [], []
    for order in range(1, max(ORDERS) + 1):
        if len(points) < order:
            break
        size = len(points) - order + 1
        h = h[:size] * np.uint32(0x01000193) + (points[order - 1 :] + np.uint32(order)) * np.uint32(0x9E3779B1)
        if order in ORDERS:
            inside = row[order - 1 :] == row[:size]
            buckets.append(((h[inside] * np.uint32(0x85EBCA77)) >> np.uint32(16)).astype(np.int32))
            rows.append(row[:size][inside].astype(np.int32))
    return np.concatenate(buckets), np.concatenate(rows), n_letters


def _count_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for frame in frames:
        for lang, group in frame.groupby("lang", sort=False):
            held = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            if held.nbytes * len(counts) > MODEL_BYTES:
                raise ValueError("more languages than the model may hold")
            docs[lang] = docs.get(lang, 0) + len(group)
            texts = group["text"].tolist()
            for i, j in slices([len(t) for t in texts], SLICE_CHARS):
                held += np.bincount(gram_rows(texts[i:j])[0], minlength=BUCKETS)
    for lang, held in counts.items():
        used = np.flatnonzero(held)
        yield pd.DataFrame(
            {"lang": lang, "bucket": np.append(used, -1).astype(np.int32), "n": np.append(held[used], docs[lang])}
        )


class Model:
    """Languages with a matrix of log-probabilities, languages by buckets, and the log of their shares."""

    def __init__(self, langs: list[str], log_p: np.ndarray, prior: np.ndarray):
        self.langs, self.log_p, self.prior = langs, log_p, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        clean = [t if isinstance(t, str) else "" for t in texts]
        for i, j in slices([len(t) for t in clean], SLICE_CHARS):
            buckets, rows, n_letters = gram_rows(clean[i:j])
            if not self.langs:
                names += [UNDETERMINED] * (j - i)
                continue
            total = np.stack([np.bincount(rows, weights=p[buckets], minlength=j - i) for p in self.log_p])
            total += self.prior[:, None]
            best = total.argmax(axis=0)
            share = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
            names += [self.langs[b] if n else UNDETERMINED for b, n in zip(best, n_letters)]
            scores[i:j] = np.where(n_letters > 0, share, 0.0)
        return names, scores


def train(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """Count the n-grams of every row with a language and a text, and fit the model.

    The counts are summed on the executors; what reaches the driver is one number per language and
    bucket, whatever the number of documents. Too many languages for ``MODEL_BYTES`` are refused.
    """
    ship(docs.sparkSession)
    counted = (
        docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInPandas(frugal(_count_batches), "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .toPandas()
    )
    langs = sorted(counted["lang"].unique())
    if len(langs) * BUCKETS * 8 > MODEL_BYTES:
        raise ValueError("more languages than the model may hold")
    at = counted["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy(np.int64)
    bucket, n = counted["bucket"].to_numpy(np.int64), counted["n"].to_numpy(np.float64)
    matrix = np.full((len(langs), BUCKETS), smoothing)
    grams = bucket >= 0
    np.add.at(matrix, (at[grams], bucket[grams]), n[grams])
    share = np.zeros(len(langs))
    share[at[~grams]] = n[~grams]
    log_p = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    return Model(langs, log_p, np.log(share / share.sum()) if langs else share)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Documents that are never learned from: crc32 of the id's digits is a multiple of ``folds``, or no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row: the likeliest language by the text alone and its posterior
    probability. Null texts and texts without a letter get ``und`` and 0; of equals the first name wins."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            names, scores = shared.value.predict(frame["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [frame["doc_id"], pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(frugal(batches), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text has a letter and a language of at least ``least`` probability."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            names, scores = shared.value.predict(frame["text"].to_pylist())
            yield frame.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(frugal(batches), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from those that are not held out.

    Repeated rows each get a row. An empty table gives no rows; without any learned language all are ``und``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

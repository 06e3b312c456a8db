"""Quality rules judged by host: rule failures are summed by host, their rates shrunk, and the verdicts joined back."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, joined, mix64, prefix_hash, ship, slices, stage, stretch_hash

WINDOW = 3
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_BLANK = re.compile(b"[" + BLANKS + b"]")
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS, np.uint8))
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
# A byte that begins a code point: not one that continues it.
_BEGINS = (np.arange(256) & 0xC0) != 0x80
# Text that becomes arrays at once, up to a following blank.
PIECE_BYTES = 2 << 20

# A host whose shrunken share of failing documents is above the limit of any rule is not trusted: of its documents only
# those that fail no rule stay.
LIMITS = {"short": 0.5, "repetitive": 0.5, "symbols": 0.5, "dup_lines": 0.5, "word_length": 0.5}


def rule_failures() -> dict[str, Column]:
    """Each rule on the counted columns: whether the document fails it. The first two are the base rules."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "short": words < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * words,
        "symbols": 10 * F.col("n_symbols") > words,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (chars < 3 * words) | (chars > 10 * words),
    }


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts that end after a blank, so that no word is cut; a longer word stays whole."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, min(at + PIECE_BYTES, len(text)) - 1)
        end = blank.end() if blank else len(text)
        yield text[at:end]
        at = end


def _words(buffer: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of the joined texts begin and end, and their hashes; no word reaches over a bound."""
    inside = ~_IS_BLANK[buffer]
    edge = np.zeros(len(buffer) + 1, bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, stretch_hash(hashes, start, end)


def repeated_words(owner: np.ndarray, hashes: np.ndarray, word) -> np.ndarray:
    """Of each owner, its words in windows of WINDOW words that stand at two or more places of its text.

    ``owner`` (ascending) and ``hashes`` are given word by word, ``word(k)`` is word k itself. Windows that are alone
    by their hash are alone; the others are compared by their words.
    """
    n = int(owner[-1]) + 1 if len(owner) else 0
    if len(owner) < WINDOW:
        return np.zeros(n, np.int64)
    places = len(owner) - WINDOW + 1
    mixed = owner[:places].astype(np.uint64)
    for k in range(WINDOW):
        mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + places])
    whole = np.flatnonzero(owner[:places] == owner[WINDOW - 1 :])
    order = whole[np.argsort(mixed[whole], kind="stable")]
    same = mixed[order][1:] == mixed[order][:-1]
    several = np.zeros(len(order), bool)
    several[1:] |= same
    several[:-1] |= same
    found = np.sort(order[several])
    windows = [(owner[i], *(word(k) for k in range(i, i + WINDOW))) for i in found.tolist()]
    count = Counter(windows)
    covered = np.zeros(len(owner), bool)
    for i, window in zip(found.tolist(), windows):
        if count[window] > 1:
            covered[i : i + WINDOW] = True
    return np.bincount(owner[covered], minlength=n)


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them that equal an earlier one."""
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return len(lines), len(lines) - len(set(lines))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of COUNTS for each text. Short texts are counted many at once, a long one in pieces."""
    out = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    for i, j in slices([len(t) for t in texts], PIECE_BYTES):
        held = [(k, part) for k in range(i, j) for part in _pieces(texts[k])]
        owners, hashes, spans = [], [], []
        for a, b in slices([len(part) for _, part in held], PIECE_BYTES):
            buffer, bounds = joined([part for _, part in held[a:b]])
            if not len(buffer):
                continue
            row = np.array([k for k, _ in held[a:b]])
            start, end, found = _words(buffer, prefix_hash(buffer), bounds)
            owner = row[np.searchsorted(bounds, start, "right") - 1]
            of_byte = np.repeat(row, np.diff(bounds))
            out["word_chars"] += np.bincount(of_byte[_BEGINS[buffer] & ~_IS_BLANK[buffer]], minlength=len(texts))
            out["n_symbols"] += np.bincount(of_byte[_IS_SYMBOL[buffer]], minlength=len(texts))
            owners.append(owner - i)
            hashes.append(found)
            spans.append((buffer.tobytes(), start, end))
        for k in range(i, j):
            out["n_lines"][k], out["n_dup_lines"][k] = _dup_lines(texts[k])
        if owners:
            first = np.cumsum([0, *map(len, owners)])

            def word(k: int) -> bytes:
                at = int(np.searchsorted(first, k, "right")) - 1
                data, start, end = spans[at]
                return data[start[k - first[at]] : end[k - first[at]]]

            owner = np.concatenate(owners)
            out["n_words"][i:j] = np.bincount(owner, minlength=j - i)
            repeats = repeated_words(owner, np.concatenate(hashes), word)
            out["n_repeat_words"][i : i + len(repeats)] = repeats
    return out


def _count_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        texts = [b"" if t is None else t for t in frame["text"].cast(pa.binary()).to_pylist()]
        found = counts_of(texts)
        kept = [c for c in frame.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(frame[c] for c in kept), *(pa.array(found[c]) for c in COUNTS)], [*kept, *COUNTS])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, host, the columns of COUNTS) for each row of ``docs`` (doc_id, host, text)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("host").cast("string").alias("host"), "text")
    return rows.mapInArrow(frugal(_count_batches), "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))


def host_rates(failed: DataFrame, rules: list[str]) -> DataFrame:
    """(host, n, and for each rule ``k_``, its failing documents, and ``rate_``, their shrunken share) for each host.

    ``failed``: host and a boolean column a rule; null is a host of its own. The beta prior of a rule comes from all
    hosts by the method of moments: its mean is the share p of failing documents, and the intraclass correlation
    rho = (S / (p (1 - p)) - (m - 1)) / (N - sum n^2 / N - (m - 1)), with m hosts, N documents and S = sum n (k/n - p)^2,
    gives its weight 1 / rho - 1. The shrunken share is (k + weight * p) / (n + weight): a small host is moved to the
    mean, a large one stays. Where hosts differ no more than chance explains (rho <= 0), all get p.
    """
    sums = [F.sum(F.col(r).cast("long")).alias(f"k_{r}") for r in rules]
    hosts = stage(failed.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *sums), "hosts")
    moments = [F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")]
    for r in rules:
        k = F.col(f"k_{r}").cast("double")
        moments += [F.sum(f"k_{r}").alias(f"all_{r}"), F.sum(k * k / F.col("n")).alias(f"spread_{r}")]
    seen = hosts.agg(*moments).first()  # one row, whatever the number of hosts
    out = hosts
    for r in rules:
        p, weight = prior(seen["m"], seen["total"] or 0, seen["squares"] or 0.0, seen[f"all_{r}"] or 0, seen[f"spread_{r}"] or 0.0)
        shrunk = F.lit(p) if weight is None else (F.col(f"k_{r}") + F.lit(weight * p)) / (F.col("n") + F.lit(weight))
        out = out.withColumn(f"rate_{r}", shrunk)
    return out


def prior(m: int, total: int, squares: float, failing: int, spread: float) -> tuple[float, float | None]:
    """Mean and weight of the beta prior (see ``host_rates``); a weight of None stands for one beyond bounds."""
    if not total or failing in (0, total):
        return failing / total if total else 0.0, None
    p = failing / total
    room = total - squares / total - (m - 1)
    rho = ((spread - total * p * p) / (p * (1 - p)) - (m - 1)) / room if room > 0 else 0.0
    return p, None if rho <= 0 else max(1 / rho - 1, 0.0)


def judged(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, host, text) its counts, the rules it fails, and whether it stays.

    A document that fails a base rule goes. So does one that fails any other rule if its host is not trusted. A null
    text has no words; a null host is a host. Repeated rows are judged and counted one by one. Only hosts that are
    not trusted meet the documents again; Spark knows their bytes and may split a host with very many rows.
    """
    rules = rule_failures()
    counted = stage(measured(docs).select("*", *[failed.alias(r) for r, failed in rules.items()]), "measured")
    rates = host_rates(counted, list(rules))
    above = F.greatest(*[F.col(f"rate_{r}") - F.lit(limit) for r, limit in LIMITS.items()]) > 0
    odd = stage(rates.where(above).select(F.col("host").alias("odd_host"), F.lit(True).alias("distrusted")), "odd-hosts")
    base, any_rule = F.col("short") | F.col("repetitive"), F.greatest(*rules)
    found = counted.join(odd, counted["host"].eqNullSafe(odd["odd_host"]), "left")
    distrusted = F.coalesce("distrusted", F.lit(False))
    return found.select(
        "doc_id", "host", *COUNTS, *rules, base.alias("base_failed"), distrusted.alias("host_distrusted"),
        (~base & ~(distrusted & any_rule)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, its source as host (see ``judged``); an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("source", "host")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_distrusted", "kept"
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT uid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
tok AS (SELECT uid, unnest(words) AS a, unnest(range(len(words))) AS i FROM w),
tri AS (SELECT uid, i, a, lead(a) OVER v AS b, lead(a, 2) OVER v AS c FROM tok WINDOW v AS (PARTITION BY uid ORDER BY i)),
windows AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, a, b, c) AS times FROM tri WHERE c IS NOT NULL),
covered AS (SELECT uid, count(DISTINCT place) AS n FROM (SELECT uid, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE times > 1) GROUP BY uid),
lines AS (SELECT uid, line FROM (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT uid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY uid),
c AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d JOIN w USING (uid) LEFT JOIN dup USING (uid) LEFT JOIN covered USING (uid)),
f AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive, 10 * n_symbols > n_words AS symbols,
    10 * n_dup_lines > 3 * n_lines AS dup_lines, word_chars < 3 * n_words OR word_chars > 10 * n_words AS word_length FROM c),
rule AS (UNPIVOT (SELECT source, short::INT AS short, repetitive::INT AS repetitive, symbols::INT AS symbols, dup_lines::INT AS dup_lines,
  word_length::INT AS word_length FROM f) ON short, repetitive, symbols, dup_lines, word_length INTO NAME rule VALUE failed),
host AS (SELECT rule, source, count(*)::DOUBLE AS n, sum(failed)::DOUBLE AS k FROM rule GROUP BY ALL),
m AS (SELECT rule, count(*) AS m, sum(n) AS total, sum(n * n) AS squares, sum(k) / sum(n) AS p, sum(k * k / n) AS spread FROM host GROUP BY rule),
rho AS (SELECT rule, p, CASE WHEN p IN (0, 1) OR total - squares / total <= m - 1 THEN 0
  ELSE ((spread - total * p * p) / (p * (1 - p)) - (m - 1)) / (total - squares / total - (m - 1)) END AS rho FROM m),
rate AS (SELECT source, CASE WHEN rho <= 0 THEN p ELSE (k + greatest(1 / rho - 1, 0) * p) / (n + greatest(1 / rho - 1, 0)) END AS rate
  FROM host JOIN rho USING (rule)),
odd AS (SELECT source, max(rate) > 0.5 AS distrusted FROM rate GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed, distrusted AS host_distrusted,
  NOT (short OR repetitive) AND NOT (distrusted AND (symbols OR dup_lines OR word_length)) AS kept
FROM f JOIN odd ON f.source IS NOT DISTINCT FROM odd.source
"""

"""Near-duplicates by an LSH forest over MinHash signatures, with every link confirmed on full shingle sets.

Each tree of the forest orders all documents by DEPTH minima of its own hash functions. Neighbours with the
longest common prefix are candidates: each document is paired with the next WIDTH ones of its order with which
it shares at least the first minimum, so the prefix that counts grows with the density of a region. Candidates
whose signatures agree too little for the wanted similarity are dropped; the others are confirmed on full sets,
first enough of them to connect what is connected, then all that still would join two components. Where more
documents share a first minimum than the window reaches, an exact prefix-filter join over their shingles finds all
pairs that are similar and not connected yet, at whatever depth they part. What no other row can meet is left out
where it is made: first minima of one document alone, texts of which no set is wanted, places outside a prefix.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoded, frugal, joined, mix64, parts_for, passing, prefix_hash, ship, slices, stage, stretch_hash

WORDS = 5
PERCENT = 75
TREES = 16
DEPTH = 4
WIDTH = 8
# Of the TREES * DEPTH minima so many agree at least. At a similarity of 0.75 each agrees with that chance, so a
# true pair falls below it about four times in ten million.
AGREEMENT = 30
# Rows of one shingle that a task compares with the others at a time.
ROWS_PER_KEY = 2000
ROWS_PER_PART = 200_000
# Bits of a table of marks, 64 for each marked value, 8 MB at most: with more values it lets more rows pass in vain.
MOST_BITS = 1 << 26
# Counters of shingles, 16 MB: with more shingles to a counter, rare ones are told apart less well. And how many
# bits or counters are a row while the tables are made.
COUNTERS = 1 << 22
BLOCK = 1 << 16
# Counters that sketch a set, one byte each.
SKETCH = 256


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_229)
    n = TREES * DEPTH
    return r.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; ASCII white space separates words, A-Z count as a-z.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    out: list[np.ndarray] = []
    for i, j in slices([len(t) for t in texts], 1 << 20):
        buffer, bounds = joined([t.lower() + b" " for t in texts[i:j]])
        blank = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1))
        start, end = edge[~blank[edge]], edge[blank[edge]]
        end = end[len(end) - len(start) :]
        h = stretch_hash(prefix_hash(buffer), start, end)
        n = np.diff(np.searchsorted(start, bounds))  # words of each text
        first = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            odd = [mix64(np.uint64(k + 1) * np.array([0x9E3779B97F4A7C15], np.uint64))[0] | np.uint64(1) for k in range(words)]
            rows = max(0, len(h) - words + 1)
            rolled = np.zeros(rows, np.uint64)
            for k in range(words):
                rolled += h[k : k + rows] * odd[k]
            rolled = mix64(rolled + np.uint64(words))
            for k in range(j - i):
                if n[k] >= words:
                    out.append(np.unique(rolled[first[k] : first[k] + n[k] - words + 1]))
                elif n[k]:
                    part = h[first[k] : first[k] + n[k]]
                    out.append(mix64(np.array([(part * np.array(odd[: n[k]])).sum() + np.uint64(n[k])], np.uint64)))
                else:
                    out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of TREES * DEPTH hash functions over each set, as 32 bits; all sets have elements."""
    a, b = _functions()
    out = np.zeros((len(sets), len(a)), np.uint32)
    for i, j in slices([8 * len(s) for s in sets], 1 << 20):
        values = np.concatenate(sets[i:j])
        begin = np.cumsum([0, *(len(s) for s in sets[i : j - 1])])
        for k in range(len(a)):
            out[i:j, k] = np.minimum.reduceat(((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def set_names(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that name a set: two sums of mixed elements."""
    out = []
    for s in sets:
        m = mix64(s)
        out.append(np.array([m.sum(), mix64(m ^ np.uint64(0xA5A5A5A5)).sum()], np.uint64).tobytes())
    return out


_SIGNED = "doc_id long, n_shingles long, name binary, signature binary"


def _sign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        more = [n for n in frame.schema.names if n not in ("doc_id", "text")]
        sets = shingle_sets(encoded(frame["text"].to_pylist()))
        full = [k for k, s in enumerate(sets) if len(s)]
        signed = signatures([sets[k] for k in full]) if full else np.zeros((0, TREES * DEPTH), np.uint32)
        signature: list[bytes | None] = [None] * len(sets)
        for k, row in zip(full, signed):
            signature[k] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [frame["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(set_names(sets), pa.binary()), pa.array(signature, pa.binary()), *map(frame.column, more)],
            ["doc_id", "n_shingles", "name", "signature", *more],
        )


def marks(hashes: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test for tasks: true for every value of the column ``hash`` (long), and for few others.

    One bit for each value, at the place that its low bits name; the table is bounded and sent to all tasks.
    """
    size = 1 << min(MOST_BITS.bit_length() - 1, max(BLOCK.bit_length() - 1, (64 * hashes.count()).bit_length()))

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK, bool)
        bits[frame["hash"].to_numpy(np.int64) & (BLOCK - 1)] = True
        return pd.DataFrame({"block": frame["block"].head(1), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    blocks = hashes.select("hash", F.expr(f"(hash & {size - 1}L) div {BLOCK}").alias("block"))
    table = np.zeros(size // 8, np.uint8)
    for row in blocks.groupBy("block").applyInPandas(block, "block long, bits binary").collect():
        table[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    sent = hashes.sparkSession.sparkContext.broadcast(table)

    def marked(values: np.ndarray) -> np.ndarray:
        place = values & (size - 1)
        return (sent.value[place >> 3] >> (place & 7) & 1).astype(bool)

    return marked


_TREE_ROW = "tree int, " + ", ".join(f"p{d} int" for d in range(1, DEPTH + 1)) + ", node long, brief binary"


def _minima(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The minima of each class, by tree, and a number for each region, tree and first minimum."""
    s = np.frombuffer(b"".join(frame["signature"]), np.uint32).reshape(len(frame), TREES, DEPTH)
    return s, mix64(np.arange(TREES, dtype=np.uint64) << np.uint64(32) | s[:, :, 0]).view(np.int64).ravel()


def _in_regions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            yield pd.DataFrame({"region": _minima(frame)[1], "node": np.repeat(frame["node"].to_numpy(np.int64), TREES)})


def in_regions(classes: DataFrame) -> DataFrame:
    """(region, node): a row per tree for each class."""
    return classes.select("node", "signature").mapInPandas(frugal(_in_regions), "region long, node long")


def regions(classes: DataFrame) -> DataFrame:
    """(region, n): the regions, tree and first minimum, of n classes, more than one."""
    return stage(in_regions(classes).groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "regions")


def _trees(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """A row per tree for each class that shares the region there, with its labels and the low byte of every minimum."""
    marked = marks(shared.select(F.col("region").alias("hash")))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            s, region = _minima(frame)
            rows = np.flatnonzero(marked(region))
            brief = [row.tobytes() for row in s.reshape(len(frame), -1).astype(np.uint8)]
            labels = s.reshape(-1, DEPTH).view(np.int32)[rows]
            yield pd.DataFrame({
                "tree": (rows % TREES).astype(np.int32),
                **{f"p{d + 1}": labels[:, d] for d in range(DEPTH)},
                "node": frame["node"].to_numpy(np.int64)[rows // TREES],
                "brief": np.array(brief, object)[rows // TREES],
            })

    return classes.select("node", "signature").mapInPandas(frugal(batches), _TREE_ROW)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.count_nonzero(a == b, axis=1)


def _briefs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), TREES * DEPTH)


_PAIR = "a long, b long, agree int"
_ALONG = f"{_PAIR}, part int, place int, tree int, p1 int, node long, brief binary"


def _pair_up(rows: pd.DataFrame, fresh: int) -> pd.DataFrame:
    """Pairs of each row from ``fresh`` on with the WIDTH rows before it that share tree and first minimum."""
    tree, p1, node = (rows[c].to_numpy() for c in ("tree", "p1", "node"))
    brief, out = _briefs(rows["brief"]), []
    for step in range(1, WIDTH + 1):
        now = np.arange(max(fresh, step), len(rows))
        now = now[(tree[now] == tree[now - step]) & (p1[now] == p1[now - step])]
        agree = _agree(brief[now], brief[now - step])
        good = agree >= AGREEMENT
        a, b = node[now[good]], node[now[good] - step]
        out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "agree": agree[good].astype(np.int32)}))
    return pd.concat(out).drop_duplicates(["a", "b"])


def _neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates along the order of one partition, and its first and last rows, for the seams between partitions."""
    part, held, head = TaskContext.get().partitionId(), None, None
    columns = ["tree", "p1", "node", "brief"]
    for frame in frames:
        if len(frame):
            rows = frame[columns] if held is None else pd.concat([held, frame[columns]], ignore_index=True)
            yield _pair_up(rows, len(rows) - len(frame)).assign(part=-1, place=0, tree=0, p1=0, node=0, brief=b"")
            head = rows.head(WIDTH) if held is None else head
            if len(head) < WIDTH:
                head = pd.concat([head, frame[columns].head(WIDTH - len(head))]) if held is not None else head
            held = rows.tail(WIDTH)
    if held is not None:
        for place, rows in ((0, head), (WIDTH, held)):
            yield rows.assign(part=part, place=np.arange(len(rows)) + place, a=-1, b=-1, agree=0)


def _seam(frame: pd.DataFrame) -> pd.DataFrame:
    """Candidates between the last rows of one partition and the first of the next."""
    rows = frame.sort_values("place").reset_index(drop=True)
    return _pair_up(rows, int((rows["place"] < 0).sum()))


def _along(trees: DataFrame, n_parts: int) -> DataFrame:
    """(a, b, agree): candidates between neighbours in the order of every tree, over all partitions."""
    labels = [f"p{d}" for d in range(1, DEPTH + 1)]
    ordered = trees.repartitionByRange(n_parts, "tree", *labels, "node").sortWithinPartitions("tree", *labels, "node")
    found = stage(ordered.mapInPandas(frugal(_neighbours), _ALONG), "along")
    edges = found.where("part >= 0")
    # Partitions without rows have no seam: number those that have, one row each.
    used = edges.select("part").distinct().withColumn("number", F.row_number().over(Window.orderBy("part")))
    edges = edges.join(used, "part")
    last = edges.where(F.col("place") >= WIDTH).withColumn("place", F.col("place") - 3 * WIDTH)
    first = edges.where(F.col("place") < WIDTH).withColumn("number", F.col("number") - 1)
    seams = last.unionByName(first).groupBy("number").applyInPandas(_seam, _PAIR)
    return found.where("part < 0").select("a", "b", "agree").unionByName(seams)


def neighbours(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b, agree), a < b: neighbouring classes (node, signature) of all trees, each pair once; ``shared`` are the regions."""
    rows = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    pairs = _along(_trees(classes, shared), parts_for(rows, ROWS_PER_PART))
    return stage(pairs.groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs")


def crowded(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(node): the classes of any of the regions that is denser than the window reaches.

    Two classes that share a smaller region were compared there; what the window can miss has both its ends here.
    """
    dense = stage(shared.where(F.col("n") > WIDTH + 1).select("region"), "dense")
    return stage(in_regions(classes).join(dense, "region").select("node").distinct(), "crowded")


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(COUNTERS, np.uint32)
    for frame in frames:
        for i, j in slices([len(s) for s in frame["shingles"]]):
            values = np.concatenate([_from48(s) for s in frame["shingles"][i:j]])
            counts += np.bincount(values.view(np.int64) & (COUNTERS - 1), minlength=COUNTERS).astype(np.uint32)
    if counts.any():
        blocks = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(-1, BLOCK)]
        yield pd.DataFrame({"block": np.arange(len(blocks)), "counts": blocks})


def _counts(blocks: pd.Series) -> Iterator[np.ndarray]:
    return (np.frombuffer(zlib.decompress(b), np.uint32) for b in blocks)


def _sum_counts(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.uint64)
    for counts in _counts(frame["counts"]):
        total += counts
    total = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    return pd.DataFrame({"block": frame["block"].head(1), "counts": [zlib.compress(total.tobytes(), 1)]})


def shingle_counts(sets: DataFrame) -> Broadcast[np.ndarray]:
    """How many shingles of the sets have each remainder modulo COUNTERS: a bound on how often one of them occurs."""
    schema = "block long, counts binary"
    rows = sets.select("shingles").mapInPandas(frugal(_count), schema).groupBy("block").applyInPandas(_sum_counts, schema).collect()
    out = np.zeros((COUNTERS // BLOCK, BLOCK), np.uint32)
    for row, counts in zip(rows, _counts([r.counts for r in rows])):
        out[row.block] = counts
    return sets.sparkSession.sparkContext.broadcast(out.ravel())


def prefixes(sets: DataFrame, sent: Broadcast[np.ndarray], wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(shingle, node, root, n, at, low): the places of each set (node, root, n, shingles) where the first common
    shingle of a similar pair can stand, those of low counts first; ``low`` where the other set may be as small or larger.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = sent.value
        for frame in frames:
            held, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n, data in zip(frame["n"], frame["shingles"]):
                s = _from48(data).view(np.int64)
                order = s[np.lexsort((s, counts[s & (COUNTERS - 1)]))[: n - (PERCENT * n + 99) // 100 + 1]]
                at = np.arange(len(order))
                if wanted is not None:
                    at = np.flatnonzero(wanted(order))
                held.append(order[at])
                places.append(at)
            rows = [len(h) for h in held[1:]]
            n, at = np.repeat(frame["n"].to_numpy(np.int64), rows), np.concatenate(places)
            yield pd.DataFrame({
                "shingle": np.concatenate(held), "node": np.repeat(frame["node"].to_numpy(np.int64), rows),
                "root": np.repeat(frame["root"].to_numpy(np.int64), rows), "n": n, "at": at,
                "low": (100 + PERCENT) * (n - at) >= 2 * PERCENT * n,
            })

    return sets.select("node", "root", "n", "shingles").mapInPandas(frugal(batches), "shingle long, node long, root long, n long, at long, low boolean")


def by_rare_shingles(sets: DataFrame) -> DataFrame:
    """(a, b): every pair of the sets (node, root, n, shingles) that may be similar and is not connected yet.

    Each set is put in the order of its shingles' counters, the least first; any order that is the same for all sets
    does. Of a similar pair with n and m shingles, at least PERCENT * (n + m) / (100 + PERCENT) are common, so as
    many follow the first common one, itself included, in both sets: only pairs with a common shingle at such places
    are candidates, and no similar pair is missed. Shingles within one component make no pairs; of the others, rows
    of the component that most of a shingle's rows belong to never meet each other, and a frequent one's rows are
    split over tasks.
    """
    counts = shingle_counts(sets)
    spans = prefixes(sets, counts).groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("low").alias("low"))
    mixed = stage(spans.where("least < most AND low").select(F.col("shingle").alias("hash")), "mixed")
    postings = stage(prefixes(sets, counts, marks(mixed)), "postings")
    counts = postings.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("rows"), F.max("low").alias("low"))
    keys = counts.groupBy("shingle").agg(
        F.max_by("root", "rows").alias("main"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("roots"), F.max("low").alias("low")
    )
    keys = stage(keys.where("roots > 1 AND low").select("shingle", "main", (F.col("rows") / ROWS_PER_KEY).cast("int").alias("cuts")), "keys")
    postings = postings.join(keys, "shingle").withColumn("own", F.expr("IF(root = main, 1, 0)"))
    first = postings.where("low").select(
        "shingle", "own", F.expr("pmod(hash(node), cuts + 1)").alias("cut"), F.col("node").alias("u"), F.col("root").alias("u_root"),
        F.col("n").alias("u_n"), F.col("at").alias("u_at"),
    )
    second = postings.select(
        "shingle", F.explode(F.expr("IF(own = 1, array(0), array(0, 1))")).alias("own"), "cuts", F.col("node").alias("v"),
        F.col("root").alias("v_root"), F.col("n").alias("v_n"), F.col("at").alias("v_at"),
    ).withColumn("cut", F.explode(F.expr("sequence(0, cuts)"))).drop("cuts")
    common = PERCENT * (F.col("u_n") + F.col("v_n"))
    found = first.join(second, ["shingle", "own", "cut"]).where(
        F.expr("u_root <> v_root AND (u_n < v_n OR u_n = v_n AND u < v)")
        & ((100 + PERCENT) * (F.col("u_n") - F.col("u_at")) >= common)
        & ((100 + PERCENT) * (F.col("v_n") - F.col("v_at")) >= common)
    )
    return stage(found.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "by-rare-shingles")


def _low48(hashes: np.ndarray) -> bytes:
    return np.unique(hashes & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, n, shingles) and further columns of ``wanted``: the full sets of the wanted classes (node, least, name),
    48 bits of each hash. Sets are made where the texts are read, only of rows that can be wanted; texts are not shuffled."""
    marked = marks(wanted.select(F.xxhash64("least").alias("hash")))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            frame = frame.filter(pa.array(marked(frame["hash"].to_numpy())))
            sets = shingle_sets(encoded(frame["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_names(sets), pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_low48(s) for s in sets], pa.binary())],
                ["name", "n", "shingles"],
            )

    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("hash"), "text")
    found = texts.mapInArrow(frugal(batches), "name binary, n long, shingles binary")
    return found.join(wanted.drop("least"), "name").dropDuplicates(["name"]).drop("name")


def _sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each set, how many elements begin with each of SKETCH values, up to 255."""
    for frame in frames:
        counts = [np.bincount((_from48(s) >> np.uint64(40)).astype(np.int64), minlength=SKETCH) for s in frame["shingles"]]
        yield frame[["node", "n"]].assign(sketch=[np.minimum(c, 255).astype(np.uint8).tobytes() for c in counts])


def _possible(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that can be similar: no more elements are common than the lesser counts say, unless a count is full."""
    for frame in frames:
        s, t = (np.frombuffer(b"".join(frame[c]), np.uint8).reshape(len(frame), SKETCH) for c in ("s", "t"))
        most = np.minimum(s, t)
        common = most.sum(axis=1, dtype=np.int64)
        yield frame.loc[(100 * common >= PERCENT * (frame["n"] + frame["m"] - common)) | (most == 255).any(axis=1), ["a", "b"]]


def _with_ends(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(a, b, n, s, m, t): the pairs with size and ``column`` of either end, from the rows (node, n, column)."""
    first = rows.select(F.col("node").alias("a"), F.col("n"), F.col(column).alias("s")).join(pairs, "a", "left_semi")
    second = rows.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col(column).alias("t")).join(pairs, "b", "left_semi")
    return pairs.select("a", "b").join(first, "a").join(second, "b")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those with 100 * intersection >= PERCENT * union; full sets meet where sketches leave it open."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for n, m, s, t in zip(frame["n"], frame["m"], frame["s"], frame["t"]):
                common = len(np.intersect1d(_from48(s), _from48(t), assume_unique=True)) if 100 * min(n, m) >= PERCENT * max(n, m) else 0
                good.append(100 * common >= PERCENT * (n + m - common))
            yield frame.loc[good, ["a", "b"]]

    sketches = stage(sets.select("node", "n", "shingles").mapInPandas(frugal(_sketch), "node long, n long, sketch binary"), "sketches")
    possible = stage(_with_ends(pairs, sketches, "sketch").mapInPandas(frugal(_possible), "a long, b long"), "possible")
    return _with_ends(possible, sets, "shingles").mapInPandas(frugal(batches), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has links (a, b).

    Large-star and small-star rounds: every node points its larger, then its smaller neighbours to the least
    of them, until nothing changes. A node's neighbours are only aggregated, never gathered.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(large.where("u <> v").distinct(), "edges")
        least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        before = now


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs with their ends' roots, where these differ."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
        pairs = pairs.withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return pairs.where("a_root <> b_root")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots (node, root) after some more links (a, b): components of components."""
    open_links = stage(_rooted(links, roots).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), "open")
    if open_links.isEmpty():
        return roots
    upper = stage(components(open_links), "upper")
    above = upper.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stage(moved.unionByName(upper.join(roots.select("node"), "node", "left_anti")), "roots")


def _rooted_rows(docs: DataFrame, more: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_shingles, root, component_id) and the columns ``more`` (expression and type by name) for each row
    of ``docs`` (doc_id, text). Rows without shingles have no root and their own id."""
    ship(docs.sparkSession)
    more = more or {}
    rows = docs.select(F.col("doc_id").cast("long"), "text", *[F.expr(e).alias(n) for n, (e, _) in more.items()])
    schema = ", ".join([_SIGNED, *[f"{n} {t}" for n, (_, t) in more.items()]])
    with passing(docs.sparkSession, "signed", "named"):
        signed = stage(rows.mapInArrow(frugal(_sign), schema), "signed")
        classes = stage(
            signed.where("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("least"), F.min("signature").alias("signature"))
            .select(F.monotonically_increasing_id().alias("node"), "name", "least", "signature"),
            "classes",
        )
        shared = regions(classes)
        pairs = neighbours(classes, shared)
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stage(classes.join(nodes, "node").select("node", "least", "name"), "wanted")
        sets = stage(_sets(docs, wanted), "sets", "none")
        # First the likeliest pair of every node; then whatever would still join two components.
        ends = pairs.select("a", "b", "agree", F.explode(F.array("a", "b")).alias("node"))
        likely = ends.groupBy("node").agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        links = stage(confirmed(stage(likely, "likely"), sets), "confirmed")
        roots = stage(components(links), "roots")
        roots = _merged(roots, stage(confirmed(stage(_rooted(pairs, roots), "open"), sets), "confirmed"))
        # The window leaves pairs of dense regions unseen: all of them that are not connected yet.
        dense = classes.join(crowded(classes, shared), "node").join(roots, "node", "left")
        wanted = stage(dense.select("node", F.coalesce("root", "node").alias("root"), "least", "name"), "wanted")
        if not wanted.isEmpty():
            sets = stage(_sets(docs, wanted), "sets", "none")
            rest = by_rare_shingles(sets)
            roots = _merged(roots, stage(confirmed(rest, sets), "confirmed"))
        known = classes.select("name", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        known = stage(known, "known")
        ids = stage(known.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
        named = stage(known.join(ids, "root").select("name", "root", "component_id"), "named")
    found = signed.where("n_shingles > 0").join(named, "name").select("doc_id", "n_shingles", "root", "component_id", *more)
    none = signed.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"), *more
    )
    return found.unionByName(none)


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    Rows with equal sets form one class; null, empty and blank texts have no shingles and no links. A
    component's id is its smallest doc_id (null ids count only where there is no other). Repeated rows each get a
    row; other columns of ``docs`` play no part.
    """
    found = _rooted_rows(docs).drop("root")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """Of each component one row, with all its columns: that with the smallest doc_id, null last, and of repeated ids
    the one with the smallest digest of its text. Rows without shingles all stay, and rows repeated with the same
    id and text count as one, so all of them stay or go; exact deduplication leaves no such rows."""
    with passing(docs.sparkSession, "kept"):
        rows = _rooted_rows(docs, {"digest": ("unhex(sha2(coalesce(text, ''), 256))", "binary")})
        order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "digest")
        first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.digest")
        kept = stage(first.unionByName(rows.where("root IS NULL").select("doc_id", "digest")).distinct(), "kept")
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (digest == kept["digest"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near-equal texts of every document."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

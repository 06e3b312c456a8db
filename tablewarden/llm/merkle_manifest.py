"""Merkle manifest of a dataset: one tree per group of rows, one tree over their roots, and proofs for every row.

Checkpoint and recompute: of all levels only every ``EVERY``-th is stored, cut into blocks that are whole aligned
subtrees. A proof needs siblings of every level; the task that holds a block hashes its missing levels again,
emits the siblings, and drops them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators.ids import assign_ids

from .common import frugal, ship, stage

FANOUT = 3
EVERY = 4
BLOCK = FANOUT**EVERY


def digest(*inputs: str) -> str:
    """Lowercase hex SHA-256 of the inputs one after the other."""
    return sha256("".join(inputs).encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value, so that no two rows read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def levels_of(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of one block, its own nodes first. ``n`` is the number of nodes that its whole tree has on the
    block's level: below the last block ``EVERY`` levels follow, in the only block as many as lead to one node."""
    levels = [nodes]
    while len(levels) <= EVERY if n > BLOCK else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def siblings_of(levels: list[list[str]], i: int) -> str:
    """The others in the run of node ``i`` and of each of its ancestors below the block's top, left to right."""
    found = []
    for level in levels[:-1]:
        start = i - i % FANOUT
        found += [h for k, h in enumerate(level[start : start + FANOUT], start) if k != i]
        i //= FANOUT
    return "".join(found)


def folded(node: str, siblings: str, places: list[tuple[int, int]]) -> str:
    """The root that follows from a node and its siblings; ``places``: position and number of nodes, tree by tree."""
    at = 0
    for i, n in places:
        while n > 1:
            start, place = i - i % FANOUT, i % FANOUT
            left = at + 64 * place
            end = at + 64 * (min(FANOUT, n - start) - 1)
            node = digest(siblings[at:left], node, siblings[left:end])
            at, i, n = end, i // FANOUT, -(-n // FANOUT)
    return node


def _tops(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        sizes = frame["n"].to_pylist()
        tops = [levels_of([e["node"] for e in nodes], n)[-1][0] for nodes, n in zip(frame["nodes"].to_pylist(), sizes)]
        above = pa.array([-(-n // BLOCK) for n in sizes], pa.int64())
        yield pa.RecordBatch.from_arrays([frame["tree"], above, frame["block"], pa.array(tops, pa.string())], ["tree", "n", "i", "node"])


@dataclass
class Forest:
    """Stored levels of trees: ``levels[k]`` (tree, n, block, nodes) has level ``k * EVERY`` of all trees that reach
    beyond the level stored before; ``roots`` (tree, n, node)."""

    levels: list[DataFrame]
    roots: DataFrame


def grow(nodes: DataFrame) -> Forest:
    """Hash trees over ``nodes`` (tree, n, i, node and more): n nodes of a tree, i from 0.

    The driver sees one number a stored level, of which there are log81 of the largest tree.
    """
    levels, roots = [], []
    entry = F.struct("i", "node", *[c for c in nodes.columns if c not in ("tree", "n", "i", "node")])
    while True:
        blocks = nodes.groupBy("tree", "n", F.expr(f"i DIV {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(entry)).alias("nodes"))
        levels.append(stage(blocks, "merkle-level"))
        tops = stage(levels[-1].mapInArrow(frugal(_tops), "tree long, n long, i long, node string"), "merkle-tops")
        roots.append(tops.where("n = 1"))
        nodes, entry = tops.where("n > 1"), F.struct("i", "node")
        if nodes.isEmpty():
            break
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return Forest(levels, out)


def _path_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        tree, place, path = [], [], []
        for t, n, nodes, above in zip(*(frame[c].to_pylist() for c in ("tree", "n", "nodes", "above"))):
            levels = levels_of([e["node"] for e in nodes], n)
            tree += [t] * len(nodes)
            place += [e["i"] for e in nodes]
            path += [siblings_of(levels, i) + above for i in range(len(nodes))]
        yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(place, pa.int64()), pa.array(path, pa.string())], ["tree", "block", "above"])


def paths_to_blocks(forest: Forest, above_roots: DataFrame) -> DataFrame:
    """``levels[0]`` with ``above``: the siblings on the way from each block's top to the root.

    ``above_roots`` (tree, above) continues the paths beyond the trees' own roots. From the highest stored level
    down, each block regenerates its interior nodes and tells each stored node its path.
    """
    beyond = above_roots.select("tree", F.lit(0).cast("long").alias("block"), "above", F.lit(True).alias("only"))
    told = beyond
    for k in range(len(forest.levels) - 1, -1, -1):
        blocks = forest.levels[k].withColumn("only", F.col("n") <= BLOCK)
        met = blocks.join(told, ["tree", "block", "only"])
        if k == 0:
            return met.drop("only")
        found = stage(met.mapInArrow(frugal(_path_batches), "tree long, block long, above string"), "merkle-paths")
        told = beyond.unionByName(found.withColumn("only", F.lit(False)))
    raise ValueError("a forest has at least one level")


@dataclass
class Manifest:
    """``groups`` (group, tree, n, subroot, above, n_groups, root), and the stored levels of the groups' trees.

    The entries of ``forest.levels[0]`` hold, besides place and leaf, the columns that were carried along.
    """

    groups: DataFrame
    forest: Forest


def manifest(leaves: DataFrame, carried: list[str]) -> Manifest:
    """The manifest of ``leaves`` (group, key, leaf and the carried columns).

    Leaves of a group ascend by key, null first; leaves with one key by their hash and then the carried columns.
    Groups ascend by name, null first, in order of their UTF-8 bytes. Rows are placed by range, so that a group
    with a third of all rows spans many tasks, and its blocks lie anywhere.
    """
    ship(leaves.sparkSession)
    leaves = stage(leaves.select("group", "key", "leaf", *carried), "merkle-leaves")
    placed = assign_ids(leaves, "rank", order_by=["group", "key", "leaf", *[c for c in carried if c != "key"]])
    sizes = placed.groupBy("group").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    sizes = stage(assign_ids(sizes, "tree", order_by=["group"]), "merkle-groups")
    own = sizes.select(F.col("group").alias("of"), "first", "n", (F.col("tree") - 1).alias("tree"))
    nodes = placed.join(own, placed["group"].eqNullSafe(own["of"])).select(
        "tree", "n", (F.col("rank") - F.col("first")).alias("i"), F.col("leaf").alias("node"), *carried
    )
    forest = grow(nodes)
    n_groups = sizes.count()
    top = grow(
        forest.roots.select(
            F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), F.col("tree").alias("i"), "node"
        )
    )
    root = top.roots.first()  # one row, none for an empty table
    above = paths_to_blocks(top, top.roots.select("tree", F.lit("").alias("above")))
    above = above.mapInArrow(frugal(_path_batches), "tree long, block long, above string")
    groups = (
        own.drop("first")
        .join(forest.roots.select("tree", F.col("node").alias("subroot")), "tree")
        .join(above.select(F.col("block").alias("tree"), "above"), "tree")
        .select(
            F.col("of").alias("group"), "tree", "n", "subroot", "above", F.lit(n_groups).cast("long").alias("n_groups"),
            F.lit(root["node"] if root else None).cast("string").alias("root"),
        )
    )
    return Manifest(stage(groups, "merkle-manifest"), forest)


def proofs(made: Manifest, batches, schema: str) -> DataFrame:
    """``batches`` over rows that hold a block of leaves each: the groups' columns, block, nodes, and in ``above`` the
    siblings from the block's top to the root of all."""
    blocks = paths_to_blocks(made.forest, made.groups.select("tree", "above"))
    groups = made.groups.select("tree", "n_groups", "subroot", "root")
    return blocks.join(groups, "tree").mapInArrow(frugal(batches), schema)


_PROVED = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
    "verified boolean, n_siblings int"
)


def _proof_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PROVED.split(", ")]
    for frame in frames:
        rows = []
        columns = ("tree", "n", "nodes", "above", "n_groups", "subroot", "root")
        for tree, n, nodes, above, n_groups, subroot, root in zip(*(frame[c].to_pylist() for c in columns)):
            levels = levels_of([e["node"] for e in nodes], n)
            for i, e in enumerate(nodes):
                siblings = siblings_of(levels, i) + above
                found = folded(e["claimed"], siblings, [(e["i"], n), (tree, n_groups)])
                rows.append((e["doc_id"], e["node"], subroot, root, digest(siblings), found, found == root, len(siblings) // 64))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int32()]
        cells = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names)


def verified_rows(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, source, lang, n_chars, text) its leaf, roots and proof, and what the proof says
    about the row as found: rows with an even crc32 of their id are given with their line breaks deleted.

    A null field counts as such and never as an empty one. Rows without an id come first in their source and are not
    tampered with; repeated rows are leaves of their own; a table without rows has no tree and no rows here.
    """
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars")]
    tampered = (F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    changed = leaf_of(*fields, F.regexp_replace("text", "\n", ""))
    leaf = leaf_of(*fields, F.col("text"))
    leaves = docs.select(
        F.col("source").alias("group"), fields[0].alias("key"), leaf.alias("leaf"), fields[0].alias("doc_id"),
        F.when(tampered, changed).otherwise(leaf).alias("claimed"),
    )
    made = manifest(leaves, ["doc_id", "claimed"])
    return proofs(made, _proof_batches, _PROVED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest and proofs of every document, grouped by source (see ``verified_rows``)."""
    return verified_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# The crc32 of a text of ASCII characters, bit by bit.
CRC_SQL = (
    "list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), lambda crc, c: "
    "list_reduce(list_prepend(xor(crc, c), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))"
)

SQL = r"""
WITH RECURSIVE given AS (
  SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text
  FROM documents),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN (CRC & 1) = 1 THEN  -- its complement is even
         sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
         ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS claimed
  FROM given),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS i
  FROM hashed),
-- level: 0 at the leaves of a tree
nodes AS (
  SELECT tree, 0 AS level, i, n, leaf AS node FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM nodes WHERE n > 1
  GROUP BY tree, level, i // 3, n),
subroots AS (SELECT tree, node, level FROM nodes WHERE n = 1),
over AS (
  SELECT 0 AS level, tree AS i, (SELECT count(*) FROM subroots) AS n, node FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY i)) FROM over WHERE n > 1
  GROUP BY level, i // 3, n),
root AS (SELECT node FROM over WHERE n = 1),
-- what stands before and after a node in its run
sides AS (
  SELECT a.tree, a.level, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
  FROM (SELECT tree, level, i, n, node FROM nodes UNION ALL SELECT -1, level, i, n, node FROM over) a
  JOIN (SELECT tree, level, i, n, node FROM nodes UNION ALL SELECT -1, level, i, n, node FROM over) b
    ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3 AND a.n > 1
  GROUP BY a.tree, a.level, a.i),
climb AS (
  SELECT leaf, claimed, doc_id, tree AS own, tree, 0 AS level, i, n, '' AS siblings, claimed AS node, row_number() OVER () AS uid FROM leaves
  UNION ALL
  -- up one level, or from a subroot over to the tree of subroots
  SELECT c.leaf, c.claimed, c.doc_id, c.own, CASE WHEN c.n > 1 THEN c.tree ELSE -1 END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END,
    CASE WHEN c.n > 1 THEN c.i // 3 ELSE c.own END, CASE WHEN c.n > 1 THEN (c.n + 2) // 3 ELSE (SELECT count(*) FROM subroots) END,
    c.siblings || coalesce(s.l || s.r, ''), CASE WHEN c.n > 1 THEN sha256(s.l || c.node || s.r) ELSE c.node END, c.uid
  FROM climb c LEFT JOIN sides s ON s.tree = c.tree AND s.level = c.level AND s.i = c.i WHERE c.n > 1 OR c.tree >= 0)
SELECT c.doc_id, c.leaf, s.node AS subroot, root.node AS root, sha256(c.siblings) AS proof_sha256, c.node AS folded_root,
  c.node = root.node AS verified, (strlen(c.siblings) // 64)::INTEGER AS n_siblings
FROM climb c JOIN subroots s ON s.tree = c.own, root WHERE c.tree = -1 AND c.n = 1
""".replace("CRC", CRC_SQL.format("doc_id::VARCHAR"))

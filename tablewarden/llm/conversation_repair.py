"""Repair of the turn structure of conversations: the cheapest edits, found by depth-first branch and bound."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.operators.ids import assign_ids

from .common import frugal, ship, stage
from .merkle_manifest import CRC_SQL

BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, RETYPE, UNENDED = 2, 5, 1, 5
# Faults of a row, the first that holds: no word, met before, or without an end mark.
BLANK, DUPLICATE, TRUNCATED = "B", "D", "T"
# What has been written so far: nothing, a system turn, a user turn last, an assistant turn last. The next written turn
# is an assistant's after a user's and else a user's; a conversation may end empty or after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
# Rows of one conversation that one search covers; longer conversations are searched in several, joined by their states.
SEGMENT = 1024


def kept_state(state: int, initial: str) -> int | None:
    """The state after a turn is kept as it is, None where that is not allowed."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


@lru_cache(maxsize=None)
def moves(initial: str | None, fault: str, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, cost, rows consumed, state after) of each edit that may come next; None: no row is left."""
    found = [("I", INSERT, 0, _NEXT[state])]
    if initial is not None:
        found.append(("D", DELETE, 1, state))
        if fault not in (BLANK, DUPLICATE):
            extra = UNENDED if fault else 0
            kept = kept_state(state, initial)
            if kept is not None:
                found.append(("K", extra, 1, kept))
            found.append(("R", RETYPE + extra, 1, _NEXT[state]))
    return tuple(found)


def _known(initial: str) -> str:
    """The initial, or one for all that cannot be kept."""
    return initial if initial in ("s", "u", "a") else "?"


def lower_bounds(rows: list[tuple[str, str]], goals: tuple[int, ...]) -> list[list[float]]:
    """For each place and state, what the rows from there on cost at least until a goal, audits left aside.

    Bounds that know the state are tight: with looser ones a search through hundreds of rows improves the same prefixes
    again and again, as the incumbent does not rule them out.
    """
    def inserted(costs: list[float]) -> list[float]:
        for _ in range(2):  # never more insertions in a row than it takes from nothing to an assistant's turn
            costs = [min(costs[s], INSERT + costs[_NEXT[s]]) for s in range(4)]
        return costs

    out = [inserted([0 if s in goals else inf for s in range(4)])]
    for initial, fault in reversed(rows):
        kind = _known(initial)
        out.append(inserted([min(price + out[-1][to] for _, price, step, to in moves(kind, fault, s) if step) for s in range(4)]))
    return out[::-1]


def search(rows: list[tuple[str, str]], start: int, goals: tuple[int, ...], bounds: list[list[float]]) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from state ``start`` over all rows to one of the ``goals``.

    Depth first with a stack of its own, most promising move first. A prefix is dropped if its cost and the bound of
    what follows exceed the incumbent, or meet it with a greater audit; or if another prefix has reached the same
    place and state with less (cost, audit), in which no prefix of equal cost begins another. The search ends when
    the stack is empty, which proves the incumbent best.
    """
    n = len(rows)
    best: tuple[int, str] | None = None
    reached: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(n + 1)]
    reached[0][start] = (0, "")
    stack = [(0, start, (0, ""))]
    while stack:
        i, state, prefix = stack.pop()
        if reached[i][state] is not prefix and reached[i][state] != prefix:
            continue  # dominated meanwhile
        cost, audit = prefix
        if best is not None:
            least = cost + bounds[i][state]
            if least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
                continue
        if i == n and state in goals and (best is None or prefix < best):
            best = prefix
        open_moves = []
        initial, fault = rows[i] if i < n else (None, "")
        for letter, price, step, after in moves(None if initial is None else _known(initial), fault, state):
            total = cost + price
            least = total + bounds[i + step][after]
            if least == inf or (best is not None and least > best[0]):
                continue
            reaching = (total, audit + letter)
            held = reached[i + step][after]
            if held is None or reaching < held:
                reached[i + step][after] = reaching
                open_moves.append((least, letter, i + step, after, reaching))
        open_moves.sort(reverse=True)
        stack += [(place, after, reaching) for _, _, place, after, reaching in open_moves]
    return best


_WAYS = [(a, b) for a in range(4) for b in range(4) if not (b == START and a != START) and not (b == SYSTEM and a > SYSTEM)]


def ways(rows: list[tuple[str, str]], first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a stretch of rows. Of a conversation's first stretch only ways from
    the start count, of one that is first and last only the best one to an end."""
    if first and last:
        found = search(rows, START, ENDS, lower_bounds(rows, ENDS))
        return [(START, ASSISTANT, *found)]
    bounds = [lower_bounds(rows, (b,)) for b in range(4)]
    found = ((a, b, search(rows, a, (b,), bounds[b])) for a, b in _WAYS if not first or a == START)
    return [(a, b, *way) for a, b, way in found if way is not None]


def joined_ways(stretches: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the best way through all stretches, and the state before and the audit of each.

    Ways to one state that cost the same differ within their common length, so the lesser prefix stays the lesser.
    """
    at = {START: (0, "", None)}
    for found in stretches:
        after: dict = {}
        for a, b, cost, audit in found:
            if a in at:
                held = (at[a][0] + cost, at[a][1] + audit)
                if b not in after or held < after[b][:2]:
                    after[b] = (*held, (at[a][2], a, audit))
        at = after
    cost, _, step = min((at[s] for s in ENDS if s in at), key=lambda w: w[:2])
    parts = []
    while step is not None:
        step, a, audit = step
        parts.append((a, audit))
    return cost, parts[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the crc32 of ``conv_id:turn`` names; nulls count as a space.

    Of twenty rows one goes, one loses its text, one its end marks, one comes twice, one becomes a user's.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    act = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(act == 4, "user").otherwise(role).alias("role"),
        F.when(act == 1, "").when(act == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        act.alias("act"),
    ).where("act <> 0").select(
        "conv_id", "turn", "role", "text",
        F.explode(F.when(F.col("act") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _described(rows: DataFrame) -> DataFrame:
    """Rows without their texts: (conv_id, turn, role, digest, blank, unended)."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    return rows.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("unended"),
    )


_ORDER = ["conv_id", "turn", "role", "digest"]
_WAY = "array<struct<before:int,after:int,cost:long,audit:string>>"
_STRETCH = (
    "conv_id long, stretch long, turn long, role string, digest binary, first_turn long, last_turn long, "
    "least_turn long, most_turn long, n_turns long, head string, tail string, blank long, duplicate long, "
    f"truncated long, illegal long, ways {_WAY}"
)
_LEGAL = ("su", "ua", "au")


def _arrow(schema: str, spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cells = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)


def stretches(rows: DataFrame) -> DataFrame:
    """Each conversation's rows in order, in stretches of at most SEGMENT rows, with counts and best ways.

    Rows are numbered by (conv_id, turn with null first, role, digest of the text); a conversation with a third of all
    rows spans many tasks here. A stretch is what a conversation has among SEGMENT successive numbers.
    """
    spark = rows.sparkSession
    ranked = stage(assign_ids(stage(_described(rows), "described"), "rank", order_by=_ORDER), "ranked")
    same = ["conv_id", "role", "digest"]
    again = stage(
        ranked.groupBy(*same).agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("n")).where("n > 1"), "again"
    ).select(*[F.col(c).alias(f"of_{c}") for c in same], "first_rank")
    met = ranked.join(again, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in same], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("rank") > F.col("first_rank"), DUPLICATE).when(F.col("unended"), TRUNCATED)
    row = F.struct("rank", "turn", F.left("role", F.lit(1)).alias("initial"), F.coalesce(fault, F.lit("")).alias("fault"))
    gathered = met.groupBy("conv_id", F.expr(f"(rank - 1) DIV {SEGMENT}").alias("stretch")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.min_by(F.struct("turn", "role", "digest"), "rank").alias("key")
    )
    schema = _arrow(_STRETCH, spark)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for conv, stretch, given, key in zip(*(frame[c].to_pylist() for c in ("conv_id", "stretch", "rows", "key"))):
                turns = [r["turn"] for r in given if r["turn"] is not None]
                marks = [r["initial"] for r in given]
                faults = [r["fault"] for r in given]
                first = given[0]["rank"] - 1 > stretch * SEGMENT
                last = given[-1]["rank"] < (stretch + 1) * SEGMENT
                found = ways(list(zip(marks, faults)), first, last)
                out.append((
                    conv, stretch, key["turn"], key["role"], key["digest"], given[0]["turn"], given[-1]["turn"],
                    min(turns, default=None), max(turns, default=None), len(set(turns)), marks[0], marks[-1],
                    faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
                    sum(a + b not in _LEGAL for a, b in zip(marks, marks[1:])),
                    [dict(zip(("before", "after", "cost", "audit"), way)) for way in found],
                ))
            yield _batch(out, schema)

    return stage(gathered.mapInArrow(frugal(batches), _STRETCH), "stretches")


_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN = f"conv_id long, {_TOTALS}, parts array<struct<turn:long,role:string,digest:binary,stretch:long,state:int,letters:string>>"


def plans(found: DataFrame) -> DataFrame:
    """For each conversation its counts, cost and audit, and of each stretch where it begins and its part of the audit.

    A conversation's stretches meet here without their rows: at most eleven characters for each of its rows, of which
    its audit is one.
    """
    entry = F.struct("stretch", *[c for c in found.columns if c not in ("conv_id", "stretch")])
    whole = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry.dropFields("ways").withField("ways", F.col("ways")))).alias("s"))
    schema = _arrow(_PLAN, found.sparkSession)

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for conv, s in zip(frame["conv_id"].to_pylist(), frame["s"].to_pylist()):
                cost, parts = joined_ways([[tuple(w.values()) for w in x["ways"]] for x in s])
                shared = sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in zip(s, s[1:]))
                turns = [x["least_turn"] for x in s] + [x["most_turn"] for x in s]
                turns = [t for t in turns if t is not None]
                gaps = max(turns) - min(turns) + 1 - (sum(x["n_turns"] for x in s) - shared) if turns else 0
                seams = sum(a["tail"] + b["head"] not in _LEGAL for a, b in zip(s, s[1:]))
                out.append((
                    conv, gaps, *(sum(x[c] for x in s) for c in ("blank", "duplicate", "truncated")),
                    sum(x["illegal"] for x in s) + seams, cost, "".join(audit for _, audit in parts),
                    [{"turn": x["turn"], "role": x["role"], "digest": x["digest"], "stretch": x["stretch"], "state": state, "letters": audit}
                     for x, (state, audit) in zip(s, parts)],
                ))
            yield _batch(out, schema)

    return whole.mapInArrow(frugal(batches), _PLAN)


class _Writer:
    """The repaired rows of one conversation, from its rows and its audit as they come."""

    def __init__(self) -> None:
        self.state, self.letters, self.hash, self.some = START, deque(), sha256(), False

    def _write(self, role: str, text: str) -> None:
        if self.some:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.some = True

    def _insert(self) -> None:
        while self.letters and self.letters[0] == "I":
            self.letters.popleft()
            self.state = _NEXT[self.state]
            self._write(_NAMES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter = self.letters.popleft()
        if letter == "K":
            self.state = kept_state(self.state, role[:1])
            self._write(role, text)
        elif letter == "R":
            self.state = _NEXT[self.state]
            self._write(_NAMES[self.state], text)

    def digest(self) -> str:
        self._insert()
        return self.hash.hexdigest()


_RESULT = f"conv_id long, {_TOTALS}, repaired_sha256 string"
HEADER, PART, ROW = range(3)


def _written(schema: pa.Schema):
    def batches(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, writer, out = None, None, []
        for frame in frames:
            for kind, conv, role, text, letters, totals in zip(
                *(frame[c].to_pylist() for c in ("kind", "conv_id", "role", "text", "letters", "totals"))
            ):
                if kind == HEADER:
                    if writer:
                        out.append((*held, writer.digest()))
                    held, writer = (conv, *totals.values()), _Writer()
                elif kind == PART:
                    writer.letters.extend(letters)
                else:
                    writer.row(role, text)
            if len(out) > 500:
                yield _batch(out, schema)
                out = []
        if writer:
            out.append((*held, writer.digest()))
        yield _batch(out, schema)

    return batches


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """For each conv_id of ``conversations`` the counts, cost, audit and digest of the repaired ``rows`` (conv_id, turn,
    role, text; no nulls in role and text).

    Turns ascend with null first; rows of one turn ascend by role and then by the SHA-256 of their text. A null conv_id
    is a conversation of its own. A role that begins with none of s, u and a (or has no character) cannot be kept. The
    digest of a conversation is one pass over its texts by definition; they stream through one task in order,
    interleaved with the parts of the audit, and only the text at hand is held.
    """
    spark = conversations.sparkSession
    ship(spark)
    planned = stage(plans(stretches(rows)), "plans")
    named = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    plan = planned.withColumnRenamed("conv_id", "of")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    totals = F.struct(
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit")
    )

    def line(kind: int, **given: Column) -> list[Column]:
        blank = {"turn": "long", "role": "string", "digest": "binary", "stretch": "long", "text": "string", "letters": "string",
                 "totals": "struct<" + _TOTALS.replace(", ", ",").replace(" ", ":") + ">"}
        made = [given.get(c, F.lit(None)).cast(kind_).alias(c) for c, kind_ in blank.items()]
        return ["conv_id", F.lit(int(kind != HEADER)).alias("after"), F.lit(kind).alias("kind"), *made]

    headers = named.join(plan, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*line(HEADER, totals=totals))
    parts = planned.select("conv_id", F.explode("parts").alias("p")).select(
        *line(PART, **{c: F.col(f"p.{c}") for c in ("turn", "role", "digest", "stretch", "letters")})
    )
    texts = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).select(
        *line(ROW, **{c: F.col(c) for c in ("turn", "role", "digest", "text")})
    )
    stream = headers.unionByName(parts).unionByName(texts).repartition("conv_id").sortWithinPartitions(
        "conv_id", "after", "turn", "role", "digest", "kind", "stretch"
    )
    return stream.mapInArrow(frugal(_written(_arrow(_RESULT, spark))), _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired (see ``damaged`` and ``repaired``). One of which no row is left has
    zeros, an empty audit and the digest of the empty text; repeated rows are duplicates; an empty table gives no rows."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(conversations, damaged(conversations))


SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, CRC) % 20 AS act FROM
    (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
broken AS (
  SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role,
    CASE act WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN act = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given WHERE act <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, role[1] AS ini FROM broken)),
r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'B' WHEN seen THEN 'D'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'T' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair
  FROM placed),
-- Written so far: 0 nothing, 1 s, 2 u last, 3 a last. More than one insertion in a row never pays.
path AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'made': ''} AS best FROM r
  UNION ALL
  SELECT conv_id, i + 1, after, min({'cost': cost, 'audit': audit, 'made': made}) FROM (
    SELECT conv_id, i, CASE letter WHEN 'D' THEN s WHEN 'R' THEN (CASE s WHEN 2 THEN 3 ELSE 2 END)
        ELSE (CASE WHEN ini = 's' AND s = 0 THEN 1 WHEN ini = 'u' AND s <> 2 THEN 2 WHEN ini = 'a' AND s = 2 THEN 3 END) END AS after,
      before + (CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END) + (CASE WHEN letter <> 'D' AND fault = 'T' THEN 5 ELSE 0 END) AS cost,
      trail || letter AS audit,
      so_far || (CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10)
        ELSE (CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END) || text || chr(10) END) AS made
    FROM (
      SELECT p.conv_id, p.i, r.role, r.text, r.fault, r.ini, letter,
        CASE WHEN ins = 0 THEN state WHEN state = 2 THEN 3 ELSE 2 END AS s, best.cost + 5 * ins AS before,
        best.audit || (CASE ins WHEN 1 THEN 'I' ELSE '' END) AS trail,
        best.made || (CASE WHEN ins = 0 THEN '' WHEN state = 2 THEN 'assistant:' || chr(10) ELSE 'user:' || chr(10) END) AS so_far
      FROM path p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1, (VALUES (0), (1)) a(ins), (VALUES ('D'), ('K'), ('R')) b(letter))
    WHERE letter = 'D' OR fault NOT IN ('B', 'D'))
  WHERE after IS NOT NULL GROUP BY conv_id, i, after),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'B') AS blank,
    count(*) FILTER (WHERE fault = 'D') AS duplicate, count(*) FILTER (WHERE fault = 'T') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id),
ended AS (
  SELECT p.conv_id, min(CASE state WHEN 2 THEN {'cost': best.cost + 5, 'audit': best.audit || 'I', 'made': best.made || 'assistant:' || chr(10)} ELSE best END) AS best
  FROM path p JOIN counted c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n WHERE state <> 1 GROUP BY p.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(CASE WHEN coalesce(best.made, '') = '' THEN '' ELSE best.made[:length(best.made) - 1] END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
""".replace("CRC", CRC_SQL.format("k"))

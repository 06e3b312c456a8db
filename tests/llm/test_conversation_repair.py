import random
import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import differences  # noqa: E402

from tablewarden.llm import conversation_repair as repair  # noqa: E402

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, cost int, audit string, rank int, stretch string"


def cheapest(rows):
    """Least (cost, audit) of every way to edit the rows that costs no more than to delete them all."""
    limit = 2 * len(rows)
    found = []

    def go(i, cost, roles, audit):
        if cost > limit:
            return
        if i == len(rows) and LEGAL.fullmatch(roles):
            found.append((cost, audit))
        for r in "ua":
            go(i, cost + 5, roles + r, audit + "I")
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, cost + 2, roles, audit + "D")
            if fault not in ("B", "D"):
                more = 5 if fault == "T" else 0
                go(i + 1, cost + more, roles + (initial or "?"), audit + "K")
                for r in "ua":
                    go(i + 1, cost + 1 + more, roles + r, audit + "R")

    go(0, 0, "", "")
    return min(found)


def some_rows(r, n):
    return [(r.choice("uuuaaasx") if r.random() < 0.95 else "", r.choices(["", "B", "D", "T"], (6, 1, 1, 1))[0]) for _ in range(n)]


def test_search_against_all_edits():
    r = random.Random(1)
    for n in [0, 1, 2, 3, 4] * 60 + [5] * 15:
        rows = some_rows(r, n)
        assert repair.search(rows, repair.START, repair.ENDS, repair.lower_bounds(rows, repair.ENDS)) == cheapest(rows), rows


def test_bounds_never_exceed_what_follows():
    r = random.Random(2)
    for _ in range(400):
        rows = some_rows(r, r.randint(1, 9))
        for goals in [(s,) for s in range(4)] + [repair.ENDS]:
            bounds = repair.lower_bounds(rows, goals)
            for i in range(len(rows) + 1):
                for a in range(4):
                    if a == repair.SYSTEM or repair.SYSTEM not in goals and repair.START not in goals:
                        way = repair.search(rows[i:], a, goals, [[0] * 4] * (len(rows) - i + 1))
                        assert way is None or way[0] >= bounds[i][a]


def test_a_long_conversation_takes_few_steps():
    import time

    r = random.Random(3)
    rows = some_rows(r, 3000)
    began = time.process_time()
    bounds = repair.lower_bounds(rows, repair.ENDS)
    assert repair.search(rows, repair.START, repair.ENDS, bounds)[0] == bounds[0][repair.START]
    assert time.process_time() - began < 20


@pytest.mark.parametrize("size", [1, 2, 5])
def test_stretches_join_to_the_best_of_all(size):
    r = random.Random(size)
    for _ in range(200):
        rows = some_rows(r, r.randint(size + 1, 30))
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        found = [repair.ways(p, k == 0, k == len(parts) - 1 and k == 0) for k, p in enumerate(parts)]
        cost, audits = repair.joined_ways(found)
        assert (cost, "".join(a for _, a in audits)) == repair.search(rows, repair.START, repair.ENDS, repair.lower_bounds(rows, repair.ENDS))


def conversations():
    r = random.Random(7)
    texts = ["Yes.", "No?", "so", "", " \t\n", "a\nb.", "é!  \r", "Yes.", "x" * 500 + ".", None, ".", "!", "end.\x0b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "aide"]
    rows = []
    for conv in range(120):
        for turn in range(r.randint(0, 9)):
            role = ("user", "assistant")[turn % 2] if r.random() < 0.7 else r.choice(roles)
            text = f"{conv} {turn}." if r.random() < 0.6 else r.choice(texts)
            rows.append((conv, turn + r.choice([0, 0, 0, 0, 3]), role, text))
    rows += [(500, t, ("user", "assistant")[t % 2] if r.random() < 0.8 else r.choice(roles), f"{t % 150} w{r.choice('.!x')}") for t in range(300)]
    rows += [(501, None, r.choice(roles), r.choice(texts)) for _ in range(12)]
    rows += [(None, t, r.choice(roles), r.choice(texts)) for t in range(12)]
    rows += [(502, 3, "user", "same."), (502, 3, "user", "same."), (502, 3, "assistant", "same."), (503, -5, "system", "s."), (503, 2**40, "user", "long " * 200_000)]
    r.shuffle(rows)
    return rows


def by_sql(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con


@pytest.mark.parametrize("size", [3, 1024])
def test_against_sql(spark, monkeypatch, size):
    monkeypatch.setattr(repair, "SEGMENT", size)
    rows = conversations()
    given = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(5)
    assert differences(repair.repaired(given, repair.damaged(given)), by_sql(rows, repair.SQL), repair.SQL) is None


def test_a_conversation_without_rows_left_and_an_empty_table(spark):
    import zlib

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    given = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    row = repair.repaired(given, repair.damaged(given)).collect()
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    assert repair.repaired(given.limit(0), repair.damaged(given.limit(0))).count() == 0

import hashlib
import random

import pytest

from tablewarden.llm import suffix_dedup

W = suffix_dedup.WINDOW


def brute(rows):
    first = {}
    big = float("inf")
    data = [(big if i is None else i, i, (t or "").encode()) for i, t in rows]
    for order, _, t in data:
        for s in range(len(t) - W + 1):
            first[t[s : s + W]] = min(order, first.get(t[s : s + W], big))
    out = []
    for order, i, t in data:
        gone = bytearray(len(t))
        for s in range(len(t) - W + 1):
            if first[t[s : s + W]] < order:
                gone[s : s + W] = b"\1" * W
        spans = sum(gone[j] and (j == 0 or not gone[j - 1]) for j in range(len(t)))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["ab", "the", "über", "of", "x", "längere", "of the", "…"]
    passages = [" ".join(r.choices(words, k=r.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choices(words, k=r.randint(0, 30))) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(r.randint(0, 3), r.choice(passages))
        rows.append((i, r.choice(["", " ", "\0"]).join(parts)))
    rows += [(n, None), (n + 1, ""), (None, rows[3][1]), (None, rows[3][1] + "!"), (7, rows[7][1]), (n + 2, rows[5][1])]
    rows += [(n + 3, "a" * 400), (n + 4, "a" * 300), (n + 5, "\0" * 120), (n + 6, "b" + "\0" * 80)]
    rows += [(-1, "x" * 49), (-2, "x" * 50), (n + 7, "x" * 51), (n + 8, "é" * 30), (n + 9, "ü" + "é" * 30)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_bytes, bucket_bytes", [(1 << 20, 1 << 20), (600, 2000), (1, 50_000)])
def test_against_brute_force(spark, block_bytes, bucket_bytes):
    rows = corpus(block_bytes)
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, n_bytes string").repartition(3)
    got = suffix_dedup.repeated(docs, block_bytes, bucket_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_a_long_text_is_parsed_in_pieces(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "SLICE", 64)
    rng = random.Random(5)
    a, b = ("".join(rng.choices("abc d", k=700)) for _ in range(2))
    texts = [a.encode(), (b[:300] + a[100:400] + b[300:]).encode()]
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.array([0, *np.cumsum([len(t) for t in texts])])
    p = suffix_dedup.Parse(buffer, bounds)
    starts, owner = p.windows_of(np.arange(len(p.key)))
    assert sorted(starts) == [s for t, o in ((0, 0), (1, 700)) for s in range(o, o + len(texts[t]) - W + 1)]
    by_window = {}
    for s, o in zip(starts, owner):
        by_window.setdefault(buffer[s : s + W].tobytes(), set()).add(int(p.key[o]))
    assert all(len(keys) == 1 for keys in by_window.values())


def test_rest_of_texts_and_empty_table(spark):
    schema = "doc_id long, text string, block string, ids array<int>, rest long"
    rows = [(1, "y" * 60, "a", [1], None), (2, "zz" + "y" * 60, None, None, 5), (3, None, "c", [], 6), (None, "é" * 60, "d", [2], 7)]
    docs = spark.createDataFrame(rows, schema)
    got = {tuple(r) for r in suffix_dedup.replaced(docs).select("doc_id", "text", "block", "rest").collect()}
    assert got == {(1, "y" * 60, "a", None), (2, "zz", None, 5), (3, None, "c", 6), (None, "é" * 60, "d", 7)}
    assert suffix_dedup.replaced(docs).schema.simpleString() == docs.schema.simpleString()
    assert suffix_dedup.repeated(docs.limit(0)).count() == 0


def test_zones_that_share_half_their_hash(spark):
    rows = [(1, "gsdia ervv rok dvditvbssoonixlh bkimxqiospatvvgiha"), (2, "gsdia ervv rok dvdgwgmpydc aaabezcsnuwirdzdqkifhzc")]
    got = suffix_dedup.repeated(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=1).collect()
    assert sorted(map(tuple, got)) == brute(rows) and [r.n_removed for r in got] == [0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_triggers_with_one_name(monkeypatch, seed):
    """Triggers share four names: what is told about one must not hold for another."""
    import numpy as np
    import pandas as pd
    import zstandard

    made = suffix_dedup.Parse.__init__

    def init(self, *given):
        made(self, *given)
        self.key &= np.uint64(3)

    monkeypatch.setattr(suffix_dedup.Parse, "__init__", init)
    r = random.Random(seed)
    texts = ["".join(r.choices("abcdefgh ", k=300)) for _ in range(6)]
    texts += [texts[0][:150] + texts[1][150:], "zz" + texts[2], texts[3][20:200] + texts[4][:90] + "q" * 60]
    held = []
    for k in range(0, 9, 3):
        data = [t.encode() for t in texts[k : k + 3]]
        lengths, packed = np.array([len(t) for t in data]), zstandard.ZstdCompressor().compress(b"".join(data))
        held.append({"block": k, "ids": np.arange(k, k + 3).tobytes(), "lengths": lengths.tobytes(), "texts": packed})

    def exchanged(announce, compare, prefix):
        entries = pd.concat(announce(1)(iter([pd.DataFrame(held)])))
        answers = pd.concat([compare(g) for _, g in entries.groupby("bucket")])
        columns = [c for c in answers.columns if c != "block"]
        for row in held:
            mine = answers[answers["block"] == row["block"]]
            row |= {f"{prefix}_{c}": mine[c].tolist() for c in columns}
        return [f"{prefix}_{c}" for c in columns]

    t = exchanged(suffix_dedup._announce_triggers, suffix_dedup._compare_triggers, "t")
    w = exchanged(suffix_dedup._announce_windows, suffix_dedup._compare_windows, "w")
    got = []
    for row in held:
        b = suffix_dedup.Block(row, 1)
        gone = suffix_dedup._removed(b, *(suffix_dedup._told(*(row[c] for c in columns)) for columns in (t, w)))
        for i, s, e in zip(b.ids, b.parse.bounds[:-1], b.parse.bounds[1:]):
            got.append((int(i), *suffix_dedup._digest(b.parse.buffer[s:e], gone[s:e], False)))
    assert sorted(got, key=repr) == brute(list(enumerate(texts)))

import zlib

import numpy as np
import pytest

from tablewarden.llm import packing
from tablewarden.llm.word_cache import word_level


def checked(counts):
    plan = packing.solve(counts, rounds=60)
    got = np.zeros_like(counts)
    for pattern, copies in plan.patterns:
        assert sum(n * k for n, k in pattern) <= len(counts) - 1
        for n, k in pattern:
            got[n] += k * copies
    assert (got == counts).all()
    return plan.sequences


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_all_pieces(seed):
    r = np.random.default_rng(seed)
    counts = np.bincount(r.integers(1, 101, r.integers(1, 400)), minlength=101)
    area = -(-int((counts * np.arange(101)).sum()) // 100)
    assert area <= checked(counts) <= area * 1.2 + 2


def test_known_optima():
    assert checked(np.zeros(11, np.int64)) == 0
    for sizes, best in (({10: 4}, 4), ({6: 5, 4: 5}, 5), ({5: 4, 3: 4, 2: 4}, 4), ({7: 2, 3: 1}, 2), ({4: 3}, 2)):
        counts = np.zeros(11, np.int64)
        for n, k in sizes.items():
            counts[n] = k
        assert checked(counts) == best


def test_the_program_beats_plain_best_fit():
    r = np.random.default_rng(1)
    counts = np.bincount(r.choice([700, 690, 1100, 520, 300], 20_000), minlength=2049)
    assert packing.solve(counts).sequences < 0.98 * packing._fit(counts, 2048).sequences


def test_pieces_and_places(spark):
    encode = word_level(packing.TOKENIZER).encode
    rows = [(0, None), (1, ""), (2, "a b c " * 900), (3, "one two"), (3, "one two"), (None, "no id"), (4, "x y " * 3000)]
    rows += [(10 + i, "w " * (i % 7)) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, length int, absent string").repartition(3)
    got = packing.pack(docs).toPandas()
    want = []
    for i, t in rows:
        ids = encode(t or "") + b"\0\0\0\0"
        want += [(i, k, k * 2048, min(2048, len(ids) // 4 - k * 2048), zlib.crc32(ids[8192 * k : 8192 * k + 8192])) for k in range(-(-len(ids) // 8192))]
    found = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert group["offset"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]] and group["length"].sum() <= 2048
    assert packing.pack(docs.limit(0)).count() == 0

import hashlib
import random
import re

from tablewarden.llm import exact_dedup


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_fingerprints_compose():
    r = random.Random(1)
    for _ in range(50):
        x, y = (bytes(r.choices(range(256), k=r.randint(0, 40))) for _ in range(2))
        f = exact_dedup.fingerprints([x, y, x + y])
        for k, prime in enumerate(exact_dedup.PRIMES, start=1):
            assert (int(f[f"h{k}"][0]) * int(f[f"shift{k}"][1]) + int(f[f"h{k}"][1])) % prime == f[f"h{k}"][2]


def rows_of(spark):
    long = "long text\t" * 60_000  # several chunks
    texts = [None, "", " ", "\n\t ", "a b", "a\n\nb", "a b ", "A b", "a b", long, long.replace("\t", "  "), long + "x", "ü"]
    rows = [(50 - i, t) for i, t in enumerate(texts)] + [(100 + i, "hot  text" if i % 2 else "hot text") for i in range(40)]
    rows += [(5, "again"), (5, "again"), (5, "other"), (None, "a b"), (None, "alone"), (None, "alone")]
    schema = "doc_id long, text string, n_bytes string, h1 int, kept boolean, uid double, norm string"
    return rows, spark.createDataFrame([(i, t, "k", 1, None, None, "n") for i, t in rows], schema).repartition(3)


def test_groups_against_brute_force(spark):
    rows, docs = rows_of(spark)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    want = sorted(((i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]),
                    hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted(groups)


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    def clash(parts):
        return exact_dedup_prints([b"same"] * len(parts))

    exact_dedup_prints = exact_dedup.fingerprints
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "aa", "bb", "cc", "aa"])], "doc_id long, text string")
    prints = exact_dedup.fingerprint_table(docs)
    same = prints.selectExpr("uid", "doc_id", "text_sha256", "1L AS n_bytes", "2L AS h1", "3L AS h2")
    monkeypatch.setattr(exact_dedup, "fingerprint_table", lambda d: same)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {0: (0, 3, True), 2: (0, 3, False), 5: (0, 3, False), 1: (1, 2, True), 3: (1, 2, False), 4: (4, 1, True)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs).count() == 0 and exact_dedup.without_copies(docs).count() == 0

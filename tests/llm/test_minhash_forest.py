import random
import re

import pytest

from tablewarden.llm import minhash_forest


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and sets[j] and 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                group[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if root(k) == root(i) and d is not None]
        component = min(ids, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    rows, i = [], 0

    def changed(text, n):
        parts = text.split(" ")
        for _ in range(n):
            parts[r.randrange(len(parts))] = r.choice(words)
        return " ".join(parts)

    for size, most in [(1, 0)] * 30 + [(3, 4), (5, 8), (12, 9), (60, 10), (40, 6)]:
        base = " ".join(r.choices(words, k=r.randint(100, 260)))
        for _ in range(size):
            rows.append((i, changed(base, r.randint(0, most))))
            i += 1
    chain = " ".join(r.choices(words, k=150))
    for _ in range(15):
        rows.append((i, chain))
        chain, i = changed(chain, 3), i + 1
    passage = " ".join(r.choices(words, k=60))
    for _ in range(25):
        rows.append((i, passage + " " + " ".join(r.choices(words, k=120))))
        i += 1
    r.shuffle(rows)
    return [(k, t) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(-1, None), (-2, ""), (-3, " \n"), (900, "one two"), (901, "One\tTWO"), (902, "one two three"), (903, "É one"), (904, "é one")]
    rows += [(905, rows[3][1].upper()), (905, rows[3][1]), (None, rows[4][1]), (None, "no id at all"), (906, "a b c d e f"), (907, "a b c d e f a b c d e")]
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in rows], "doc_id long, text string, name string, node int").repartition(3)
    got = sorted((tuple(r) for r in minhash_forest.near_groups(docs).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table_and_texts_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, minhash_forest.near_groups(docs).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert minhash_forest.near_groups(docs.limit(0)).count() == 0


def test_components_of_stars_and_chains(spark):
    links = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5001), (5001, 5000), (5002, 5002)]
    got = {r.node: r.root for r in minhash_forest.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(300)} | {k: 1000 for k in range(1000, 1061)} | {5000: 5000, 5001: 5000}


def same_components(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in minhash_forest.near_groups(docs).collect()), key=repr) == brute(rows)


def test_pairs_within_one_template(spark):
    """84 of 100 shingles are the template's: unrelated texts have 0.72, pairs 0.77, and the window seldom meets them."""
    r = random.Random(7)
    template = " ".join(f"t{k}" for k in range(88))
    texts = []
    for k in range(250):
        start = f"{template} s{k} s{k}a s{k}b"
        texts += [" ".join([start, *(f"x{k}{end}{j}" for j in range(13))]) for end in "ab"]
    r.shuffle(texts)
    same_components(spark, list(enumerate(texts)))


def test_pairs_beside_large_groups_in_one_region(spark):
    """Groups of near-equal texts are the heaviest of every dense region; pairs there have no weight."""
    r = random.Random(8)
    template = " ".join(f"t{k}" for k in range(88))
    texts = []
    for g in range(26):
        texts += [" ".join([template, *(f"g{g}w{j}" for j in range(15)), f"m{member}"]) for member in range(10)]
    for k in range(150):
        texts += [" ".join([template, f"s{k} s{k}a s{k}b", *(f"x{k}{end}{j}" for j in range(13))]) for end in "ab"]
    r.shuffle(texts)
    same_components(spark, list(enumerate(texts)))


def test_texts_and_whole_sets_are_not_shuffled(spark, capsys):
    """Where tables are too large for a broadcast, only wanted sets and the prefixes of sets go through an exchange."""
    r = random.Random(9)
    rows = [(k, " ".join(r.choices([f"w{j}" for j in range(500)], k=40 + k))) for k in range(60)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = minhash_forest.shingle_sets([t.encode() for _, t in rows])
    names = minhash_forest.set_names(sets)
    wanted = [(k, rows[k][0], bytearray(names[k])) for k in (*range(0, 60, 7), 60)]
    wanted = spark.createDataFrame(wanted, "node long, least long, name binary")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = minhash_forest._sets(docs.unionByName(docs), wanted)
        found.explain("formatted")
        plan = capsys.readouterr().out
        exchanges = re.findall(r"\) Exchange[^\n]*\nInput[^\n]*", plan)
        assert exchanges and not any("text#" in e for e in exchanges)
        got = {row.node: (row.n, bytes(row.shingles)) for row in found.collect()}
        assert got == {k: (len(sets[k]), minhash_forest._low48(sets[k])) for k in (*range(0, 60, 7), 60)}
        made = spark.createDataFrame([(k, k, len(s), minhash_forest._low48(s)) for k, s in enumerate(sets)], "node long, root long, n long, shingles binary")
        sent = minhash_forest.prefixes(made, minhash_forest.shingle_counts(made)).groupBy("node").count().collect()
        assert {row.node: row["count"] for row in sent} == {k: len(s) // 4 + 1 for k, s in enumerate(sets)}
        same_components(spark, [(k, t) for k, (_, t) in enumerate(rows)] + [(100 + k, f"{t} end") for k, (_, t) in enumerate(rows)])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketches_keep_every_similar_pair_also_of_full_counters(spark, monkeypatch):
    met, ends = [], minhash_forest._with_ends
    monkeypatch.setattr(minhash_forest, "_with_ends", lambda pairs, rows, column: met.append(pairs.count()) or ends(pairs, rows, column))
    r = random.Random(10)
    rows, pairs = [], []
    for size, common in [(90_000, 0.9), (300, 0.9), (300, 0.858), (300, 0.6), (4, 0.75), (1, 1)]:
        base = [r.getrandbits(48) for _ in range(2 * size)]
        shared = round(common * size)
        for part in (base[:size], base[:shared] + base[size : 2 * size - shared]):
            rows.append((len(rows), size, b"".join(e.to_bytes(6, "little") for e in part)))
        pairs.append((len(rows) - 2, len(rows) - 1))
    sets = spark.createDataFrame(rows, "node long, n long, shingles binary")
    links = minhash_forest.confirmed(spark.createDataFrame(pairs, "a long, b long"), sets)
    assert sorted(map(tuple, links.collect())) == [(0, 1), (2, 3), (10, 11)]
    assert met[0] == 6 and 3 <= met[1] <= 5

import random
import zlib
from hashlib import sha256

from tablewarden.llm import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, n int, i double, node string, above int, root string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """All levels, every one kept."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def others(levels, i):
    return [(i % 3, [x for k, x in enumerate(level[j // 3 * 3 : j // 3 * 3 + 3]) if k != j % 3], j % 3)
            for level, j in ((level, i // 3**k) for k, level in enumerate(levels[:-1]))]


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        rows = [(d[0] is not None, d[0] or 0, leaf(*d), d) for d in groups[g]]
        rows.sort(key=lambda r: r[:3])
        trees[g] = rows, tree([r[2] for r in rows])
    over = tree([trees[g][1][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        rows, levels = trees[g]
        for i, (_, _, own, d) in enumerate(rows):
            path = others(levels, i) + others(over, k)
            text = d[4]
            if text is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(*d[:4], text)
            for _, sides, place in path:
                node = h(*sides[:place], node, *sides[place:])
            proof = h(*(x for _, sides, _ in path for x in sides))
            out.append((d[0], own, levels[-1][0], over[-1][0], proof, node, node == over[-1][0]))
    return sorted(out, key=repr)


def got(docs):
    return sorted((tuple(r)[:7] for r in merkle_manifest.verified_rows(docs).collect()), key=repr)


def rows_of():
    r = random.Random(5)
    sizes = {"hot": 260, "one": 1, "three": 3, "block": 81, "above": 82, "é": 4, "z": 10, "": 2, None: 7}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            text = r.choice([None, "", "a\nb", "line\n" * 5, "no break", "ü\nö\r\n"])
            rows.append((n * 7 % 1009, source, r.choice([None, "en", ""]), r.choice([None, n]), text))
    rows += [(5, "z", "en", 1, "same\n"), (5, "z", "en", 1, "same\n"), (5, "z", "en", 1, "other"), (None, "z", None, None, "x\ny")]
    rows.append((6000, "long", "en", 3, "word \n" * 400_000))
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "t", 1, 2.0, "n", 3, "r") for r in rows], SCHEMA).repartition(5)
    want = brute(rows)
    assert got(docs) == want
    assert {r[6] for r in want} == {True, False}


def test_only_some_levels_are_stored(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "t", 1, 2.0, "n", 3, "r") for r in rows], SCHEMA)
    leaves = docs.selectExpr("source AS group", "doc_id AS key", "sha2(coalesce(text, ''), 256) AS leaf", "doc_id")
    made = merkle_manifest.manifest(leaves, ["doc_id"])
    assert [sum(len(r.nodes) for r in level.collect()) for level in made.forest.levels] == [len(rows), 2 + 4]
    assert sorted(r.n for r in made.groups.collect()) == sorted([260, 1, 3, 81, 82, 4, 14, 2, 7, 1])


def test_a_changed_row_no_longer_fits(spark):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(30)]
    good = brute(rows)[0][3]
    assert brute([(*r[:4], "changed") if r[0] == 17 else r for r in rows])[0][3] != good
    path = tree([leaf(*r) for r in rows])
    siblings = merkle_manifest.siblings_of(path, 17)
    assert merkle_manifest.folded(leaf(*rows[17]), siblings, [(17, 30)]) == path[-1][0]
    assert merkle_manifest.folded(leaf(*rows[16]), siblings, [(17, 30)]) != path[-1][0]


def test_one_row_and_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = [(3, None, None, None, None)]
    assert got(spark.createDataFrame(one, schema)) == brute(one)
    assert got(spark.createDataFrame([], schema)) == []

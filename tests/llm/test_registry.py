import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import connect, differences  # noqa: E402

import corpus_pipeline  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tablewarden.llm import exact_dedup, minhash_forest, registry  # noqa: E402
from tablewarden.llm.common import shared_path  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) < set(registry.QUERIES) < set(queries()) and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name]) is None


def test_stages(spark):
    from test_exact_dedup import norm
    from test_minhash_forest import brute as near
    from test_suffix_dedup import brute as repeats

    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs = given.unionByName(given.limit(3).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.unionByName(spark.createDataFrame([(200000, None, None, None, 0), (200001, "12 - 34", "en", "s", 7)], docs.schema)).cache()
    held = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, made) in enumerate(corpus_pipeline.STAGES):
        out = made(spark, docs, SF)
        if k < 4:
            assert out.columns == given.columns
            out = out.cache()
            found = {r.doc_id: r.text for r in out.collect()}
        if k == 0:
            assert set(held) - set(found) == {200000, 200001}
        elif k == 1:
            first = {}
            for i in sorted(held):
                first.setdefault(norm(held[i]), i)
            assert set(found) == set(first.values())
        elif k == 2:
            assert set(found) == {r[0] for r in near(list(held.items())) if r[3]}
        elif k == 3:
            lost = {r[0]: r[2] for r in repeats(list(held.items()))}
            assert set(found) == set(held)
            assert all(found[i] == held[i] if not lost[i] else len(found[i].encode()) <= len(held[i].encode()) - lost[i] for i in held)
        else:
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(held)
        if k < 4:
            docs, held = out, found


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


CLASHING = "doc_id long, text string, copied int, keep int, _KEEP int, sha int, kept int, root int, digest int, name int, node int, uid int, first int"


def test_stages_with_clashing_columns_and_repeated_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, words + " end"), (2, "quite another text, and no copy at all"), (2, "  "), (3, words),
            (3, words), (None, words + " end more"), (None, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, *range(k, k + 11)) for k, (i, t) in enumerate(rows)], CLASHING)
    exact = exact_dedup.without_copies(docs)
    assert exact.schema == docs.schema
    first = sorted(((r.doc_id, r.text) for r in exact.collect()), key=repr)
    assert first == sorted([(1, words), *rows[1:4], rows[6], rows[8]], key=repr)
    near = minhash_forest.without_near_copies(exact.cache())
    assert near.schema == docs.schema
    # Of the two rows with id 2 only the near copy of document 1 goes.
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=repr) == sorted([(1, words), *rows[2:4], rows[8]], key=repr)
    for made in (exact_dedup.without_copies, minhash_forest.without_near_copies):
        assert made(docs.limit(0)).count() == 0


def test_staged_tables_go_when_nothing_reads_them(spark):
    base = Path(shared_path(spark, "x")).parent
    held = {p.name for p in base.iterdir()} if base.is_dir() else set()
    docs = spark.createDataFrame([(i, f"text {i % 3} of many words and more") for i in range(9)], "doc_id long, text string")
    found = minhash_forest.without_near_copies(exact_dedup.without_copies(docs))
    assert {p.name.rsplit("-", 1)[0] for p in base.iterdir() if p.name not in held} == {"kept"}
    assert found.count() == 3

import zlib

from tablewarden.llm import language_id


def test_held_out_accuracy(spark):
    found = language_id.query(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, n_chars long, score string"
    rows = [(i, "the cat and the dog " * 3, "en", 1, "s") for i in range(20)] + [(i, "der Hund und die Katze " * 3, "de", None, None) for i in range(20, 40)]
    docs = spark.createDataFrame(rows + [(50, None, "en", 1, ""), (51, " 12 !?", "de", 1, ""), (None, "und die", None, 2, ""), (52, "", None, 3, "")], schema)
    model = language_id.train(docs.where(~language_id.held_out(docs["doc_id"])))
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(docs, model).collect()]
    assert got == [(r[0], r[2]) for r in rows] + [(50, "und"), (51, "und"), (None, "de"), (52, "und")]
    kept = language_id.accepted(docs, model)
    assert kept.schema == docs.schema and kept.count() == 41
    assert kept.where("doc_id IS NULL").first().text == "und die"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert [tuple(r) for r in language_id.identify(docs, model).collect()] == [(1, "und", 0.0)]
    assert language_id.identify(docs.limit(0), model).count() == 0 and language_id.accepted(docs, model).count() == 0

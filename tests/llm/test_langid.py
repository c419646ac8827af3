import zlib

from pyspark.sql import functions as F

from loam.llm import langid as L


def test_held_out_accuracy(spark):
    got = L.op3_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got) <= 5


def test_edge_cases(spark):
    a, b = [i for i in range(5, 100) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    rows = [(None, "the cat and the dog sat on the mat", "en"), (1, None, "en"), (2, "", None), (3, "12 + 34!", "de"), (4, "x" * 200_000, "xx"), (a, "der hund und die katze " * 50, "de"), (a, "der hund und die katze " * 50, "de"), (b, "the dog and the cat are here " * 50, "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, score string")
    got = L.add_language(docs, docs).select("doc_id", "text", "score", F.col("language.lang_pred").alias("p"), F.col("language.rejected").alias("r")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].p == by[2].p == by[3].p == "und" and by[1].r and by[3].r
    assert by[a].p == "de" and by[b].p == "en" and by[a].score == "clash"
    assert L.add_language(docs.limit(0), docs.limit(0)).count() == 0
    assert [r.language.lang_pred for r in L.add_language(docs, docs.limit(0)).collect()] == ["und"] * len(rows)


def test_labels_and_held_out_rows_are_not_used(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, f"mot de la langue {i}", "zz" if i in held else "fr") for i in range(200)], "doc_id bigint, text string, lang string")
    assert list(L.learn(docs.where(~L.held_out()))) == ["fr"]


def test_short_ties_are_rejected():
    e = L.Encoders({"en": L.letters("the dog and the cat are here with the other animals " * 9), "de": L.letters("der hund und die katze sind hier bei den anderen tieren " * 9)})
    assert e.predict("the dog and the cat are here", 0.01)[0::2] == ("en", False)
    assert e.predict("der hund und die katze sind hier", 0.01)[0::2] == ("de", False)
    for text in ("qwrt zzxv kkpl", "xq", "q" * 300):
        assert e.predict(text, 0.01)[1:] == (0.0, True)


def test_more_languages_than_full_dictionaries(spark):
    rows = [(i, f"wort{lang} mot{lang} palabra{lang} " * 3, f"l{lang:03}") for lang in range(12) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    small = L.learn(docs, rows=4, dictionary_bytes=120, full_languages=3)
    assert len(small) == 12 and all(len(x) <= 30 for x in small.values())
    import pytest

    with pytest.raises(ValueError):
        L.learn(docs, max_languages=11)


def test_narrow_margins_are_rejected_in_the_table(spark):
    """Texts half in one language and half in another are rejected at a margin that their halves pass."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400")
    dictionaries = L.learn(docs.where(~L.held_out()))
    e = L.Encoders(dictionaries)
    first = {lang: next(r.text for r in docs.where(L.held_out() & (F.col("lang") == lang)).orderBy("doc_id").collect())[:400] for lang in dictionaries}
    own = {lang: e.predict(t, 0.01) for lang, t in first.items()}
    assert all(own[lang][0] == lang and not own[lang][2] for lang in own)
    pairs = [(a, b) for a in first for b in first if a < b]
    mixed = [min(e.predict(first[a] + " " + first[b], 0.01)[1], e.predict(first[b] + " " + first[a], 0.01)[1]) for a, b in pairs]
    assert all(m < min(own[a][1], own[b][1]) for (a, b), m in zip(pairs, mixed))
    narrow = max(mixed) + 1e-9
    got = docs.sparkSession.createDataFrame([(first[a] + " " + first[b],) for a, b in pairs] + [(t,) for t in first.values()], "t string")
    rejected = [r.p.rejected for r in got.select(L.identify(F.col("t"), dictionaries, narrow).alias("p")).collect()]
    assert any(rejected[: len(pairs)]) and not all(rejected[len(pairs) :])

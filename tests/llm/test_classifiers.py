import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.langid import LEFT_OUT, identify_languages, train_languages
from tidemark.llm.queries import LLM_QUERIES
from tidemark.llm.toxicity import score_toxicity, train, without_toxic


def test_languages_held_out(spark, folder, documents):
    wanted = {d.doc_id: d.lang for d in documents}
    got = LLM_QUERIES["op5_language_id"](spark, folder).collect()
    assert len(got) == len(documents)
    held = [g for g in got if g.held_out]
    assert {g.doc_id for g in held} == {i for i in wanted if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(g.lang_pred == wanted[g.doc_id] for g in held if wanted[g.doc_id])
    assert right >= 0.95 * sum(wanted[g.doc_id] is not None for g in held)
    assert all(0 <= g.score <= 1 for g in got)


def test_languages_of_odd_texts(spark, odd_documents, no_documents):
    labelled = spark.createDataFrame(
        [(i, t, n) for i, (t, n) in enumerate([("the cat sat on the mat", "en"), ("die katze sass auf der matte", "de")] * 300)],
        "doc_id long, text string, lang string",
    )
    model = train_languages(labelled)
    texts = [None, "", " 12 ?!", "the mat", "der matte katze", "x" * 2_000_000, "漢字かな", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in identify_languages(docs, model).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert all(got[i].score == 0 for i in range(3)) and got[6].lang_pred in ("en", "de") and got[6].rejected
    assert identify_languages(odd_documents, model).count() == odd_documents.count()
    assert {r.lang_pred for r in identify_languages(docs, train_languages(no_documents)).collect()} == {"und"}
    assert identify_languages(no_documents, model).count() == 0


def test_languages_with_few_rows(spark):
    """One or two labelled rows, or none with a letter: no language swallows the others or vanishes."""
    english, german = "the cat sat on the mat and looked at the dog", "die katze sass auf der matte und sah den hund"
    rows = [(english, "en"), (german, "de")] * 60 + [("12 34 !?", "aa"), ("zqx", "bb"), ("kot pije mleko", "pl"), ("pies je chleb", "pl")]
    texts = {"the dog sat": "en", "der hund sass": "de", "kot je chleb": "pl", "zqx": "bb"}
    docs = spark.createDataFrame(list(enumerate([*texts, "漢字"])), "doc_id long, text string")
    for at in range(0, 60, 2):  # ids decide which rows could be left out
        labelled = spark.createDataFrame([(i + at * 1000, t, n) for i, (t, n) in enumerate(rows)], "doc_id long, text string, lang string")
        if at == 0 or labelled.filter(f"lang = 'bb' and pmod(xxhash64(doc_id, text, 6), {LEFT_OUT}) = 0").count():
            model = train_languages(labelled)
            got = {r.doc_id: r for r in identify_languages(docs, model).collect()}
            assert model.languages == ["bb", "de", "en", "pl"]
            assert [got[i].lang_pred for i in range(4)] == list(texts.values()) and got[4].rejected
            if at:
                break
    few = train_languages(labelled, grams_per_language=5)
    assert few.languages == ["bb", "de", "en", "pl"]


def test_toxicity_held_out(spark, folder):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [g for g in LLM_QUERIES["op8_toxicity"](spark, folder).collect() if g.held_out and g.doc_id in labels]
    assert sum(g.predicted == labels[g.doc_id] for g in got) >= 0.95 * len(got)
    toxic = [g for g in got if labels[g.doc_id]]
    assert sum(g.predicted for g in toxic) >= 0.9 * len(toxic)


def test_few_toxic_labels(spark, folder):
    """A dozen toxic labels still teach, and no text is lost for want of evidence."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {g.doc_id: g.predicted for g in LLM_QUERIES["op8_toxicity"](spark, folder).collect()}
    assert len(got) == docs.count()
    toxic = [got[i] for i, y in labels.items() if y == 1]
    clean = [got[i] for i, y in labels.items() if y == 0]
    assert sum(toxic) >= 0.5 * len(toxic) and sum(clean) <= 0.05 * len(clean)
    assert sum(got.values()) < 0.25 * len(got)
    kept = corpus_pipeline.toxicity(spark, docs, folder)
    assert 0.75 * len(got) < kept.count() < len(got)


def test_texts_without_known_terms_stay(spark):
    """Words of one text only are no terms: nothing is known then, and nothing goes."""
    docs = spark.createDataFrame([(i, f"only{i} word{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(60)], "doc_id long, toxic int")
    machine = train(docs.withColumn("text", F.regexp_replace("text", "[a-z]+", "")), labels)
    assert without_toxic(docs, machine).count() == 60
    assert {round(r.score, 6) for r in score_toxicity(docs, machine).collect()} == {round(1 / 6, 6)}


def test_pairs_count(spark):
    """Neither word alone is toxic, the pair is: no sum of single weights can tell."""
    cases = [("idiot alone", 0), ("group alone", 0), ("idiot group", 1), ("nothing here", 0)]
    rows = [(i, f"{cases[i % 4][0]} w{i % 7}", cases[i % 4][1]) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = train(docs, labels, rounds=300)
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, machine).collect()}
    assert got == {i: y for i, _, y in rows}


def test_pairs_of_words_equally_frequent_in_both_classes(spark):
    """Every word is as frequent in toxic as in clean texts; only pairs differ."""
    cases = [("those liars", 1), ("nice people", 1), ("those people", 0), ("nice liars", 0)]
    rows = [(i, f"{cases[i % 4][0]} day{i % 5} place{i % 3}", cases[i % 4][1]) for i in range(480)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = train(docs, labels)
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, machine).collect()}
    assert got == {i: y for i, _, y in rows}


def test_toxicity_of_odd_texts(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 0, "x"), (9, 1, "y"), (3, None, "z"), (None, 1, "z"), (2, 5, "z")], "doc_id long, toxic int, text string")
    machine = train(odd_documents, labels)
    got = score_toxicity(odd_documents, machine).collect()
    assert len(got) == odd_documents.count() and all(0 <= g.score <= 1 for g in got)
    kept = without_toxic(odd_documents, machine)
    assert kept.columns == odd_documents.columns
    assert kept.count() == sum(g.predicted == 0 for g in got)
    empty = train(no_documents, labels.limit(0))
    assert without_toxic(odd_documents, empty).count() == odd_documents.count()
    assert score_toxicity(no_documents, machine).count() == 0

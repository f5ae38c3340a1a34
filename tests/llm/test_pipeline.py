import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.sources.scratch import materialize

# Names that one stage or another uses inside.
CLASHING = ["_row", "row", "size", "source_size", "target", "copies", "component_id", "class", "kept", "label", "sequence_id"]


@pytest.fixture(scope="module")
def tables(spark, folder, tmp_path_factory):
    """Folders of tables: as given with odd rows and clashing columns added, and empty ones."""
    root = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "same old words in a row here", "en", "src1", 1), (1, "", None, None, None),
         (1, "another text of a known id, quite unlike it", "en", "src2", 3), (2, None, "en", None, 0)],
        docs.schema,
    )
    all_docs = docs.unionByName(odd).unionByName(docs.limit(20))
    for c in CLASHING:
        all_docs = all_docs.withColumn(c, F.lit(f"{c}!"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for name, d, x in (("odd", all_docs, labels), ("empty", docs.limit(0), labels.limit(0)), ("unlabelled", all_docs, labels.limit(0))):
        d.write.parquet(f"{root}/{name}/documents.parquet")
        x.write.parquet(f"{root}/{name}/labels.parquet")
    return root


@pytest.mark.parametrize("name", ["odd", "empty", "unlabelled"])
def test_stages_keep_columns_and_take_effect(spark, tables, name):
    docs = spark.read.parquet(f"{tables}/{name}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for stage, run in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(run(spark, docs, f"{tables}/{name}"), f"test_{stage}")
        counts.append(docs.count())
        if stage == "packing":
            continue
        assert docs.columns == columns
        for c in CLASHING if name != "empty" else []:
            assert [r[0] for r in docs.select(f"`{c}`").distinct().collect()] == [f"{c}!"]
        if stage != "mixing":
            # A stage that filters keeps rows as they are.
            assert docs.exceptAll(before).isEmpty()
        if stage == "exact_dedup":
            squeezed = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
            assert before.select(squeezed.alias("t")).distinct().count() == docs.count()
    if name == "empty":
        assert set(counts) == {0}
    else:
        assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0
        packed = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"))
        assert packed.filter("n > 2048").isEmpty()


def test_run_packs_what_the_mix_takes(spark, tables):
    out = corpus_pipeline.run(spark, f"{tables}/odd")
    whole = out.groupBy("doc_id", "doc_tokens").agg((F.sum("length") % F.col("doc_tokens")).alias("rest"))
    assert out.count() > 0 and whole.filter("rest <> 0").isEmpty()

import hashlib
import re

import pytest

from tidemark.llm.exact_dedup import _again, _chunks, _colliding, _recipes, exact_groups, without_copies

WHITE = re.compile(r"[\x20\x09-\x0D]")


def _check(docs, **how):
    rows = docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(WHITE.sub("", r.text or ""), []).append(r)
    best = {
        t: min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id for t, g in groups.items()
    }
    got = exact_groups(docs, **how).collect()
    want = sorted(
        ((r.doc_id, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for r in g), key=repr
    )
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=repr) == want
    assert sum(g.kept for g in got) == len(groups)
    assert all(g.doc_id == g.keep_id for g in got if g.kept)


def test_documents(spark, folder):
    _check(spark.read.parquet(f"{folder}/documents.parquet"))


# A digest of one byte has many contents: recipes then need the ordinals.
@pytest.mark.parametrize("digest_bytes", [1, 16])
def test_digests_that_collide(spark, digest_bytes):
    rows = [(i, f"text number {i % 300}" + " " * (i % 7)) for i in range(900)]
    _check(spark.createDataFrame(rows, "doc_id long, text string"), digest_bytes=digest_bytes)


# A filter of few bits lets all bytes through; the groups are the same.
@pytest.mark.parametrize("filter_bits", [1, 9, 1 << 15, 1 << 27])
def test_filters_of_any_size(spark, filter_bits):
    rows = [(i, f"text number {i % 250}") for i in range(400)]
    _check(spark.createDataFrame(rows, "doc_id long, text string"), digest_bytes=2, filter_bits=filter_bits)


def test_bytes_move_only_for_digests_that_occur_again(spark, tmp_path):
    """Texts without copies send none to be verified, and a common one sends one row a task."""
    alone = spark.createDataFrame([(i, f"text number {i}") for i in range(500)], "row long, text string")
    copies = spark.createDataFrame([(500 + i, "the same text") for i in range(500)], "row long, text string")
    for docs, parts in ((alone, 0), (alone.unionByName(copies).repartition(4), 1)):
        numbered = docs.withColumn("doc_id", docs.row)
        recipes = _recipes(numbered, 16)
        assert _again(recipes, 16, 1 << 27).count() == parts
        assert _colliding(numbered, recipes, 16, 1 << 27).count() == 0


def test_odd_documents(spark, odd_documents, tmp_path):
    _check(odd_documents)
    odd_documents.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({WHITE.sub("", r.text or "") for r in docs.collect()})


def test_cuts_follow_the_content():
    text = b"".join(hashlib.sha256(str(i).encode()).hexdigest().encode() for i in range(4000))
    chunks = _chunks(text)
    assert b"".join(chunks) == text and 40 < len(chunks) < 400
    moved = _chunks(b"something in front" + text)
    assert len(set(chunks) & set(moved)) > 0.9 * len(chunks)
    assert b"".join(_chunks(b"a" * 500_000)) == b"a" * 500_000
    assert max(map(len, _chunks(b"a" * 500_000))) <= 1 << 16


def test_nothing(no_documents):
    assert exact_groups(no_documents).count() == 0


def test_another_split_of_the_input(spark, tmp_path):
    """Rows are told apart by one numbering, however a later scan cuts the files."""
    rows = [(i, f"text number {i % 150}") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    setting = "spark.sql.files.minPartitionNum"
    for size in (1, 16):
        try:
            spark.conf.set(setting, "1")
            kept = without_copies(docs, size)
            spark.conf.set(setting, "8")
            got = [r.text for r in kept.collect()]
        finally:
            spark.conf.unset(setting)
        assert sorted(got) == sorted({t for _, t in rows})

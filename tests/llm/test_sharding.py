from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.queries import LLM_QUERIES
from tidemark.llm.sharding import first_labels, propagate, shard_documents

def text_link():
    return F.coalesce(F.col("text"), F.lit(""))


def check_law(rows, shards):
    """Counts at most one apart, and slots gapless from 0."""
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert set(slots) <= set(range(shards))
    assert max(counts) - min(counts) <= 1
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    return counts


def shards_of(rows, key):
    found = defaultdict(set)
    for r in rows:
        found[r[key]].add(r["shard"])
    return found


def linked(spark, sizes):
    return spark.createDataFrame(
        [(f"k{g}", f"d{g}-{i}") for g, n in enumerate(sizes) for i in range(n)], "key string, name string"
    )


def test_links_stay_together_among_single_documents(spark):
    docs = linked(spark, [2] * 40 + [7] * 5 + [1] * 200)
    out = shard_documents(docs, F.col("key"), shards=6).collect()
    check_law(out, 6)
    assert Counter(r["name"] for r in out) == Counter(r["name"] for r in docs.collect())
    cut = [k for k, s in shards_of(out, "key").items() if len(s) > 1]
    assert cut == []


def test_a_hot_link_fills_no_more_shards_than_it_must(spark):
    docs = linked(spark, [400] + [3] * 60 + [1] * 620)
    out = shard_documents(docs, F.col("key"), shards=24).collect()
    counts = check_law(out, 24)
    assert sum(counts) == 1200
    found = shards_of(out, "key")
    # 400 / 50 = 8 shards at best; links that settled there first keep their places.
    assert len(found["k0"]) <= 10
    assert sum(len(s) > 1 for k, s in found.items() if k != "k0") <= 3


def test_quotas_hold_when_every_document_is_linked(spark):
    """No free room at all: only swaps can bring links together."""
    docs = linked(spark, [2] * 120)
    out = shard_documents(docs, F.col("key"), shards=5, rounds=12).collect()
    check_law(out, 5)
    cut = sum(len(s) > 1 for s in shards_of(out, "key").values())
    assert cut <= 30  # dealt in turn, all 120 are cut


def test_no_round_breaks_a_capacity(spark):
    links = spark.createDataFrame([(f"k{i}".encode(), 2 + i * i % 13) for i in range(50)], "link binary, n long")
    total = sum(2 + i * i % 13 for i in range(50))
    start = {r["shard"]: r["n"] for r in first_labels(links, 7).groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    assert max(start.values()) - min(start.values()) <= 1
    for rounds in (1, 2, 5):
        cells = propagate(links, F.lit(total).cast("long"), 7, rounds).collect()
        loads, whole = Counter(), Counter()
        for c in cells:
            loads[c["shard"]] += c["n"]
            whole[c["link"]] += c["n"]
        assert all(n <= total // 7 + (s < total % 7) for s, n in loads.items())
        assert {bytes(k): n for k, n in whole.items()} == {f"k{i}".encode(): 2 + i * i % 13 for i in range(50)}


def test_odd_documents_and_empty_tables(odd_documents, no_documents):
    out = shard_documents(odd_documents, text_link(), shards=4).collect()
    assert len(out) == odd_documents.count()
    check_law(out, 4)
    assert shard_documents(no_documents, text_link(), shards=4).collect() == []
    nulls = shard_documents(odd_documents, F.lit(None).cast("string"), shards=3).collect()
    check_law(nulls, 3)
    more = shard_documents(odd_documents, text_link(), shards=100).collect()
    assert sorted(r["slot"] for r in more) == [0] * len(more)


def test_helper_names_are_refused(odd_documents):
    with pytest.raises(ValueError, match="slot"):
        shard_documents(odd_documents.withColumn("slot", F.lit(1)), text_link())


def test_query_places_every_document(spark, folder, documents):
    df = LLM_QUERIES["op12_sharding"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    out = df.collect()
    check_law(out, 24)
    import zlib

    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in documents)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    text = {d["doc_id"]: d["text"] or "" for d in documents}
    groups = defaultdict(set)
    for r in out:
        groups[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in groups.values()) == 0

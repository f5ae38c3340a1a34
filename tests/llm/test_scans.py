import re

from pyspark.sql import functions as F

from tidemark.llm.licenses import BASE_PHRASES, scan_licenses
from tidemark.llm.queries import LLM_QUERIES, list_entries
from tidemark.llm.url_filters import filter_urls, list_intervals, url_host, url_patterns

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = [
        (i, label)
        for phrase, label in BASE_PHRASES
        for p in [phrase.split()]
        for i in range(len(words) - len(p) + 1)
        if words[i : i + len(p)] == p
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({x for _, x in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def _check(docs):
    want = sorted(((r.doc_id, *_base(r.text)) for r in docs.collect()), key=repr)
    got = scan_licenses(docs).collect()
    assert sorted(((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got), key=repr) == want
    for g in got:
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1
    return {g.doc_id: g for g in got}


def test_licenses_of_documents(spark, folder):
    got = _check(spark.read.parquet(f"{folder}/documents.parquet"))
    assert any(g.n_base for g in got.values())


def test_licenses_of_odd_texts(spark, odd_documents):
    _check(odd_documents)
    texts = [
        "under the MIT license, under the mit license! cc-by NC",
        "permission is hereby granted free of ANY charge to any person obtaining a copy of this software",
        "You may not use this file except in full compliance with the license",
        "may file license the use compliance not",
        "apache license version 2" * 3 + " apache license version 2.0",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = _check(docs)
    assert got[0].labels == "cc-by-nc,mit" and got[0].n_base == 3
    assert got[1].labels == "mit" and got[1].n_base == 0
    assert got[2].labels == "apache-2" and got[3].labels == ""
    assert scan_licenses(docs.limit(0)).count() == 0


def test_license_plan_has_no_python(spark, folder):
    plan = LLM_QUERIES["op10_license_scan"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _judge(patterns, day, log):
    best = None
    for p in patterns or []:
        held = [e for e in log.get(p, []) if e[0] <= day]
        if held:
            last = max(held)[0]
            action = min(a for d, a in held if d == last)
            if action in ("block", "allow") and (best is None or (-len(p), p) < (-len(best[0]), best[0])):
                best = (p, action)
    return best


def test_urls_against_brute_force(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    log = {}
    for e in list_entries(pages).collect():
        log.setdefault(e.pattern, []).append((e.listed_on, e.action))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 13 % 365).cast("int"))
    asked = pages.select("page_id", url_patterns(F.col("url")).alias("p"), day.alias("day")).collect()
    got = {g.page_id: g for g in LLM_QUERIES["op1_url_filters"](spark, folder).collect()}
    assert len(got) == len(asked)
    for a in asked:
        best = _judge(a.p, a.day, log)
        assert (got[a.page_id].pattern, got[a.page_id].action) == (best or (None, None))
        assert got[a.page_id].blocked == bool(best and best[1] == "block")


def test_odd_urls_and_lists(spark):
    captures = spark.createDataFrame(
        [(1, "HTTP://User@A.Example.com:80/x/y?q#f", 5), (2, None, 5), (3, "no url", 5), (4, "http://b.org", None), (5, "http://a.example.com/x", 1),
         (6, "http://a.example.com/z", 9), (None, "http://b.org/", 9), (1, "HTTP://User@A.Example.com:80/x/y?q#f", 5)],
        "capture_id long, url string, fetched_on int",
    ).withColumn("pattern", F.lit("clash"))
    entries = spark.createDataFrame(
        [("example.com", 2, "block"), ("a.example.com/x", 4, "allow"), ("a.example.com/x", 4, "block"), ("example.com", 8, "remove"),
         (None, 1, "block"), ("b.org", None, "block"), ("b.org", 3, "block"), ("b.org", 3, "block")],
        "pattern string, listed_on int, action string",
    )
    got = sorted(((g.capture_id, g.host, g.pattern, g.action, g.valid_from, g.valid_to, g.blocked) for g in filter_urls(captures, entries).collect()), key=repr)
    assert (1, "a.example.com", "a.example.com/x", "allow", 4, None, False) in got and len(got) == 8
    assert (5, "a.example.com", None, None, None, None, False) in got
    assert (6, "a.example.com", None, None, None, None, False) in got
    assert (4, "b.org", None, None, None, None, False) in got and (3, None, None, None, None, None, False) in got
    assert (None, "b.org", "b.org", "block", 3, None, True) in got
    spans = {(i.pattern, i.valid_from): (i.action, i.valid_to) for i in list_intervals(entries).collect()}
    assert spans[("example.com", 2)] == ("block", 8) and spans[("a.example.com/x", 4)] == ("allow", None)
    assert filter_urls(captures.limit(0), entries).count() == 0
    assert not any(g.blocked for g in filter_urls(captures, entries.limit(0)).collect())
    assert spark.range(1).select(url_host(F.lit("https://x.Y./p"))).first()[0] == "x.y"


def test_captures_that_share_an_id_are_judged_alone(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.org/", 5), (1, "http://b.org/", 5), (None, "http://a.org/", 5), (None, "http://b.org/", 5), (1, "http://b.org/", 2)],
        "capture_id long, url string, fetched_on int",
    )
    entries = spark.createDataFrame([("b.org", 3, "block")], "pattern string, listed_on int, action string")
    got = sorted(((g.capture_id, g.host, g.blocked) for g in filter_urls(captures, entries).collect()), key=repr)
    assert got == sorted([(1, "a.org", False), (1, "b.org", True), (None, "a.org", False), (None, "b.org", True), (1, "b.org", False)], key=repr)

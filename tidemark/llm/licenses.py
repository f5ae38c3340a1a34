"""License scans by diagonal voting, in DataFrame functions only.

Texts become words, words become rolling k-grams, and their hashes are joined to
the places of the same k-grams in known notices. A match at word i of a text and
word j of a notice votes for the diagonal i - j. One diagonal with a vote for every
k-gram of the notice is a verbatim place. Votes of neighbouring diagonals, which
differ by a few words put in or left out, are merged, and the merged spans are
verified by the share of the notice's k-grams they cover and by their length. Texts
are read once: each also votes for a notice that does not exist, which brings its id
and its number of words along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

# What a word is, and the phrases and labels to find verbatim.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Public notices, found also with small changes. Each stands for one label.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
]
GRAM = 3
# Words put in or left out between two votes of one span.
DRIFT = 2
# A k-gram of this no-word stands once in every text, so that each text comes through
# the votes, with or without a license, and the texts are read once.
NO_WORD, NO_TEMPLATE = "\0", -1
# Share of a notice's k-grams a span must cover, and its length in notices.
COVER = 0.6
LONGEST = 1.5


def template_grams(spark: SparkSession, width: int) -> DataFrame:
    """(template, label, base, places, length, gram, place): a fixed table of some hundred rows."""
    rows = []
    for number, (phrase, label, base) in enumerate(
        [(p, n, True) for p, n in BASE_PHRASES] + [(p, n, False) for p, n in NOTICES]
    ):
        words = phrase.split()
        places = len(words) - width + 1
        rows += [(number, label, base, places, len(words), words[i : i + width], i) for i in range(places)]
    rows.append((NO_TEMPLATE, None, False, 1, width, [NO_WORD] * width, 0))
    table = spark.createDataFrame(
        rows, "template int, label string, base boolean, places int, length int, words array<string>, place int"
    )
    hashed = F.xxhash64(*[F.col("words")[i] for i in range(width)])
    return table.withColumn("gram", hashed).withColumns({f"w{i}": F.col("words")[i] for i in range(width)}).drop("words")


def license_votes(docs: DataFrame, width: int = GRAM) -> DataFrame:
    """Votes (doc, template, ..., place, at) of `docs(doc, words)`: k-grams that are equal word by word.

    Every text also has one vote for `NO_TEMPLATE`. `doc` may be a struct.
    """
    count = F.greatest(F.size("words") - (width - 1), F.lit(0))
    grams = [F.slice("words", F.lit(i + 1), count) for i in range(width)]
    zipped = F.arrays_zip(*[F.concat(g, F.array(F.lit(NO_WORD))).alias(f"d{i}") for i, g in enumerate(grams)])
    rolled = docs.select("doc", F.posexplode(zipped).alias("at", "g")).select("doc", "at", "g.*")
    hashed = rolled.withColumn("gram", F.xxhash64(*[f"d{i}" for i in range(width)]))
    known = template_grams(docs.sparkSession, width)
    # The notices are a fixed list in this module, so this side has a fixed size.
    met = hashed.join(F.broadcast(known), "gram")
    for i in range(width):
        met = met.filter(F.col(f"d{i}") == F.col(f"w{i}"))
    return met.select("doc", "template", "label", "base", "places", "length", "place", "at")


def license_spans(votes: DataFrame, drift: int = DRIFT, cover: float = COVER, longest: float = LONGEST) -> DataFrame:
    """Verified spans (doc, template, label, base, verbatim, first_word, last_word, score) of the votes."""
    votes = votes.withColumn("diagonal", F.col("at") - F.col("place"))
    lines = votes.groupBy("doc", "template", "label", "base", "places", "length", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.min("place").alias("first_place"),
        F.max("place").alias("last_place"),
    )
    # A diagonal goes on from the one before if it is near and further along in the notice.
    order = W.partitionBy("doc", "template").orderBy("diagonal", "first_at")
    goes_on = (
        (F.col("diagonal") - F.lag("diagonal").over(order) <= drift)
        & (F.lag("votes").over(order) < F.col("places"))
        & (F.col("votes") < F.col("places"))
        & ~F.col("base")
    )
    started = lines.withColumn("new", F.when(goes_on, 0).otherwise(1))
    spans = started.withColumn("span", F.sum("new").over(order)).groupBy(
        "doc", "template", "label", "base", "places", "length", "span"
    ).agg(
        F.sum("votes").alias("votes"),
        F.min("first_at").alias("first_word"),
        F.max("last_at").alias("last_at"),
        F.max((F.col("votes") == F.col("places")).cast("int")).alias("verbatim"),
    )
    width = F.col("length") - F.col("places") + 1
    score = F.least(F.lit(1.0), F.col("votes") / F.col("places"))
    last_word = F.col("last_at") + width - 1
    fits = (last_word - F.col("first_word") + 1) <= F.col("length") * longest
    return spans.filter((F.col("verbatim") == 1) | (~F.col("base") & (score >= cover) & fits)).select(
        "doc", "template", "label", "base", (F.col("verbatim") == 1).alias("verbatim"), "first_word",
        last_word.alias("last_word"), score.alias("score"),
    )


def scan_licenses(docs: DataFrame, width: int = GRAM) -> DataFrame:
    """One row per row of `docs(doc_id, text)` with its license places and labels.

    Returns doc_id, n_words, n_base (verbatim places of the base phrases), first_word
    and last_word (their smallest and largest start; NULL without any), base_labels,
    labels (both distinct, sorted, joined by commas; empty without any) and score (the
    best share of a notice that a span covers, 1 with a base place, else 0 at least).
    NULL texts count as empty. Rows are told apart as they are read, so equal rows and
    rows without doc_id keep results of their own. Other columns are ignored; an empty
    table gives an empty result.
    """
    lowered = F.translate(
        F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    read = docs.select("doc_id", F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words")).select(
        F.struct(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words")).alias("doc"),
        "words",
    )
    spans = license_spans(license_votes(read, width))
    verbatim = F.col("base") & F.col("verbatim")
    found = spans.groupBy("doc").agg(
        F.count(F.when(verbatim, 1)).alias("n_base"),
        F.min(F.when(verbatim, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(verbatim, F.col("first_word"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(verbatim, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(F.col("template") != NO_TEMPLATE, F.col("score"))).alias("score"),
    )
    return found.select(
        "doc.doc_id",
        "doc.n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        "labels",
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )

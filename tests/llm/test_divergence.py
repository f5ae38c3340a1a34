import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from compare import difference, duck

from tidemark.llm import divergence
from tidemark.llm.divergence import GAP, Piece, audit_sources, frequencies, heap_merge, word_frequencies, words_of
from tidemark.llm.queries import LLM_ORACLES, LLM_QUERIES

UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def brute(rows, least_docs, most_terms):
    """(lang, source, part, item, value, rank) by the definition, over all words of a language."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = words(text)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    kept = {lang: [w for w, n in c.items() if n >= least_docs] for lang, c in docs.items()}

    def rates(lang, tally):
        n, v = sum(tally[w] for w in kept[lang]), len(kept[lang])
        return {w: 1 + int(Fraction(10**9 * (tally[w] + 2), n + 2 * v)) for w in kept[lang]}

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    out = set()
    for lang, source in groups:
        p = rates(lang, counts[lang, source])
        total = rates(lang, sum((counts[g] for g in groups if g[0] == lang), Counter()))
        others = [s for g, s in groups if g == lang and s != source]
        pairs = [(s, sum(f(p[w], q) for w, q in rates(lang, counts[lang, s]).items())) for s in others]
        terms = [(w, f(p[w], q)) for w, q in total.items() if counts[lang, source][w] and p[w] > q]
        for part, found, most in (("pair", pairs, None), ("term", terms, most_terms)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


def audited(df, **options):
    rows = [tuple(r) for r in audit_sources(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_brute_force_with_many_runs_and_squares(spark, documents, monkeypatch):
    """Blocks of a few words, pieces of three, four sources a row, few sums kept open."""
    for name, value in {"PIECE": 3, "STRETCH": 5, "SIDE": 4, "COUNTS": 2, "PAIRS": 50, "OPEN_PAIRS": 3}.items():
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence, "WORD_BYTES", (1 << 20) // 50)
    rows = [((d["text"] or "")[:400], d["lang"], d["source"]) for d in documents]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert audited(df, least_docs=3, most_terms=4, block_mb=1) == brute(rows, 3, 4)


def test_query_equals_its_sql(spark, folder):
    problem = difference(LLM_QUERIES["op11_source_audit"](spark, folder), duck(folder), LLM_ORACLES["op11_source_audit"])
    assert problem is None


def test_odd_documents_and_empty_tables(spark, odd_documents, no_documents):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd_documents.collect()]
    assert audited(odd_documents, least_docs=2) == brute(rows, 2, 10)
    # No word is in ten documents: every pair is there, with value 0.
    none = audited(odd_documents, least_docs=10)
    assert none == brute(rows, 10, 10) and {x[4] for x in none} == {0}
    assert audited(no_documents) == set()


def test_hot_source_and_hot_word(spark):
    rows = [("the " * 50 + f"w{chr(97 + i % 20)}", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audited(df) == brute(rows, 10, 10)


def test_frequencies_ignore_how_blocks_fall(spark, documents, monkeypatch):
    df = spark.createDataFrame(documents).select("text", "lang", "source")

    def lists():
        found = word_frequencies(df, 5).collect()
        return {(r["lang"], r["term"]): dict(zip(r["sources"], r["counts"])) for r in found}

    whole = lists()
    monkeypatch.setattr(divergence, "WORD_BYTES", 128 * (1 << 20) // 300)
    assert lists() == whole


def test_heap_merge_keeps_a_key_in_one_list(monkeypatch):
    monkeypatch.setattr(divergence, "STRETCH", 2)
    runs = [[(1, "acegik"), (2, "bd")], [(1, "abcdxyz")], [(2, "bz")], [(1, "k")]]
    pieces = []
    for number, run in enumerate(runs):
        for shard, letters in run:
            for i in range(0, len(letters), 2):
                keys = [bytes([shard]) + c.encode() for c in letters[i : i + 2]]
                n = len(keys)
                pieces.append((shard, keys[0], number, keys, [1] * n, range(1, n + 1), [f"s{number}"], [0] * n, [2] * n))
    pieces.sort(key=lambda p: p[:3])
    lists = list(heap_merge(Piece(*p) for p in pieces))
    found = [(key, dict(zip(names, counts))) for x in lists for key, names, counts in frequencies(x, 1)]
    want = defaultdict(dict)
    for number, run in enumerate(runs):
        for shard, letters in run:
            for c in letters:
                want[bytes([shard]) + c.encode()][f"s{number}"] = 2
    assert len(lists) > 2
    assert len(found) == len(want) and dict(found) == want
    twice = [key for x in lists for key, *_ in frequencies(x, 2)]
    assert sorted(twice) == sorted(k for k, v in want.items() if len(v) > 1)


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64])
def test_steps_cut_no_word(step, monkeypatch):
    monkeypatch.setattr(divergence, "STEP", step)
    text = "Étude of the WORDS, aé中\U0001f600b--c 12x3 end".encode()
    found = [w.decode() for part in words_of(text, divergence._table()) for w in part]
    assert found == words(text.decode())
    assert GAP.search(b"a b").start() == 1


def test_exact_beyond_doubles(spark):
    """Counts whose products pass 2**53."""
    from pyspark.sql import functions as F

    a, n, v = 123_456_789_012, 98_765_432_109_876, 12_345
    row = spark.range(1).select(
        divergence._rate(F.lit(a).cast("long"), F.lit(n).cast("long"), F.lit(v).cast("long")).alias("p")
    ).first()
    assert row["p"] == 1 + 10**9 * (a + 2) // (n + 2 * v)

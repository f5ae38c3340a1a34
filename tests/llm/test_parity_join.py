import itertools
import random

import numpy as np
import pytest

from tidemark.llm.components import components
from tidemark.llm.parity_join import _entries, bands, jaccard_links, one_of_each
from tidemark.llm.words import mix, separators, shingle_sets, word_hashes


def _set(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def _brute(rows, width, percent):
    sets = {}
    for r in rows:
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, set()).add(_set(r.text, width))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        for s, t in itertools.product(sets[a], sets[b]):
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted(
        ((r.doc_id, len(_set(r.text, width)), None if r.doc_id is None else find(r.doc_id)) for r in rows), key=repr
    )


def _got(docs, width, percent):
    return sorted((tuple(r) for r in jaccard_links(docs, width, percent).collect()), key=repr)


@pytest.fixture(scope="module")
def edited(spark):
    """Families of texts with a few edits, chains, and strangers that share a long passage."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for family in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([6, 9, 15, 40, 90, 200, 400]))]
        for _ in range(10):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(text)
            if rng.random() < 0.3:
                base = text
    for _ in range(40):
        rows.append(passage + [rng.choice(words) for _ in range(rng.randint(5, 80))])
    rng.shuffle(rows)
    return spark.createDataFrame([(i * 3, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_links_against_brute_force(edited, width, percent):
    assert _got(edited, width, percent) == _brute(edited.collect(), width, percent)


def test_documents(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert _got(docs, 4, 85) == _brute(documents, 4, 85)


def test_odd_documents(odd_documents):
    assert _got(odd_documents, 4, 85) == _brute(odd_documents.collect(), 4, 85)
    kept = one_of_each(odd_documents, 4, 85)
    assert kept.columns == odd_documents.columns
    # 2, the second 1 and one row without doc_id copy 1, and 7 nearly copies 6.
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 6, 8, 9]
    assert [r.text for r in kept.filter("doc_id is null").collect()] == [None]


def test_two_texts_of_one_id(spark):
    """As documents they are one; of near copies one text each must stay."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(1, a), (5, [*a, "more"]), (5, b), (9, [*b, "more"]), (None, [*b, "less"]), (None, ["alone"])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    assert _got(docs, 4, 85) == _brute(docs.collect(), 4, 85)
    assert {r.doc_id: r.component_id for r in jaccard_links(docs, 4, 85).collect() if r.doc_id} == {1: 1, 5: 1, 9: 1}
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(docs, 5, 80).collect()), key=repr)
    assert kept == sorted([(1, " ".join(a)), (5, " ".join(b)), (None, "alone")], key=repr)


def test_nothing(no_documents):
    assert jaccard_links(no_documents).count() == 0


def test_linked_sets_share_enough_kept_blocks():
    """The pigeonhole bound, on random pairs at the threshold."""
    rng = np.random.default_rng(5)
    for percent in (80, 85):
        for _ in range(300):
            size = int(rng.integers(6, 700))
            base = np.unique(mix(rng.integers(0, 2**62, size).astype(np.uint64)))
            gone = int(rng.integers(0, len(base) * (100 - percent) // 100 + 1))
            other = np.sort(rng.permutation(base)[: len(base) - gone])
            both = len(np.intersect1d(base, other))
            union = len(base) + len(other) - both
            if 100 * both < percent * union or both == union:
                continue
            keys, names = _entries(np.concatenate((base, other)), np.array([len(base), len(other)]), np.array([1, 2]), percent)
            shared = np.intersect1d(keys[names == 1], keys[names == 2])
            needed = {int(k) & 63: bands(percent)[int(k) & 63][2] for k in shared}
            counts = {b: sum((int(k) & 63) == b for k in shared) for b in needed}
            assert any(counts[b] >= needed[b] for b in needed)


def test_words_and_shingles():
    texts = [b"A b  c\nd e", None, b"", b" \t", "Été x".encode(), b"y" * 200_000 + b" a B c d e", b"a b c d e"]
    hashes, counts = word_hashes(texts, separators())
    assert counts.tolist() == [5, 0, 0, 0, 2, 6, 5]
    assert hashes[:5].tolist() == hashes[-5:].tolist() == hashes[8:13].tolist()
    _, sizes = shingle_sets(texts, 4, separators())
    assert sizes.tolist() == [2, 0, 0, 0, 1, 3, 2]
    assert shingle_sets([b"a b"], 4, separators())[1].tolist() == [1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1064)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.packing import pack_documents, pack_examples

PATH = public_tokenizers.path("word_bpe_49k.json")


def _ids(text):
    tokenizer = Tokenizer.from_file(PATH)
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def _check(pieces, wanted, limit):
    by_text = {}
    sequences = {}
    for p in pieces:
        by_text.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    got = []
    for (doc_id, total), parts in by_text.items():
        parts.sort(key=lambda p: p.start)
        got.append((doc_id, sum(p.length for p in parts), b"".join(p.ids for p in parts)))
        assert all(len(p.ids) == 4 * p.length for p in parts)
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
    return sequences


def _bytes(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_documents_come_back_whole(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pieces = pack_documents(docs, PATH).collect()
    wanted = [(d.doc_id, len(i), _bytes(i)) for d in documents for i in [_ids(d.text)]]
    sequences = _check(pieces, wanted, 2048)
    total = sum(p.length for p in pieces)
    sizes = [sum(p.length for p in s) for s in sequences.values()]
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert padding < 0.02 * total
    assert [zlib.crc32(p.ids) for p in pieces]


def test_odd_documents(odd_documents):
    rows = odd_documents.collect()
    pieces = pack_documents(odd_documents, PATH).collect()
    # Equal rows give equal pieces twice.
    wanted = {}
    for r in rows:
        i = _ids(r.text)
        key = (r.doc_id, len(i))
        wanted[key] = wanted.get(key, 0) + len(i)
    got = {}
    for p in pieces:
        got[(p.doc_id, p.doc_tokens)] = got.get((p.doc_id, p.doc_tokens), 0) + p.length
    assert got == wanted


def test_all_limits_hold(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 120)), int(rng.integers(0, 60))) for i in range(3000)]
    rows += [(9001, 500, 1), (9002, None, 1), (9003, 5, None), (None, 3, 3), (None, 3, 3)]
    examples = spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss_tokens long")
    packed = pack_examples(examples, max_tokens=256, max_segments=8, max_loss_tokens=128).collect()
    assert len(packed) == len(rows)
    assert {p.example_id for p in packed if p.sequence_id is None} == {9001, 9002, 9003}
    sequences = {}
    for p in packed:
        if p.sequence_id is not None:
            sequences.setdefault(p.sequence_id, []).append(p)
    for parts in sequences.values():
        assert len(parts) <= 8 and sum(p.n_loss_tokens for p in parts) <= 128
        assert sum(p.n_tokens for p in parts) <= 256
        at = 0
        for p in sorted(parts, key=lambda p: (p.offset, p.n_tokens)):
            assert p.offset == at
            at += p.n_tokens
    # No more than a few per cent above the bound of the tightest limit.
    total = [sum(p.n_tokens for p in packed if p.sequence_id is not None) / 256, (len(rows) - 3) / 8]
    total.append(sum(p.n_loss_tokens for p in packed if p.sequence_id is not None) / 128)
    assert len(sequences) <= 1.08 * max(total) + 4


@pytest.mark.parametrize("text", ["It's I'LL he'd", "A.B,c;; d... eé.", "İstanbul K  x\x1cy", "n1m22", "». ».."])
def test_words_alone_have_the_ids_of_the_text(text):
    from tidemark.llm.packing import WordTokens

    assert WordTokens(PATH).encode([text.encode()])[0] == _bytes(_ids(text)[:-1])


def test_nothing(no_documents):
    assert pack_documents(no_documents, PATH).count() == 0


@pytest.mark.parametrize("text", [None, "ab cd", "ab cd ef gh"])
def test_many_tiny_documents_are_packed_tightly(spark, text):
    """One token (the end id) to five a document, so hundreds to thousands share a sequence."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(text).cast("string").alias("text")).coalesce(1)
    pieces = pack_documents(docs, PATH).select("doc_id", "start", "length", "sequence_id", "offset").collect()
    sizes = Counter()
    for p in pieces:
        sizes[p.sequence_id] += p.length
    padding = sum(2048 - n for n in sizes.values() if n & (n - 1))
    assert padding <= 0.03 * sum(sizes.values())
    assert max(sizes.values()) <= 2048
    again = pack_documents(docs, PATH).select("doc_id", "start", "length", "sequence_id", "offset").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, pieces))

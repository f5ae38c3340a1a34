"""How the sources of a language differ in words: single-pass in-memory indexing.

Each task reads its documents once and counts, in memory, how often every word
stands in every (lang, source) and in how many documents of the language. When the
block is full it is spilled as a run: entries sorted by hash shard and word, cut
into pieces of bounded length. A shard's pieces, from all runs, arrive in the order
of their first entries and are merged through a heap that holds only pieces which
overlap, so neither side holds more than its block. What comes out is one
frequency list per word of a language.

Sums over all words of a language are then formed without touching the many words
that a source lacks. With f the per-word term, p a word's rate in a source and p0
the rate of a word it lacks,

    sum f(p, q) = V f(p0, q0)
                + sum over words of the one source of f(p, q0) - f(p0, q0)
                + the same for the other source
                + sum over shared words of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The first two kinds follow from how often each count occurs in a source; only the
last, the pair corrections, is streamed from the lists, into sums that are handed on
when too many are open. Rates are whole numbers and all
arithmetic is exact up to 10**14 words in a language.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

WORD = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
# Bytes of a text cut into words at a time.
STEP = 1 << 20
# Bytes held for a word of a block and for one place where it stands.
WORD_BYTES, POSTING_BYTES = 200, 8
# Words in a piece of a run, and words of merged pieces that are added up at a time.
PIECE, STRETCH = 2048, 1 << 16
# Sources of a language in one row, when others meet them.
SIDE = 256
# Pairs of sources compared at a time, and pairs whose sums are held before they are handed on.
PAIRS, OPEN_PAIRS = 1 << 20, 1 << 19
# Counts of a source in one row, when they meet the other sources.
COUNTS = 4096
# No valid UTF-8 text holds this byte, so it parts word and language.
PART = b"\xff"

RUNS = (
    "shard int, first binary, run long, keys array<binary>, docs array<long>, ends array<int>, "
    "names array<string>, sources array<int>, counts array<long>"
)
LISTS = "lang string, term string, total long, sources array<string>, counts array<long>"


def _table() -> bytes:
    """A-Z to lower case, every byte that parts words to a blank."""
    blank = [GAP.match(bytes([b])) is not None for b in range(256)]
    return bytes(b + 32 if 65 <= b <= 90 else 32 if blank[b] else b for b in range(256))


def words_of(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """Lists of a text's words, a step of the text at a time; no word is cut."""
    at, end = 0, len(text)
    while at < end:
        stop = min(at + STEP, end)
        if stop < end:
            gap = GAP.search(text, stop)
            stop = gap.start() if gap else end
        yield text[at:stop].translate(table).split()
        at = stop


# ---- runs ----


class _Numbers(dict):
    """Numbers things in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Block:
    """Postings of one block: per language the numbers of the words in every text, and who said them."""

    def __init__(self) -> None:
        self.words: dict[str, _Numbers] = {}
        self.sources = _Numbers()
        # Per language: arrays of word numbers, of distinct ones per text, and (source, length) of the former.
        self.found: dict[str, list[np.ndarray]] = {}
        self.met: dict[str, list[np.ndarray]] = {}
        self.said: dict[str, list[tuple[int, int]]] = {}
        self.held = 0

    def add(self, lang: str, source: str, text: bytes, table: bytes) -> None:
        numbers = self.words.setdefault(lang, _Numbers())
        before, met = len(numbers), []
        for words in words_of(text, table):
            found = np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words))
            self.found.setdefault(lang, []).append(found)
            self.said.setdefault(lang, []).append((self.sources[source], len(found)))
            met.append(np.unique(found))
            self.held += POSTING_BYTES * (len(found) + len(met[-1]))
        if met:
            self.met.setdefault(lang, []).append(met[0] if len(met) == 1 else np.unique(np.concatenate(met)))
        self.held += WORD_BYTES * (len(numbers) - before)

    def run(self, shards: int, number: int) -> Iterator[pa.RecordBatch]:
        """The block's pieces as rows of RUNS, sorted by (shard, key); a key is a word and its language."""
        keys, docs, sizes, sources, counts = [], [], [], [], []
        width = max(1, len(self.sources))
        for lang, numbers in self.words.items():
            if not numbers:
                continue
            end = PART + lang.encode()
            keys += [word + end for word in numbers]
            docs.append(np.bincount(np.concatenate(self.met[lang]), minlength=len(numbers)))
            who, lengths = (np.array(x, dtype=np.int64) for x in zip(*self.said[lang]))
            pairs, n = np.unique(
                np.concatenate(self.found[lang]).astype(np.int64) * width + np.repeat(who, lengths), return_counts=True
            )
            sizes.append(np.bincount(pairs // width, minlength=len(numbers)))
            sources.append(pairs % width)
            counts.append(n)
        if not keys:
            return
        docs, sizes, sources, counts = (np.concatenate(x) for x in (docs, sizes, sources, counts))
        starts = np.cumsum(sizes) - sizes
        shard = np.fromiter(map(zlib.crc32, keys), dtype=np.int64, count=len(keys)) % shards
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        order = order[np.argsort(shard[order], kind="stable")].tolist()
        shard = shard.tolist()
        names = list(self.sources)
        rows, entries, at = [], 0, 0
        while at < len(order):
            here = shard[order[at]]
            stop = at
            while stop < len(order) and stop - at < PIECE and shard[order[stop]] == here:
                stop += 1
            piece = np.array(order[at:stop])
            reps = sizes[piece]
            ends = np.cumsum(reps)
            places = np.arange(ends[-1]) + np.repeat(starts[piece] - (ends - reps), reps)
            used, local = np.unique(sources[places], return_inverse=True)
            rows.append(
                (here, keys[order[at]], number, [keys[i] for i in order[at:stop]], docs[piece], ends,
                 [names[i] for i in used], local, counts[places])
            )
            entries += stop - at
            at = stop
            if entries >= 16 * PIECE or at == len(order):
                yield _record(rows, _RUN_SCHEMA)
                rows, entries = [], 0


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_RUN_SCHEMA = pa.schema(
    [
        ("shard", pa.int32()), ("first", pa.binary()), ("run", pa.int64()), ("keys", pa.list_(pa.binary())),
        ("docs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("names", pa.list_(pa.string())),
        ("sources", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
    ]
)
_LIST_SCHEMA = pa.schema(
    [
        ("lang", pa.string()), ("term", pa.string()), ("total", pa.int64()),
        ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
    ]
)


def _spilled(docs: DataFrame, shards: int, block_mb: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, block = _table(), Block()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts):
                block.add(lang, source, text.as_py(), table)
                if block.held >= block_mb << 20:
                    yield from block.run(shards, number)
                    block, number = Block(), number + 1
        yield from block.run(shards, number)

    return docs.mapInArrow(run, RUNS)


# ---- merging ----


class Piece:
    """A piece of a run, and how far it has been merged."""

    def __init__(self, shard, first, run, keys, docs, ends, names, sources, counts):
        self.shard, self.first, self.keys, self.at = shard, first, keys, 0
        self.docs, self.ends, self.sources, self.counts = (np.asarray(x, dtype=np.int64) for x in (docs, ends, sources, counts))
        self.names = names


def heap_merge(pieces: Iterable[Piece]) -> Iterator[list[tuple[Piece, int, int]]]:
    """Stretches of pieces [(piece, from, to)]; every key is in one of the lists alone.

    Pieces come in the order of (shard, first key). The heap holds the open ones by the
    key they go on with. Before a piece is opened, all keys below its first are taken
    from the pieces on top; no later piece can hold them.
    """
    heap: list[tuple] = []
    ready, words = [], 0

    def advance(shard: int, key: bytes) -> int:
        taken = 0
        while heap and heap[0][:2] < (shard, key):
            *_, number, piece = heapq.heappop(heap)
            stop = len(piece.keys) if piece.shard < shard else bisect_left(piece.keys, key, piece.at)
            ready.append((piece, piece.at, stop))
            taken += stop - piece.at
            piece.at = stop
            if stop < len(piece.keys):
                heapq.heappush(heap, (piece.shard, piece.keys[stop], number, piece))
        return taken

    for number, piece in enumerate(pieces):
        words += advance(piece.shard, piece.first)
        if words >= STRETCH:
            yield ready
            ready, words = [], 0
        heapq.heappush(heap, (piece.shard, piece.first, number, piece))
    ready += [(piece, piece.at, len(piece.keys)) for *_, piece in heap]
    if ready:
        yield ready


def frequencies(stretches: list[tuple[Piece, int, int]], least_docs: int) -> list[tuple[bytes, list[str], list[int]]]:
    """(key, sources, occurrences) of the keys in at least `least_docs` documents."""
    keys, names = _Numbers(), _Numbers()
    ids, docs, sizes, sources, counts = [], [], [], [], []
    for piece, low, high in stretches:
        ids.append(np.fromiter(map(keys.__getitem__, piece.keys[low:high]), dtype=np.int64, count=high - low))
        docs.append(piece.docs[low:high])
        ends = piece.ends[low:high]
        start = piece.ends[low - 1] if low else 0
        sizes.append(np.diff(ends, prepend=start))
        local = np.array([names[n] for n in piece.names], dtype=np.int64)
        sources.append(local[piece.sources[start : ends[-1]]] if high > low else ids[-1])
        counts.append(piece.counts[start : ends[-1]] if high > low else ids[-1])
    ids, docs, sizes, sources, counts = (np.concatenate(x) for x in (ids, docs, sizes, sources, counts))
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, ids, docs)
    kept = np.repeat(total[ids] >= least_docs, sizes)
    pairs, places = np.unique(
        np.repeat(ids, sizes)[kept] * max(1, len(names)) + sources[kept], return_inverse=True
    )
    sums = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(sums, places, counts[kept])
    word, who = np.divmod(pairs, max(1, len(names)))
    cuts = np.flatnonzero(np.diff(word)) + 1
    all_keys, all_names = list(keys), list(names)
    return [
        (all_keys[word[a]], [all_names[i] for i in who[a:b]], sums[a:b].tolist())
        for a, b in zip([0, *cuts], [*cuts, len(word)])
        if b > a
    ]


def _merged(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    def opened() -> Iterator[Piece]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [column[i] for column in batch.columns]
                lists = [x.values.to_numpy(zero_copy_only=False) for x in (row[4], row[5], row[7], row[8])]
                yield Piece(row[0].as_py(), row[1].as_py(), None, row[3].as_py(), *lists[:2], row[6].as_py(), *lists[2:])

    for stretches in heap_merge(opened()):
        rows = []
        for key, names, counts in frequencies(stretches, least_docs):
            word, lang = key.split(PART)
            rows.append((lang.decode(), word.decode("utf-8", "replace"), sum(counts), names, counts))
        yield _record(rows, _LIST_SCHEMA)


def word_frequencies(docs: DataFrame, least_docs: int = 10, block_mb: int = 128) -> DataFrame:
    """(lang, term, total, sources, counts) of every word in `least_docs` documents of its language.

    `docs` has text, lang and source; NULL counts as ''. Words are runs of letters
    and characters beyond ASCII, A-Z in lower case. A row is a document, repeated
    ones too. A task holds one block of about `block_mb` megabytes and the distinct
    words of one text. An empty table gives no rows.
    """
    shards = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    runs = _spilled(filled, shards, block_mb).repartition("shard").sortWithinPartitions("shard", "first", "run")
    return runs.mapInArrow(lambda batches: _merged(batches, least_docs), LISTS)


# ---- divergence ----


def _rate(count: Column, words: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (words + 2 * kept)), in two exact steps of long arithmetic."""
    whole = F.greatest(words + 2 * kept, F.lit(1).cast("long"))
    first = (count + 2) * F.lit(31_250).cast("long")
    left = (first % whole) * F.lit(32_000).cast("long")
    return 1 + F.call_function("div", first, whole) * 32_000 + F.call_function("div", left, whole)


def _term(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _terms(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


_PAIR_SCHEMA = pa.schema([("lang", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("value", pa.int64())])


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair corrections of lists (lang, places, rates, zeros), summed per two sources.

    Lists of one length are compared together, a bounded number of pairs at a time.
    """
    held: dict[str, Counter] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for lang, sums in held.items():
            low, high = zip(*sums) if sums else ((), ())
            columns = [[lang] * len(sums), low, high, list(sums.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAIR_SCHEMA)], schema=_PAIR_SCHEMA)
        held.clear()

    def compared(lang: str, place: np.ndarray, p: np.ndarray, zero: np.ndarray) -> None:
        i, j = np.triu_indices(place.shape[1], 1)
        a, b, za, zb = p[:, i], p[:, j], zero[:, i], zero[:, j]
        fix = _terms(a, b) - _terms(a, zb) - _terms(za, b) + _terms(za, zb)
        low, high = np.minimum(place[:, i], place[:, j]).ravel(), np.maximum(place[:, i], place[:, j]).ravel()
        wide = int(high.max()) + 1
        pairs, at = np.unique(low * wide + high, return_inverse=True)
        sums = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(sums, at, fix.ravel())
        held.setdefault(lang, Counter()).update(
            dict(zip(zip((pairs // wide).tolist(), (pairs % wide).tolist()), sums.tolist()))
        )

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        ends = batch.column("places").offsets.to_numpy()
        flat = [batch.column(c).values.to_numpy(zero_copy_only=False) for c in ("places", "rates", "zeros")]
        alike: dict[tuple[str, int], list[int]] = {}
        for i, lang in enumerate(langs):
            alike.setdefault((lang, int(ends[i + 1] - ends[i])), []).append(int(ends[i]))
        for (lang, length), starts in alike.items():
            step = max(1, PAIRS // (length * length))
            for k in range(0, len(starts), step):
                at = np.array(starts[k : k + step])[:, None] + np.arange(length)
                compared(lang, *(x[at] for x in flat))
                if sum(map(len, held.values())) >= OPEN_PAIRS:
                    yield from handed_on()
    yield from handed_on()


def _outer_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per source and row of others: V f(p0, q0) once a pair, and its counts against the others' p0."""
    for batch in batches:
        for row in batch.to_pylist():
            others, zeros = np.array(row["others"], dtype=np.int64), np.array(row["zeros"], dtype=np.int64)
            place, zero = row["place"], np.int64(row["zero"])
            flat = _terms(zero, zeros)
            sums = np.where(others > place, flat * np.int64(row["kept"] if row["chunk"] == 0 else 0), 0)
            for rate, n in zip(row["rates"], row["words"]):
                sums += (_terms(np.int64(rate), zeros) - flat) * np.int64(n)
            there = others != place
            sums, others = sums[there], others[there]
            columns = [
                pa.array([row["lang"]] * len(others), pa.string()),
                pa.array(np.minimum(others, place)),
                pa.array(np.maximum(others, place)),
                pa.array(sums),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_PAIR_SCHEMA)


def _groups(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per (lang, source): its place, words N, the language's N and V, and its zero rate."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    every = docs.select(*text, F.lit(0).cast("long").alias("n"))
    counted = lists.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n")
    )
    kept = lists.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    lang = W.partitionBy("lang")
    # One row per source: the result has their square.
    return (
        every.unionByName(counted)
        .groupBy("lang", "source")
        .agg(F.sum("n").alias("words"))
        .join(kept, "lang", "left")
        .withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
        .withColumn("place", F.row_number().over(lang.orderBy("source")).cast("long") - 1)
        .withColumn("lang_words", F.sum("words").over(lang))
        .withColumn("zero", _rate(F.lit(0).cast("long"), F.col("words"), F.col("kept")))
    )


def _pair_values(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """(lang, low, high, value) of every two sources of a language, by place."""
    sides = (
        groups.withColumn("side", F.call_function("div", F.col("place"), F.lit(SIDE).cast("long")))
        .groupBy("lang", "side")
        .agg(F.array_sort(F.collect_list(F.struct("place", "zero"))).alias("x"))
        .select("lang", "side", F.col("x.place").alias("others"), F.col("x.zero").alias("zeros"))
    )
    rates = rated.groupBy("lang", "place", "rate").agg(F.count(F.lit(1)).alias("words"))
    packed = (
        rates.withColumn("chunk", F.row_number().over(W.partitionBy("lang", "place").orderBy("rate")) - 1)
        .withColumn("chunk", F.floor(F.col("chunk") / COUNTS).cast("int"))
        .groupBy("lang", "place", "chunk")
        .agg(F.collect_list(F.struct("rate", "words")).alias("x"))
    )
    last = F.max("place").over(W.partitionBy("lang"))
    sides_of = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("last"), F.lit(SIDE).cast("long")))
    own = groups.withColumn("last", last).select("lang", "place", "zero", "kept", F.explode(sides_of).alias("side"))
    met = (
        own.join(packed, ["lang", "place"], "left")
        .withColumn("chunk", F.coalesce("chunk", F.lit(0)))
        .withColumn("x", F.coalesce("x", F.expr("cast(array() as array<struct<rate:bigint,words:bigint>>)")))
        .join(sides, ["lang", "side"])
        .select(
            "lang", "place", "zero", "kept", "chunk", "others", "zeros",
            F.col("x.rate").alias("rates"), F.col("x.words").alias("words"),
        )
    )
    pairs = "lang string, low long, high long, value long"
    outer = met.mapInArrow(_outer_sums, pairs)
    shared = rated.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "rate", "zero")).alias("x"))
    lists = shared.filter(F.size("x") > 1).select(
        "lang", F.col("x.place").alias("places"), F.col("x.rate").alias("rates"), F.col("x.zero").alias("zeros")
    )
    fixes = lists.mapInArrow(_corrections, pairs)
    return outer.unionByName(fixes).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = 10, most_terms: int = 10, block_mb: int = 128) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others and from its language.

    Part `pair` has a row for every other source of the language, part `term` the
    `most_terms` words that most set the source above its language. NULL text, lang
    and source count as ''. A group without kept words has rates of words it lacks;
    a language without kept words has value 0 for all pairs. Rows that repeat count
    each; other columns are left out; an empty table gives an empty result.
    """
    lists = materialize(word_frequencies(docs, least_docs, block_mb), "word_lists")
    groups = materialize(_groups(docs, lists), "source_groups")
    found = lists.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("n")
    )
    rated = materialize(
        found.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "place", "zero",
            _rate(F.col("n"), F.col("words"), F.col("kept")).alias("rate"),
            _rate(F.col("total"), F.col("lang_words"), F.col("kept")).alias("lang_rate"),
        ),
        "word_rates",
    )
    best = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = (
        rated.filter("rate > lang_rate")
        .select("lang", "source", F.col("term").alias("item"), _term(F.col("rate"), F.col("lang_rate")).alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= most_terms)
    )
    pairs = materialize(_pair_values(groups, rated), "source_pairs")
    both = pairs.select("lang", F.col("low").alias("place"), F.col("high").alias("other"), "value").unionByName(
        pairs.select("lang", F.col("high").alias("place"), F.col("low").alias("other"), "value")
    )
    names = groups.select("lang", "place", "source")
    named = (
        both.join(names, ["lang", "place"])
        .join(names.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), ["lang", "other"])
        .select("lang", "source", "item", "value")
        .withColumn("rank", F.row_number().over(best))
    )
    shape = ["lang", "source", "part", "item", "value", "rank"]
    return named.withColumn("part", F.lit("pair")).select(*shape).unionByName(
        terms.withColumn("part", F.lit("term")).select(*shape)
    )

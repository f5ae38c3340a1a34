"""N-gram Jaccard join with parity sketches.

A text is the set of its distinct word shingles. Two texts link when
100 * |A and B| >= percent * |A or B|. The join works in these steps:

1. Texts with equal sets form one class; only classes go on.
2. Sizes are cut into bands. In a band, `b` is the largest symmetric difference a
   linked pair can have whose smaller set lies in it. Every class spreads its
   shingles over the blocks of the band's sketch and XORs their hashes per block:
   the block's parity pattern, one bit per shingle hash, held as its 64-bit
   signature. A shingle in one set only changes one block at most, so the number
   of differing blocks is a lower bound of the symmetric difference, and linked
   pairs agree on all blocks but `b` (pigeonhole).
3. A sketch has more blocks than `b + 1`. Each class keeps its fullest blocks only
   (an order every class shares), just so many that linked pairs still agree on
   `common` kept blocks. Blocks that meet nobody are dropped, and so are classes
   that agree with others on fewer than `common` blocks.
4. Of the classes that share a block, all are verified against the one with the
   most shared blocks, its pivot, by counting common shingles of the texts
   themselves. Classes that end in one component need no more checks.
5. Blocks that still join several components are settled chunk by chunk: classes
   that such blocks connect form a family, families are cut into chunks of bounded
   size, and every two chunks that meet in such a block are verified in one task,
   as a product of two shingle matrices, which gives out the links of a spanning
   forest only. So no link between components is lost, no group of copies meets in
   one task, and pairs are never written out.

A class is named by a 64-bit hash of its set; among n classes a mix-up has a
probability of n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import free_name
from tidemark.llm.components import components
from tidemark.llm.words import mix, separators, shingle_sets, slices
from tidemark.operators.lookups import lookup
from tidemark.sources.scratch import materialize

# Entries (16 bytes each) of one task of the block join.
ENTRIES_PER_TASK = 1_000_000
# Members a pivot is compared with at a time, and classes of a chunk.
MEMBERS_PER_TASK = 500
CHUNK = 512
# Columns of a shingle matrix multiplied at a time.
COLUMNS = 1 << 13

_BAND_BITS = 6


def bands(percent: int, largest: int = 1 << 40) -> list[tuple[int, int, int, int]]:
    """(largest size, differing blocks allowed, shared blocks to ask for, all blocks) per band."""
    made, top = [], 0
    while top < largest:
        top = max(top + 1, top * 3 // 2)
        differ = top * (100 - percent) // percent
        common = 1 + (differ + 5) // 10 if differ else 1
        made.append((top, differ, common, differ + common + (differ + 1) // 6))
    return made


def _class_names(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One signed 64-bit name per set; the empty set is 0."""
    names = np.zeros(len(sizes), dtype=np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[filled]
        names[filled] = mix(np.add.reduceat(mix(sets + np.uint64(0x51ED270B)), starts) + sizes[filled].astype(np.uint64))
    return names.view(np.int64)


def _block_keys(
    sets: np.ndarray, sizes: np.ndarray, band: int, limits: tuple[int, int, int, int], percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the kept blocks, index of their set) of sets that all take part in one band."""
    top, _, common, blocks = limits
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Sets are sorted, and a block is a range of hashes: equal blocks are neighbours.
    block = ((sets >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    place = owner.astype(np.uint64) * np.uint64(blocks) + block
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    parity = np.bitwise_xor.reduceat(mix(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), first)
    count = np.diff(np.concatenate((first, [len(sets)])))
    owner, block = owner[first], block[first]
    order = np.lexsort((parity, -count, owner))
    owner, block, parity, count = owner[order], block[order], parity[order], count[order]
    filled = np.bincount(owner, minlength=len(sizes))
    rank = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(filled)[:-1])), filled)
    keep = np.minimum(blocks, np.minimum(sizes, top) * (100 - percent) // percent + common)
    kept = rank < keep[owner]
    owners, keys = [owner[kept]], [mix(parity[kept] + mix(count[kept].astype(np.uint64) * np.uint64(blocks) + block[kept]))]
    for i in np.flatnonzero(filled < keep):  # empty blocks come last in the order
        empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), block[owner == i])[: keep[i] - filled[i]]
        owners.append(np.full(len(empty), i))
        keys.append(mix(empty + np.uint64(0x7F4A7C15)))
    tagged = (np.concatenate(keys) >> np.uint64(_BAND_BITS) << np.uint64(_BAND_BITS)) | np.uint64(band)
    return tagged, np.concatenate(owners)


def _entries(sets: np.ndarray, sizes: np.ndarray, names: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(block keys, class names) of many sets, over every band each takes part in."""
    limits = bands(percent)
    tops = np.array([b[0] for b in limits])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    own = np.searchsorted(tops, sizes)
    lowest = np.searchsorted(tops * 100, sizes * percent)  # the lowest band of a partner
    keys, classes = [], []
    for band in range(int(lowest[sizes > 0].min()) if (sizes > 0).any() else 0, int(own.max()) + 1):
        if limits[band][1] == 0:
            continue  # only equal sets link
        chosen = np.flatnonzero((own >= band) & (lowest <= band) & (sizes > 0))
        if not len(chosen):
            continue
        picked = np.concatenate([sets[starts[i] : starts[i + 1]] for i in chosen])
        found, owner = _block_keys(picked, sizes[chosen], band, limits[band], percent)
        keys.append(found)
        classes.append(names[chosen][owner])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(classes)


def _set_rows(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = separators()
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                sets, sizes = shingle_sets(texts, width, parts)
                names = _class_names(sets, sizes)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(names)], ["doc_id", "n_shingles", "class"]
                )

    return run


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _dealt(width: int, percent: int, buckets: int):
    """Block entries, sorted into one blob per bucket; keys met twice already are settled here.

    A key that several classes of one batch share needs no bucket to learn that it
    is shared: its members go out as settled, and one entry tells the bucket. So a
    key that holds any share of all classes sends few entries to its bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = separators()
        turn = 0
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            many = 0

            def flush() -> pa.RecordBatch:
                nonlocal turn
                keys = np.concatenate([k for k, _ in held])
                classes = np.concatenate([c for _, c in held])
                order = np.lexsort((classes, keys))
                keys, classes = keys[order], classes[order]
                new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])))
                keys, classes = keys[new], classes[new]
                first = _runs(keys)
                sizes = np.diff(np.concatenate((first, [len(keys)])))
                shared = np.repeat(sizes > 1, sizes)
                settled = np.concatenate((keys[shared], classes[shared].view(np.uint64)))
                # Sent on: single entries, and the first of each shared key, marked by itself.
                single = first[sizes == 1]
                marks = first[sizes > 1]
                out_keys = np.concatenate((keys[single], keys[marks]))
                out_classes = np.concatenate((classes[single], classes[marks]))
                marked = np.concatenate((np.zeros(len(single), np.uint8), np.ones(len(marks), np.uint8)))
                bucket = ((out_keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows: list[tuple] = []
                for b in range(buckets):
                    part = order[cut[b] : cut[b + 1]]
                    if len(part):
                        rows.append((b, out_keys[part].tobytes(), out_classes[part].tobytes(), marked[part].tobytes()))
                if len(settled):
                    half = len(settled) // 2
                    turn += 1
                    rows.append((turn % buckets, settled[:half].tobytes(), settled[half:].tobytes(), None))
                held.clear()
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()),
                        *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)],
                    ],
                    ["bucket", "keys", "classes", "marks"],
                )

            for _, texts in slices(batch, "text"):
                sets, sizes = shingle_sets(texts, width, parts)
                names = _class_names(sets, sizes)
                _, one = np.unique(names, return_index=True)
                starts = np.concatenate(([0], np.cumsum(sizes)))
                one.sort()
                picked = np.concatenate([sets[starts[i] : starts[i + 1]] for i in one])
                keys, classes = _entries(picked, sizes[one], names[one], percent)
                if len(keys):
                    held.append((keys, classes))
                    many += len(keys)
                if many >= ENTRIES_PER_TASK:
                    yield flush()
                    many = 0
            if held:
                yield flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, class) of all blocks that two classes or more share."""
    keys, classes, marks = [], [], []

    def table(k: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(k), 100_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[at : at + 100_000].view(np.int64)), pa.array(c[at : at + 100_000])], ["key", "class"]
            )

    for batch in batches:
        for k, c, m in zip(batch.column("keys"), batch.column("classes"), batch.column("marks")):
            k = np.frombuffer(k.as_buffer(), dtype=np.uint64)
            c = np.frombuffer(c.as_buffer(), dtype=np.int64)
            if m.is_valid:
                keys.append(k.copy())
                classes.append(c.copy())
                marks.append(np.frombuffer(m.as_buffer(), dtype=np.uint8).copy())
            else:
                yield from table(k, c)
    if keys:
        k, c, m = np.concatenate(keys), np.concatenate(classes), np.concatenate(marks)
        keys.clear(), classes.clear(), marks.clear()
        order = np.lexsort((c, k))
        k, c, m = k[order], c[order], m[order]
        first = _runs(k)
        sizes = np.diff(np.concatenate((first, [len(k)])))
        low, high = np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)
        shared = (low != high) | (np.maximum.reduceat(m, first) > 0)
        kept = np.repeat(shared, sizes)
        yield from table(k[kept], c[kept])


def _linked(width: int, percent: int):
    """Compares each member of a group with the group's pivot, which comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = separators()
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                sets, sizes = shingle_sets(texts, width, parts)
                starts = np.concatenate(([0], np.cumsum(sizes)))
                names = _class_names(sets, sizes)
                a, b, part = (rows.column(c).to_pylist() for c in ("pivot", "class", "part"))
                out_a, out_b = [], []
                for i in range(len(texts)):
                    if names[i] != b[i]:
                        continue  # another text under the same doc_id
                    mine = sets[starts[i] : starts[i + 1]]
                    if part[i] == 0:
                        pivot = mine
                        continue
                    both = len(np.intersect1d(pivot, mine, assume_unique=True))
                    if both * 100 >= percent * (len(pivot) + len(mine) - both):
                        out_a.append(a[i])
                        out_b.append(b[i])
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked ones of `pairs(pivot, class)`, both names of classes."""
    spark = docs.sparkSession
    texts = sets.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    groups = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS_PER_TASK)).cast("int").alias("splits"))
    members = lookup(pairs, groups, ["pivot"], "inner").select(
        "pivot", "class", F.pmod(F.xxhash64("class"), F.col("splits")).cast("int").alias("split"), F.lit(1).alias("part")
    )
    pivots = groups.select(
        "pivot", F.col("pivot").alias("class"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.lit(0).alias("part")
    )
    wanted = lookup(members.union(pivots), texts, ["class"], "inner")
    rows = docs.select("doc_id", "text").join(wanted, "doc_id")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(count, "pivot", "split").sortWithinPartitions("pivot", "split", "part", "class")
    return grouped.select("pivot", "class", "part", "text").mapInArrow(_linked(width, percent), "a long, b long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets have in common."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    counts = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    wide = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, wide, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((n, min(COLUMNS, wide - first)), dtype=np.float32)
        part[owner[a:b], column[a:b] - first] = 1.0
        counts += part @ part.T
    return counts.astype(np.int64)


def _settled(width: int, percent: int):
    """Per unit of two chunks: links that join its classes as all links between them would."""

    def links(names: list[int], labels: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        sizes = np.array([len(x) for x in sets])
        both = _common(sets)
        near = np.triu(both * 100 >= percent * (sizes[:, None] + sizes[None, :] - both), 1)
        parent = {label: label for label in labels}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        made = []
        for i, j in zip(*np.nonzero(near)):
            a, b = find(labels[i]), find(labels[j])
            if a != b:
                parent[b] = a
                made.append((names[i], names[j]))
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = separators()
        unit, held = None, ([], [], [])
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                sets, sizes = shingle_sets(texts, width, parts)
                starts = np.concatenate(([0], np.cumsum(sizes)))
                names = _class_names(sets, sizes)
                units, classes, labels = (rows.column(c).to_pylist() for c in ("unit", "class", "label"))
                out: list[tuple[int, int]] = []
                for i in range(len(texts)):
                    if units[i] != unit:
                        if len(held[0]) > 1:
                            out += links(*held)
                        unit, held = units[i], ([], [], [])
                    if names[i] != classes[i]:
                        continue  # another text under the same doc_id
                    held[0].append(classes[i])
                    held[1].append(labels[i])
                    held[2].append(sets[starts[i] : starts[i + 1]])
                yield _edges(out)
        if len(held[0]) > 1:
            yield _edges(links(*held))

    return run


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def _settle(open_keys: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the components that `open_keys(key, class, label)` still bring together."""
    spark = docs.sparkSession
    least = open_keys.groupBy("key").agg(F.min("class").alias("a"))
    edges = lookup(open_keys.select("key", F.col("class").alias("b")), least, ["key"], "inner").filter("a <> b")
    families = components(materialize(edges.select("a", "b").distinct(), "families"))
    home = families.select(F.col("node").alias("class"), F.col("label").alias("home"))
    members = lookup(open_keys.select("class", "label").distinct(), home, ["class"], "inner")
    chunks = members.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).alias("chunks"))
    placed = materialize(
        lookup(members, chunks, ["home"], "inner").select(
            "class", "label", F.struct("home", F.pmod(F.xxhash64("class"), F.col("chunks")).alias("no")).alias("chunk")
        ),
        "members",
    )
    held = lookup(open_keys.select("key", "class"), placed.select("class", "chunk"), ["class"], "inner").select("key", "chunk").distinct()
    other = held.withColumnRenamed("chunk", "other")
    units = held.join(other, "key").filter("chunk <= other").select("chunk", "other").distinct()
    named = units.withColumn("unit", F.xxhash64("chunk", "other"))
    sides = named.select("unit", "chunk").union(named.select("unit", F.col("other").alias("chunk"))).distinct()
    texts = sets.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    wanted = lookup(sides.join(placed, "chunk"), texts, ["class"], "inner")
    wanted = materialize(wanted, "units")
    rows = docs.select("doc_id", "text").join(wanted, "doc_id")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.repartition(count, "unit").sortWithinPartitions("unit", "class")
    return grouped.select("unit", "class", "label", "text").mapInArrow(_settled(width, percent), "a long, b long")


def _shared_blocks(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(key, class, blocks): kept blocks that classes share, of classes with enough of them."""
    limits = bands(percent)
    # A class keeps about this many blocks per shingle, over the bands it takes part in.
    share = 2.4 * (100 - percent) / percent
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * share / ENTRIES_PER_TASK) + 1)
    dealt = docs.select("text").mapInArrow(
        _dealt(width, percent, buckets), "bucket int, keys binary, classes binary, marks binary"
    )
    shared = materialize(
        dealt.repartition(buckets, "bucket").mapInArrow(_meet, "key long, class long").distinct(), "blocks"
    )
    asked = F.array(*[F.lit(b[2]) for b in limits])
    band = F.col("key").bitwiseAND(F.lit((1 << _BAND_BITS) - 1)).cast("int")
    counts = (
        shared.groupBy("class", band.alias("band")).agg(F.count(F.lit(1)).cast("int").alias("blocks"))
        .filter(F.col("blocks") >= F.element_at(asked, F.col("band") + 1))
    )
    alive = lookup(shared.withColumn("band", band), counts, ["class", "band"], "inner").select("key", "class", "blocks")
    return materialize(alive, "alive")


def _pivots(alive: DataFrame) -> DataFrame:
    """Per key the class with the most shared blocks."""
    rank = F.shiftleft(F.col("blocks").cast("long"), 40) + F.col("class").bitwiseAND(F.lit((1 << 40) - 1))
    return alive.groupBy("key").agg(F.max_by("class", rank).alias("pivot"))


def _of_one_id(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes of texts that share a doc_id, as a star around the least."""
    known = sets.filter("doc_id is not null and n_shingles > 0").select("doc_id", "class")
    several = known.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("high")).filter("a <> high")
    stars = lookup(known, several.select("doc_id", "a"), ["doc_id"], "inner")
    return stars.filter("a <> class").select("a", F.col("class").alias("b")).distinct()


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs(doc_id, text)`.

    `component_id` is the smallest doc_id a row reaches by links, its own included.
    Texts that are NULL or have no words have 0 shingles and link with nothing.
    Texts of fewer than `width` words have one shingle, the whole sequence. Equal
    rows stay rows; texts that share a doc_id are one document, so what links with
    one of them reaches them all. A row without doc_id takes no part and has a NULL
    component. Other columns are ignored; an empty table gives an empty result.
    """
    sets = materialize(
        docs.select("doc_id", "text").mapInArrow(_set_rows(width, percent), "doc_id long, n_shingles long, class long"), "sets"
    )
    known = sets.filter("doc_id is not null and n_shingles > 0")
    given = docs.filter("doc_id is not null")
    alive = _shared_blocks(given, known, width, percent)
    met = lookup(alive.select("key", "class"), _pivots(alive), ["key"], "inner")
    pairs = materialize(met.filter("class <> pivot").select("pivot", "class").distinct(), "pairs")
    links = materialize(_verify(pairs, given, known, width, percent).union(_of_one_id(sets)), "links")
    labels = components(links)
    named = lookup(alive.select("key", "class"), labels.withColumnRenamed("node", "class"), ["class"], "left").withColumn(
        "label", F.coalesce("label", "class")
    )
    mixed = (
        named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    )
    open_keys = materialize(lookup(named, mixed, ["key"], "inner"), "open")
    more = materialize(_settle(open_keys, given, known, width, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    classes = known.groupBy("class").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "label", F.coalesce("label", "class")
    )
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = lookup(named, smallest, ["label"], "inner").select("class", "component_id")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return lookup(sets, of_class, ["class"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without near copies: of each component of texts one row stays.

    It is the one with the smallest doc_id, rows without one last, then the first as
    read. Rows are numbered once and written; links join row numbers, so neither rows
    that share a doc_id nor rows without one are taken for each other. Rows without
    words stay. All columns stay, whatever these are called.
    """
    number = free_name(docs, "_row")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(number).alias("doc_id"), "text")
    links = materialize(jaccard_links(rows, width, percent).filter("n_shingles > 0"), "components")
    ids = numbered.select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("id"))
    met = links.select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    best = met.groupBy("component_id").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    several = best.filter("n > 1").select("component_id", F.col("best.row").alias("kept"))
    gone = lookup(met.select("row", "component_id"), several, ["component_id"], "inner").filter("row <> kept")
    left = numbered.join(gone.select(F.col("row").alias(number)), number, "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Exact duplicates through content-defined chunks.

A text is cut where a rolling hash of its last bytes says so, which depends on the
content only; equal texts therefore have equal chunks. Chunks get identifiers: a
digest, and an ordinal that tells different chunks of one digest apart. A document is
its recipe, the ordered list of its chunk identifiers; texts are equal when their
recipes are, and only recipes are compared. Digests are counted first: one that occurs
once has one content, and its bytes stay where they are. The bytes of the others are
moved once, one row per digest and batch, to verify that a digest has one content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark.llm.columns import free_name
from tidemark.llm.words import STEP, mix, slices
from tidemark.operators.lookups import lookup
from tidemark.sources.scratch import materialize

WHITE_SPACE = b" \t\n\x0b\x0c\r"

# A cut follows each place whose last WINDOW bytes hash to zero in MEAN_BITS bits;
# chunks longer than MOST bytes are cut there.
WINDOW = 16
MEAN_BITS = 11
MOST = 1 << 16

# Bits of the filter that says which digests occur again; a broadcast of an eighth as many
# bytes, at most. A bit that two digests share sends bytes to be verified for nothing,
# never too few: with n digests that occur again, about n / FILTER_BITS of the others.
FILTER_BITS = 1 << 27


def _places(data: np.ndarray) -> np.ndarray:
    """Ends of chunks of one text, the last one being its length."""
    cuts = []
    scramble = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
    for at in range(0, len(data), STEP):
        codes = scramble[data[max(0, at - WINDOW + 1) : at + STEP]]
        if len(codes) < WINDOW:
            continue
        # The sum over the window of codes, each turned by its distance from the end.
        rolled = np.zeros(len(codes) - WINDOW + 1, dtype=np.uint64)
        for i in range(WINDOW):
            part = codes[i : len(codes) - WINDOW + 1 + i]
            turn = np.uint64(WINDOW - 1 - i)
            rolled ^= (part << turn) | (part >> (np.uint64(64) - turn)) if turn else part
        found = np.flatnonzero((rolled >> np.uint64(64 - MEAN_BITS)) == 0)
        cuts.append(found + max(0, at - WINDOW + 1) + WINDOW)
    ends = np.unique(np.concatenate([*cuts, [len(data)]])).astype(np.int64)
    long = np.flatnonzero(np.diff(np.concatenate(([0], ends))) > MOST)
    if len(long):
        starts = np.concatenate(([0], ends[:-1]))
        more = [np.arange(starts[i] + MOST, ends[i], MOST) for i in long]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def _chunks(text: bytes) -> list[bytes]:
    if len(text) < WINDOW:
        return [text]
    ends = _places(np.frombuffer(text, dtype=np.uint8)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def _plain(text: bytes | None) -> bytes:
    return (text or b"").translate(None, WHITE_SPACE)


def _recipe_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                plain = [_plain(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in ("row", "doc_id")),
                        pc.fill_null(pc.utf8_length(rows.column("text")), 0).cast(pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in plain]),
                        pa.array([b"".join(_digest(c, size) for c in _chunks(t)) for t in plain], pa.binary()),
                    ],
                    ["row", "doc_id", "n_chars", "text_sha256", "recipe"],
                )

    return run


def _chunk_rows(size: int):
    """Each digest's bytes once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for _, texts in slices(batch, "text"):
                found = {c for t in texts for c in _chunks(_plain(t))}
                new = sorted(found - seen)
                # Bytes, not digests: another content of a seen digest must go out too.
                seen.update(new)
                if len(seen) > 20_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(c, size) for c in new], pa.binary()), pa.array(new, pa.binary())], ["digest", "chunk"]
                )

    return run


def _occurrence_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                found = [(r, i, c) for r, t in zip(rows.column("row").to_pylist(), texts) for i, c in enumerate(_chunks(_plain(t)))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _, _ in found], pa.int64()),
                        pa.array([i for _, i, _ in found], pa.int64()),
                        pa.array([_digest(c, size) for _, _, c in found], pa.binary()),
                        pa.array([c for _, _, c in found], pa.binary()),
                    ],
                    ["row", "place", "digest", "chunk"],
                )

    return run


def _again(recipes: DataFrame, size: int, bits: int) -> DataFrame:
    """(part, bitmap) of the filter: bits of all digests that occur more than once."""
    digests = F.expr(f"transform(sequence(0, length(recipe) div {size} - 1), i -> substring(recipe, cast(i * {size} + 1 as int), {size}))")
    counted = recipes.select(F.explode(digests).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.filter("n > 1").select(*_bit(bits)).distinct()
    return placed.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def _bit(bits: int) -> list[Column]:
    """Part of the filter that a digest's bit is in, and its place there."""
    at = F.pmod(F.xxhash64("digest"), F.lit(bits))
    return [F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")]


def _colliding(numbered: DataFrame, recipes: DataFrame, size: int, bits: int) -> DataFrame:
    """Digests with several contents, by the bytes of all chunks whose digest occurs again."""
    chunks = numbered.select("text").mapInArrow(_chunk_rows(size), "digest binary, chunk binary")
    octet = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    part, bit = _bit(bits)
    # The filter has `bits` bits at most, so its size is bounded whatever the input.
    again = (
        chunks.withColumns({"part": part, "bit": bit}).join(F.broadcast(_again(recipes, size, bits)), "part")
        .filter(octet.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0)
    )
    # Least and greatest bytes meet on the map side, one row per digest and task.
    ends = again.groupBy("digest").agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
    return materialize(ends.filter("least <> greatest").select("digest"), "colliding")


def _several(numbered: DataFrame, colliding: DataFrame, size: int) -> DataFrame:
    """(digest, chunk, ordinal) of all but the first content of digests with several."""
    chunks = numbered.select("text").mapInArrow(_chunk_rows(size), "digest binary, chunk binary")
    contents = chunks.join(colliding, "digest", "left_semi").distinct()
    ordinal = F.row_number().over(W.partitionBy("digest").orderBy("chunk"))
    return materialize(contents.withColumn("ordinal", ordinal).filter("ordinal > 1"), "ordinals")


def _marked(numbered: DataFrame, recipes: DataFrame, several: DataFrame, size: int) -> DataFrame:
    """Recipes in which digests with several contents carry the ordinal of theirs."""
    parts = numbered.select("row", "text").mapInArrow(
        _occurrence_rows(size), "row long, place long, digest binary, chunk binary"
    )
    marks = parts.join(several, ["digest", "chunk"]).select("row", "place", "ordinal")
    suffix = marks.groupBy("row").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "ordinal"))), lambda x: F.concat_ws("/", x.place, x.ordinal)), ","
        ).alias("suffix")
    )
    marked = recipes.join(suffix, "row", "left")
    return marked.withColumn(
        "recipe", F.concat("recipe", F.coalesce(F.col("suffix").cast("binary"), F.lit(b"")))
    ).drop("suffix")


def exact_groups(docs: DataFrame, digest_bytes: int = 16, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(row, doc_id, n_chars, text_sha256, keep_id, group_size, kept) of every row of `docs(doc_id, text)`.

    Texts are equal when they are after deleting white space; NULL counts as empty.
    Of each group one row is kept: that with the most code points, then the smallest
    doc_id (rows without one last), then the first read. `row` numbers the rows as
    read. An empty table gives an empty result; other columns are ignored.
    """
    return _groups(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), digest_bytes, filter_bits, written=False)


def _recipes(numbered: DataFrame, size: int) -> DataFrame:
    return materialize(
        numbered.mapInArrow(_recipe_rows(size), "row long, doc_id long, n_chars long, text_sha256 string, recipe binary"),
        "recipes",
    )


def _groups(numbered: DataFrame, digest_bytes: int, filter_bits: int, written: bool) -> DataFrame:
    """`exact_groups` of rows with a number; `written` tells that each scan finds the same numbers."""
    numbered = numbered.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    recipes = _recipes(numbered, digest_bytes)
    colliding = _colliding(numbered, recipes, digest_bytes, filter_bits)
    if not colliding.isEmpty():
        if not written:
            # Numbers follow the split of a scan; rows read twice by number are written first.
            numbered = materialize(numbered, "numbered")
            recipes = _recipes(numbered, digest_bytes)
        recipes = _marked(numbered, recipes, _several(numbered, colliding, digest_bytes), digest_bytes)
    rank = F.struct(
        (-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row")
    )
    groups = recipes.groupBy("recipe").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    found = groups.select(
        "recipe", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")
    )
    kept: Column = F.col("row") == F.col("keep_row")
    return lookup(recipes, found, ["recipe"], "inner").select(
        "row", "doc_id", "n_chars", "text_sha256", "keep_id", "group_size", kept.alias("kept")
    )


def without_copies(docs: DataFrame, digest_bytes: int = 16, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The kept rows of `docs`, with all their columns, whatever these are called."""
    number = free_name(docs, "_row")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    groups = _groups(numbered.select(F.col(number).alias("row"), "doc_id", "text"), digest_bytes, filter_bits, written=True)
    kept = groups.filter("kept").select(F.col("row").alias(number))
    return numbered.join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

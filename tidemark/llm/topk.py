"""Exact top-k search by inner product.

Vectors are made whole numbers, sorted by descending length and cut into blocks.
The longest block gives every query a first k-th best score. A block is then opened
for a block of queries only if its longest vector can reach that score at all, and
inside it a query stops where the product of lengths falls below its score. What is
left is bounded by a partial product over the leading rotated dimensions plus, by
Cauchy-Schwarz, the product of the lengths of the rest; only pairs whose bound
reaches the score are multiplied out. The rotation comes from the SVD of a sample,
which puts most length into few dimensions; any rotation keeps results exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize

BLOCK = 4096
QUERY_BLOCK = 512
# Vectors the rotation is fitted on, at most about.
SAMPLE = 4096

_PACKED = "part int, block int, n int, longest double, ids binary, whole binary"


def _scaled(lists: list, scale: float, dims: int) -> np.ndarray:
    made = np.zeros((len(lists), dims))
    for i, x in enumerate(lists):
        made[i, : len(x)] = x
    return np.floor(made * scale)


def _packed(dims: int, scale: float, size: int):
    """Runs of rows as blocks of ids and whole-number vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list = []
        part = number = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            whole = _scaled(rows, scale, dims)
            longest = float(np.sqrt((whole**2).sum(axis=1)).max())
            made = [(part, number, len(ids), longest, np.array(ids, np.int64).tobytes(), whole.astype(np.float64).tobytes())]
            number += 1
            ids.clear()
            rows.clear()
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
            names = ["part", "block", "n", "longest", "ids", "whole"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

        for batch in batches:
            parts = batch.column("part").to_pylist()
            for p, i, v in zip(parts, batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                part = p
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield block()
        if ids:
            yield block()

    return run


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers: in floats while they stay below 2^53, else in integers."""
    reach = np.sqrt((queries**2).sum(axis=1).max(initial=0)) * np.sqrt((candidates**2).sum(axis=1).max(initial=0))
    if reach < 2**52:
        return (queries @ candidates.T).astype(np.int64)
    exact = np.array([[int(x) for x in q] for q in queries], dtype=object) @ np.array(
        [[int(x) for x in c] for c in candidates], dtype=object
    ).T
    return np.array([[max(min(x, 2**63 - 1), -(2**63)) for x in row] for row in exact], dtype=np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _vectors(binary: bytes, n: int) -> np.ndarray:
    return np.frombuffer(binary, dtype=np.float64).reshape(n, -1)


def _first_scores(head_ids: np.ndarray, head: np.ndarray, k: int):
    """Adds to each query block its queries' k-th best score within the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, whole = np.frombuffer(row["ids"], np.int64), _vectors(row["whole"], row["n"])
                scores = _products(whole, head).astype(np.float64)
                scores[ids[:, None] == head_ids[None, :]] = -np.inf
                kth = np.full(len(ids), -np.inf)
                if scores.shape[1] >= k:
                    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                lengths = np.sqrt((whole**2).sum(axis=1))
                # Below this length no vector reaches any query's score: the least of score / length.
                with np.errstate(divide="ignore", invalid="ignore"):
                    needed = np.where(kth <= 0, 0.0, kth / np.maximum(lengths, 1e-300))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(row["part"] << 32) + row["block"]], pa.int64()),
                        pa.array([row["n"]], pa.int32()),
                        pa.array([row["ids"]], pa.binary()),
                        pa.array([row["whole"]], pa.binary()),
                        pa.array([kth.tobytes()], pa.binary()),
                        pa.array([float(needed.min(initial=np.inf))], pa.float64()),
                    ],
                    ["queries", "qn", "qids", "qwhole", "kth", "needed"],
                )

    return run


def _searched(turn: np.ndarray, k: int):
    """Best candidates of each (query block, block) row, pruned by lengths and partial products."""
    lead = max(1, len(turn) // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qids, ids = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, c = _vectors(row["qwhole"], row["qn"]), _vectors(row["whole"], row["n"])
                kth = np.frombuffer(row["kth"], np.float64)
                qlen, clen = np.sqrt((q**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
                order = np.argsort(-clen, kind="stable")
                ids, c, clen = ids[order], c[order], clen[order]
                slack = 1e-9 * (1.0 + qlen * (clen[0] if len(clen) else 0.0))
                # Lengths fall, so each query's reach is a prefix.
                with np.errstate(divide="ignore"):
                    least = np.where(kth - slack <= 0, -1.0, (kth - slack) / np.maximum(qlen, 1e-300))
                reach = np.searchsorted(-clen, -least, side="right")
                end = int(reach.max(initial=0))
                turned_q, turned_c = q @ turn, c[:end] @ turn
                rest_q = np.sqrt((turned_q[:, lead:] ** 2).sum(axis=1))
                rest_c = np.sqrt((turned_c[:, lead:] ** 2).sum(axis=1))
                bound = turned_q[:, :lead] @ turned_c[:, :lead].T + rest_q[:, None] * rest_c[None, :]
                open_pairs = bound >= (kth - slack)[:, None]
                open_pairs &= np.arange(end)[None, :] < reach[:, None]
                open_pairs &= qids[:, None] != ids[None, :end]
                out: list[tuple] = []
                for i in np.flatnonzero(open_pairs.any(axis=1)):
                    near = np.flatnonzero(open_pairs[i])
                    scores = _products(q[i : i + 1], c[near])[0]
                    for j in _best(scores, ids[near], k):
                        if scores[j] >= kth[i]:
                            out.append((qids[i], ids[near[j]], scores[j]))
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    return run


def _rotation(vectors: DataFrame, dims: int, scale: float, total: int) -> np.ndarray:
    share = min(1.0, SAMPLE / max(total, 1))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) / 1_000_000
    rows = vectors.filter(spread < share).select("embedding").limit(4 * SAMPLE).collect()
    sample = _scaled([r.embedding for r in rows], scale, dims)
    if not len(sample):
        return np.eye(dims)
    return np.linalg.svd(sample.T @ sample)[0]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each query's vector.

    `vectors(vec_id, embedding)`; components become floor(scale * x). Every row but
    those with the query's own vec_id is a candidate; ties go to the smaller vec_id.
    Rows whose vec_id or vector is NULL, or whose vector holds NULL or non-finite
    components, take no part; shorter vectors are filled up with zeros. A query id that
    occurs more than once is answered for one of its rows, equal candidate rows each
    count. Scores beyond 64 bits stop at the largest number. Other columns are ignored;
    an empty table gives an empty result.
    """
    number = F.col("embedding").cast("array<double>")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.filter("vec_id is not null and embedding is not null").filter(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), number.alias("embedding"), is_query.alias("is_query")
    )
    spark = vectors.sparkSession
    total, dims = clean.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    dims = max(1, dims or 0)
    turn = _rotation(clean, dims, scale, total)

    squares = F.aggregate(F.transform("embedding", lambda x: F.floor(x * scale) * F.floor(x * scale).cast("double")), F.lit(0.0), lambda a, x: a + x)
    lengths = clean.withColumn("length", squares)
    cuts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BLOCK + 1))
    sorted_rows = lengths.repartitionByRange(cuts, F.col("length").desc(), "vec_id").sortWithinPartitions(
        F.col("length").desc(), "vec_id"
    )
    blocks = materialize(
        sorted_rows.select(F.spark_partition_id().alias("part"), "vec_id", "embedding").mapInArrow(
            _packed(dims, scale, BLOCK), _PACKED
        ),
        "blocks",
    )
    asked = clean.filter("is_query").dropDuplicates(["vec_id"])
    query_blocks = asked.select(F.spark_partition_id().alias("part"), "vec_id", "embedding").mapInArrow(
        _packed(dims, scale, QUERY_BLOCK), _PACKED
    )
    longest = blocks.orderBy(F.col("longest").desc(), "part", "block").limit(1).collect()  # one block
    if longest:
        head_ids, head = np.frombuffer(longest[0].ids, np.int64), _vectors(longest[0].whole, longest[0].n)
    else:
        head_ids, head = np.zeros(0, np.int64), np.zeros((0, dims))
    queries = materialize(
        query_blocks.mapInArrow(
            _first_scores(head_ids, head, k), "queries long, qn int, qids binary, qwhole binary, kth binary, needed double"
        ),
        "queries",
    )
    # The stated queries against all rows, block by block, where lengths can reach.
    pairs = blocks.select("part", "block", "longest").join(
        queries.select("queries", "needed"), F.col("longest") >= F.col("needed") * (1 - 1e-9)
    ).select("part", "block", "queries")
    rows = pairs.join(blocks, ["part", "block"]).join(queries, "queries")
    spread = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "block", "queries")
    found = spread.select("qn", "qids", "qwhole", "kth", "n", "ids", "whole").mapInArrow(
        _searched(turn, k), "query_id long, vec_id long, score long"
    )
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )

"""Toxicity with a factorization machine over hashed terms.

Terms are words and the first letters of words, hashed. The machine scores a text
from single terms and from pairs: every term has a weight and a short vector, and
the dot product of two vectors is the weight of the pair, so a pair such as an
insult next to a mention of a group counts even where neither term does alone.

Fitting uses a bounded sample of labelled rows (`sample_rows`, dealt by a hash of
the id): Spark counts in how many toxic and clean texts of the sample each term
occurs. Half of the `terms` candidates are the best separating ones, the other half
the most frequent ones, whatever they separate. The driver gets which candidates each
text has, and from them how well each pair of candidates separates the classes beyond
its single terms; the terms that are strongest alone or in a pair become features and
are fitted. A feature counts the less the more its separation could be chance; none
is cut off for the size of the sample. Scoring reads every whole text inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import separators, slices, stem_hashes, word_hashes
from tidemark.sources.scratch import materialize

SAMPLE_ROWS = 8_000
TERMS = 4096
FEATURES = 1024
FACTORS = 8
# Lengths of word heads that are terms too, in bytes.
STEM_BYTES = (4, 5)
# What one text alone has, whatever the number of labels, tells nothing of others.
LEAST_TEXTS = 2
# Chance alone separates the classes by about so many texts; features near it count little.
CHANCE = 6.0
# Candidates paired with all others at a time, which bounds the driver's tables.
PAIR_ROWS = 512


@dataclass
class Machine:
    """Sorted term hashes with a scale, a weight and a vector each, the common weight,
    and the raw score of a text without any of the terms."""

    terms: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    base: float
    none: float


def _term_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes of all texts, text index of each)."""
    parts = separators(keep_letters_only=True)
    words, counts = word_hashes(texts, parts)
    found, owners = [words], [np.repeat(np.arange(len(texts)), counts)]
    for size in STEM_BYTES:
        stems, stem_counts = stem_hashes(texts, parts, size)
        found.append(stems)
        owners.append(np.repeat(np.arange(len(texts)), stem_counts))
    return np.concatenate(found), np.concatenate(owners)


def _pairs_of(hashes: np.ndarray, owner: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, times) of every known term of every text."""
    if not len(terms) or not len(hashes):
        none = np.zeros(0, np.int64)
        return none, none, none
    place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    known = terms[place] == hashes
    codes, times = np.unique(owner[known] * len(terms) + place[known], return_counts=True)
    return codes // len(terms), codes % len(terms), times


def _values(times: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(times)


def _raw_scores(machine: Machine, text: np.ndarray, term: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Base + weights + half of ((sum of vectors)^2 - sum of squared vectors)."""
    scores = np.full(n, machine.base)
    np.add.at(scores, text, machine.weights[term] * values)
    vectors = machine.factors[term] * values[:, None]
    sums = np.zeros((n, machine.factors.shape[1]))
    squares = np.zeros_like(sums)
    np.add.at(sums, text, vectors)
    np.add.at(squares, text, vectors**2)
    return scores + 0.5 * (sums**2 - squares).sum(axis=1)


def _labelled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: of how many toxic and clean texts each term is part."""
    for batch in batches:
        for rows, texts in slices(batch, "text"):
            hashes, owner = _term_hashes(texts)
            label = np.array(rows.column("toxic").to_pylist(), dtype=np.int64)
            terms, place = np.unique(hashes, return_inverse=True)
            codes = np.unique(place * len(texts) + owner)
            toxic = np.bincount(codes // len(texts), weights=label[codes % len(texts)], minlength=len(terms))
            every = np.bincount(codes // len(texts), minlength=len(terms))
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms.view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array((every - toxic).astype(np.int64))],
                ["term", "toxic", "clean"],
            )


def _feature_rows(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                text, term, times = _pairs_of(*_term_hashes(texts), terms)
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("toxic"),
                        pa.array([term[a:b].tolist() for a, b in zip(cut, cut[1:])], pa.list_(pa.int64())),
                        pa.array([times[a:b].tolist() for a, b in zip(cut, cut[1:])], pa.list_(pa.int64())),
                    ],
                    ["toxic", "terms", "times"],
                )

    return run


def _strength(labels: np.ndarray, text: np.ndarray, term: np.ndarray, wide: int) -> np.ndarray:
    """By how many texts of the smaller class each term separates them, alone or in its best pair."""
    n1, n0 = max(1.0, labels.sum()), max(1.0, (1 - labels).sum())
    p = np.bincount(term, weights=labels[text], minlength=wide) / n1
    q = np.bincount(term, weights=1 - labels[text], minlength=wide) / n0
    single = (p - q) ** 2 / np.maximum(p + q, 1e-9)
    has = np.zeros((len(labels), wide), dtype=np.float32)
    has[text, term] = 1.0
    toxic, clean = has[labels > 0], has[labels == 0]
    pair = np.zeros(wide)
    for at in range(0, wide, PAIR_ROWS):
        these = np.arange(at, min(at + PAIR_ROWS, wide))
        p = (toxic[:, these].T @ toxic) / np.float32(n1)
        q = (clean[:, these].T @ clean) / np.float32(n0)
        gain = (p - q) ** 2 / np.maximum(p + q, np.float32(1e-9))
        # Only what the pair tells beyond each of its terms.
        gain -= np.maximum(single[these, None], single[None, :]).astype(np.float32)
        gain[np.arange(len(these)), these] = 0
        pair[these] = np.maximum(gain.max(axis=1), 0)
    least = min(n0, n1)
    single, pair = least * single, least * pair
    # The best of so many pairs reaches about `noise` by chance.
    noise = 2 * np.log(max(2, wide))
    return np.maximum(single, pair**2 / (pair + noise))


def _fit(
    labels: np.ndarray, text: np.ndarray, term: np.ndarray, times: np.ndarray, terms: np.ndarray, share: float, rounds: int, seed: int
) -> Machine:
    """Logistic loss, whole-sample steps of Adam, a light pull towards zero.

    `share` is the part of toxic ones among all labels. A text without known terms
    scores by it, or by the fitted common weight where that is lower.
    """
    share = min(max(share, 1e-4), 1 - 1e-4)
    prior = float(np.log(share / (1 - share)))
    if not 0 < labels.sum() < len(labels) or not len(term):
        none = np.zeros(0)
        return Machine(np.zeros(0, np.uint64), none, none, np.zeros((0, FACTORS)), prior, prior)
    strength = _strength(labels, text, term, len(terms))
    best = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    place = np.full(len(terms), -1)
    place[best] = np.arange(len(best))
    known = place[term] >= 0
    text, term, times = text[known], place[term[known]], times[known]
    terms, strength = terms[best], strength[best]
    scale = (strength / (strength + CHANCE)) ** 2
    values = _values(times) * scale[term]
    rng = np.random.default_rng(seed)
    model = Machine(terms, scale, np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS)), 0.0, prior)
    # Both classes weigh the same in the loss, or the rare one would be under-scored.
    class_weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    # Rows come text by text; sums per term go over them in the order of terms.
    by_term = np.argsort(term, kind="stable")
    text_starts = np.flatnonzero(np.diff(text, prepend=-1))
    term_starts = np.flatnonzero(np.diff(term[by_term], prepend=-1))
    some_texts, some_terms = text[text_starts], term[by_term][term_starts]
    moments = [np.zeros(len(terms) * (FACTORS + 1) + 1) for _ in range(2)]
    for step in range(1, rounds + 1):
        vectors = model.factors[term] * values[:, None]
        sums, squares = np.zeros((len(labels), FACTORS)), np.zeros((len(labels), FACTORS))
        sums[some_texts] = np.add.reduceat(vectors, text_starts)
        squares[some_texts] = np.add.reduceat(vectors**2, text_starts)
        scores = model.base + 0.5 * (sums**2 - squares).sum(axis=1)
        scores[some_texts] += np.add.reduceat(model.weights[term] * values, text_starts)
        slope = (1 / (1 + np.exp(-np.clip(scores, -30, 30))) - labels) * class_weight
        part = slope[text] * values
        to_weights = np.zeros(len(terms))
        to_weights[some_terms] = np.add.reduceat(part[by_term], term_starts)
        to_factors = np.zeros_like(model.factors)
        to_factors[some_terms] = np.add.reduceat((part[:, None] * (sums[text] - vectors))[by_term], term_starts)
        flat = np.concatenate(([slope.sum()], to_weights + 1e-4 * model.weights, (to_factors + 1e-3 * model.factors).ravel()))
        moments[0] += 0.1 * (flat - moments[0])
        moments[1] += 0.01 * (flat**2 - moments[1])
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-10)
        model.base -= float(move[0])
        model.weights -= move[1 : len(terms) + 1]
        model.factors -= move[len(terms) + 1 :].reshape(model.factors.shape)
    model.none = min(model.base, prior)
    return model


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    terms: int = TERMS,
    rounds: int = 80,
    seed: int = 7,
) -> Machine:
    """A machine for `docs(doc_id, text)` with `labels(doc_id, toxic)`.

    About `sample_rows` labelled rows at most are used, dealt by a hash of the id;
    that bounds the broadcast and what the driver fits. Labels other than 0 and 1 and
    rows without text are left out. Without any row of one of the classes, or any term
    in two texts, the score is the part of toxic labels for every text.
    """
    usable = labels.filter("toxic in (0, 1) and doc_id is not null").select(
        "doc_id", F.col("toxic").cast("long").alias("toxic")
    )
    known = usable.groupBy("toxic").count().collect()  # two rows at most
    parts = {r["toxic"]: min(1.0, sample_rows / 2 / r["count"]) for r in known}
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    kept = F.lit(False)
    for label, part in parts.items():
        kept = kept | ((F.col("toxic") == label) & (spread < part))
    texts = docs.filter("text is not null").select("doc_id", "text")
    sample = materialize(texts.join(F.broadcast(usable.filter(kept)), "doc_id").select("text", "toxic"), "sample")
    n = {r["toxic"]: r["count"] * parts[r["toxic"]] for r in known}
    counts = sample.mapInArrow(_labelled_counts, "term long, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    p = F.col("toxic") / F.lit(float(max(1.0, n.get(1, 0))))
    q = F.col("clean") / F.lit(float(max(1.0, n.get(0, 0))))
    # Squared difference over its variance: frequent, one-sided terms come first.
    gain = (p - q) * (p - q) / (p + q)
    often = materialize(counts.filter(F.col("toxic") + F.col("clean") >= LEAST_TEXTS), "terms")
    separating = often.orderBy(gain.desc(), "term").select("term").limit(terms // 2)
    frequent = often.orderBy((p + q).desc(), "term").select("term").limit(terms - terms // 2)
    chosen = separating.union(frequent).distinct().collect()
    hashes = np.sort(np.array([r.term for r in chosen], dtype=np.int64).view(np.uint64))
    rows = sample.mapInArrow(_feature_rows(hashes), "toxic long, terms array<long>, times array<long>").toArrow()
    every = {r["toxic"]: r["count"] for r in known}
    sizes = pc.list_value_length(rows.column("terms")).to_numpy()
    return _fit(
        rows.column("toxic").to_numpy().astype(np.float64),
        np.repeat(np.arange(len(sizes)), sizes),
        pc.list_flatten(rows.column("terms")).to_numpy(),
        pc.list_flatten(rows.column("times")).to_numpy(),
        hashes,
        every.get(1, 0) / max(1, sum(every.values())),
        rounds,
        seed,
    )


def _scores_of(machine: Machine, texts: list[bytes | None]) -> np.ndarray:
    """Raw score of every text."""
    text, term, times = _pairs_of(*_term_hashes(texts), machine.terms)
    raw = _raw_scores(machine, text, term, _values(times) * machine.scale[term], len(texts))
    raw[np.bincount(text, minlength=len(texts)) == 0] = machine.none
    return raw


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score, predicted) of every row of `docs(doc_id, text)`, from its whole text alone.

    NULL and empty texts score as a text without any known term. Equal texts score
    equally. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                raw = _scores_of(machine, texts)
                score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int"
    )


def without_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of `docs` whose text scores below 0.5, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text"):
                yield rows.filter(pa.array(_scores_of(machine, texts) < 0))

    return docs.mapInArrow(run, docs.schema)

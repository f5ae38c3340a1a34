"""Language identification by interpolated Kneser-Ney character models.

Texts become letters in lower case with one space between runs of them. For each
language a model of `ORDER` characters is learned: the longest n-grams by counts,
shorter ones by the number of different characters before them, with one absolute
discount per order. All n-grams are 64-bit hashes in sorted arrays with a column
per language. A text goes to the language with the lowest cross-entropy per
character; the score comes from the differences, scaled so that it is calibrated on
rows left out of the counts, and a text whose entropy is far above that of its
language's own texts is marked as rejected.

N-grams are counted by Spark over labelled rows; `rows_per_language` bounds how
many rows a language gives (dealt by a hash of the id) and `grams_per_language` how
many n-grams it keeps, most frequent first, which bounds the model that is sent out.
Every language with a labelled letter keeps some of both, and lends rows to the
calibration only if it has plenty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark.llm.words import mix, slices, worker_cache
from tidemark.sources.scratch import materialize

ORDER = 4
ROWS_PER_LANGUAGE = 5_000
GRAMS_PER_LANGUAGE = 500_000
# One row in so many is left out of the counts, to calibrate on.
LEFT_OUT = 10
# Languages with fewer labelled rows than this have all of them counted.
PLENTY = 5 * LEFT_OUT
# Text bytes worked on at a time; each becomes some dozen bytes of arrays.
PART = 1 << 19

SPACE = 0x20
UNKNOWN = "und"


@dataclass
class Order:
    """One order's n-grams and contexts: sorted hashes, a row per hash, a column per language."""

    grams: np.ndarray
    discounted: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    passed: np.ndarray


@dataclass
class LanguageModel:
    languages: list[str]
    orders: list[Order]
    unseen: np.ndarray
    sharpness: float
    limits: np.ndarray


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a space."""
    cache = worker_cache()
    if "letters" not in cache:
        table = np.full(0x110000, SPACE, dtype=np.uint32)
        for code in range(0x30000):  # planes with letters that are not ideographs end far below
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        table[0x30000:0x33480] = np.arange(0x30000, 0x33480)
        cache["letters"] = table
    return cache["letters"]


def _characters(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, each text framed by one space at its end; text of each)."""
    table = _letters()
    every, owner = [], []
    for i, text in enumerate(texts):
        codes = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
        letters = table[codes]
        space = letters == SPACE
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        letters = letters[keep]
        if len(letters):
            every.append(np.concatenate((letters, [np.uint32(SPACE)])))
            owner.append(np.full(len(letters) + 1, i))
    if not every:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(every), np.concatenate(owner)


def _hashes(characters: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1-, 2-, ... gram that ends at each character; before a text stand spaces."""
    codes = characters.astype(np.uint64)
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    made = [mix(codes + np.uint64(1))]
    blank = [mix(np.array([SPACE + 1], dtype=np.uint64))]
    for _ in range(1, ORDER):
        before = np.concatenate((blank[-1], made[-1][:-1]))
        before[first] = blank[-1]
        made.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + codes))
        blank.append(mix(blank[-1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SPACE)))
    return made


def _contexts(grams: list[np.ndarray], owner: np.ndarray) -> list[np.ndarray]:
    """The hash before each n-gram's last character: nothing for single characters."""
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    blank = mix(np.array([SPACE + 1], dtype=np.uint64))
    made = [np.zeros(len(owner), dtype=np.uint64)]
    for shorter in grams[:-1]:
        before = np.concatenate((blank, shorter[:-1]))
        before[first] = blank
        made.append(before)
        blank = mix(blank * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SPACE))
    return made


_GRAMS = [f"g{n}" for n in range(1, ORDER + 1)]
_CONTEXTS = [f"c{n}" for n in range(1, ORDER + 1)]


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language: each longest n-gram with its shorter forms and count."""
    for batch in batches:
        for rows, texts in slices(batch, "text", PART):
            characters, owner = _characters(texts)
            if not len(owner):
                continue
            grams = _hashes(characters, owner)
            contexts = _contexts(grams, owner)
            languages = rows.column("lang").to_pylist()
            names = sorted(set(languages))
            of_text = np.array([names.index(x) for x in languages])
            for number, name in enumerate(names):
                mine = np.flatnonzero(of_text[owner] == number)
                if not len(mine):
                    continue
                _, place, count = np.unique(grams[-1][mine], return_index=True, return_counts=True)
                place = mine[place]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(place)),
                        pa.array(count.astype(np.int64)),
                        *[pa.array(x[place].view(np.int64)) for x in (*grams, *contexts)],
                    ],
                    ["lang", "n", *_GRAMS, *_CONTEXTS],
                )


def _table(keys: np.ndarray, language: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sums of `values` per key and language."""
    distinct, place = np.unique(keys, return_inverse=True)
    sums = np.zeros((len(distinct), count))
    np.add.at(sums, (place, language), values)
    return distinct, sums


def _build(counts: dict[str, np.ndarray], languages: list[str]) -> LanguageModel:
    wide = len(languages)
    language = counts["lang"]
    orders: list[Order] = []
    weights = counts["n"].astype(np.float64)
    kept = np.arange(len(language))
    for n in range(ORDER, 0, -1):
        grams, contexts = counts[f"g{n}"][kept], counts[f"c{n}"][kept]
        # Distinct n-grams of a language: raw counts at the top, else how many characters come before.
        pair = mix(grams) + language[kept].astype(np.uint64)
        _, first, place = np.unique(pair, return_index=True, return_inverse=True)
        worth = weights[kept] if n == ORDER else np.ones(len(kept))
        amount = np.bincount(place, weights=worth)
        kept, grams, contexts = kept[first], grams[first], contexts[first]
        once = np.bincount(language[kept], weights=amount == 1, minlength=wide)
        twice = np.bincount(language[kept], weights=amount == 2, minlength=wide)
        discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        mine = discount[language[kept]]
        keys, discounted = _table(grams, language[kept], np.maximum(amount - mine, 0), wide)
        places, totals = _table(contexts, language[kept], amount, wide)
        _, passed = _table(contexts, language[kept], np.minimum(mine, amount), wide)
        orders.append(Order(keys, discounted, places, totals, passed))
    # One alphabet for all, or an unknown character would be cheap where few are known.
    alphabet = len(orders[-1].grams) + 1.0
    # Without calibration, a text must fit better than characters drawn blindly.
    return LanguageModel(languages, orders[::-1], np.full(wide, 1.0 / alphabet), 1.0, np.full(wide, np.log(alphabet)))


def _rows_of(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros((len(table), values.shape[1]))
    place = np.minimum(np.searchsorted(keys, table), len(keys) - 1)
    return np.where((keys[place] == table)[:, None], values[place], 0.0)


def _entropies(model: LanguageModel, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per character of each text in each language, its letters and spaces)."""
    wide = len(model.languages)
    characters, owner = _characters(texts)
    sizes = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    if not len(owner):
        return np.zeros((len(texts), wide)), sizes
    grams = _hashes(characters, owner)
    contexts = _contexts(grams, owner)
    _, place, back = np.unique(grams[-1], return_index=True, return_inverse=True)
    chance = np.broadcast_to(model.unseen, (len(place), wide))
    for n, order in enumerate(model.orders):
        totals = _rows_of(contexts[n][place], order.contexts, order.totals)
        passed = _rows_of(contexts[n][place], order.contexts, order.passed)
        direct = _rows_of(grams[n][place], order.grams, order.discounted)
        known = totals > 0
        safe = np.where(known, totals, 1.0)
        chance = np.where(known, (direct + passed * chance) / safe, chance)
    cost = -np.log(chance)
    sums = np.stack([np.bincount(owner, weights=cost[back, i], minlength=len(texts)) for i in range(wide)], axis=1)
    return sums / np.maximum(sizes, 1)[:, None], sizes


def _decide(model: LanguageModel, entropy: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its score, whether its entropy is above the language's limit) per text."""
    best = entropy.argmin(axis=1)
    lowest = entropy[np.arange(len(best)), best]
    weight = np.exp(-model.sharpness * np.sqrt(np.maximum(sizes, 1))[:, None] * (entropy - lowest[:, None]))
    return best, 1.0 / weight.sum(axis=1), lowest > model.limits[best]


def _entropy_rows(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text", PART):
                entropy, sizes = _entropies(model, texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("lang"), pa.array(sizes.astype(np.int64)), pa.array(entropy.tolist(), pa.list_(pa.float64()))],
                    ["lang", "size", "entropy"],
                )

    return run


def _calibrated(model: LanguageModel, left_out: DataFrame) -> LanguageModel:
    """Sharpness with the least log loss, limits four deviations above a language's own mean."""
    rows = left_out.select("lang", "text").mapInArrow(
        _entropy_rows(model), "lang string, size long, entropy array<double>"
    ).filter("size > 0").toArrow().to_pydict()
    number = {name: i for i, name in enumerate(model.languages)}
    known = [i for i, x in enumerate(rows["lang"]) if x in number]
    right = np.array([number[rows["lang"][i]] for i in known], dtype=np.int64)
    if not len(right):
        return model
    entropy, sizes = np.array(rows["entropy"])[known], np.array(rows["size"])[known]
    gaps = np.sqrt(sizes)[:, None] * (entropy - entropy.min(axis=1, keepdims=True))
    losses = []
    for sharpness in 2.0 ** np.arange(-4, 6):
        weight = -sharpness * gaps
        losses.append((np.mean(np.log(np.exp(weight).sum(axis=1)) - weight[np.arange(len(right)), right]), sharpness))
    model.sharpness = float(min(losses)[1])
    own = entropy[np.arange(len(right)), right]
    for i in range(len(model.languages)):
        if (right == i).sum() >= 5:
            model.limits[i] = own[right == i].mean() + 4 * own[right == i].std() + 0.05
    return model


def _no_languages() -> LanguageModel:
    return LanguageModel([], [], np.zeros(0), 1.0, np.zeros(0))


def train_languages(
    labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, grams_per_language: int = GRAMS_PER_LANGUAGE, seed: int = 5
) -> LanguageModel:
    """A model of `labelled(doc_id, text, lang)`; rows without a letter or lang are left out.

    Without any usable row the model knows no language, and every text is unknown.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    spread = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    usable = usable.withColumn("_spread", spread)
    sizes = {  # a row per language
        r["lang"]: r for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("_spread").alias("first")).collect()
    }
    if not sizes:
        return _no_languages()

    def of_language(values: dict) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("lang"))

    share = of_language({k: min(1.0, rows_per_language / r["rows"]) for k, r in sizes.items()})
    # The row with the least spread is always counted: no language loses all of its rows.
    first = F.col("_spread") == of_language({k: r["first"] for k, r in sizes.items()})
    sample = usable.filter((F.col("_spread") < share) | first)
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 1)), F.lit(LEFT_OUT))
    left_out = (turn == 0) & of_language({k: r["rows"] >= PLENTY for k, r in sizes.items()}) & ~first
    counted = sample.filter(~left_out).select("text", "lang")
    kind = "lang string, n long, " + ", ".join(f"{c} long" for c in (*_GRAMS, *_CONTEXTS))
    top = _GRAMS[-1]
    rest = [c for c in (*_GRAMS, *_CONTEXTS) if c != top]
    grams = counted.mapInArrow(_count_rows, kind).groupBy("lang", top).agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in rest]
    )
    grams = materialize(grams, "grams")
    dealt = F.xxhash64(top, F.lit(seed))
    ranked = grams.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("many"), F.min(dealt).alias("first"))
    # The least count a language keeps, from how many n-grams have each count.
    upto = ranked.withColumn("upto", F.sum("many").over(W.partitionBy("lang").orderBy(F.col("n").desc())))
    least = upto.groupBy("lang").agg(
        F.min(F.when(F.col("upto") <= grams_per_language, F.col("n"))).alias("least"),
        F.max(F.struct("n", "many", "first")).alias("top"),
    )
    # Where even the most frequent ones are too many, a part of them is dealt by hash.
    part = F.pmod(dealt, F.lit(1_000_000)) < F.lit(1_000_000 * grams_per_language) / F.col("top.many")
    dealt_in = F.col("least").isNull() & (F.col("n") == F.col("top.n")) & (part | (dealt == F.col("top.first")))
    kept = grams.join(least, "lang").filter((F.col("n") >= F.col("least")) | dealt_in).drop("least", "top").toArrow()
    languages = sorted(set(kept.column("lang").to_pylist()))
    if not languages:
        return _no_languages()
    number = {name: i for i, name in enumerate(languages)}
    counts = {
        c: np.ascontiguousarray(kept.column(c).to_numpy()).view(np.uint64) for c in (*_GRAMS, *_CONTEXTS)
    } | {
        "n": kept.column("n").to_numpy(),
        "lang": np.array([number[x] for x in kept.column("lang").to_pylist()], dtype=np.int64),
    }
    model = _build(counts, languages)
    return _calibrated(model, sample.filter(left_out))


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row of `docs(doc_id, text)`, from its whole text.

    A text that is NULL or has no letter is `und` with score 0 and rejected. Any other
    text gets the best language; `rejected` tells that it fits even that one badly. Of
    equal entropies the first language in order wins. Other columns are ignored; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, "text", PART):
                n = len(texts)
                if model.languages:
                    entropy, sizes = _entropies(model, texts)
                    best, score, bad = _decide(model, entropy, sizes)
                    # A lone space is left of a text without letters.
                    none = sizes <= 2
                    if none.any():
                        for i in np.flatnonzero(none):
                            none[i] = not any(c.isalpha() for c in (texts[i] or b"").decode("utf-8", "replace"))
                else:
                    best, score, bad, none = np.zeros(n, int), np.zeros(n), np.ones(n, bool), np.ones(n, bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array([UNKNOWN if x else model.languages[b] for x, b in zip(none, best)], pa.string()),
                        pa.array(np.where(none, 0.0, score)),
                        pa.array(bad | none),
                    ],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )

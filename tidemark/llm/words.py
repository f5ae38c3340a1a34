"""Words and shingles of whole texts as 64-bit hashes, in numpy, inside tasks.

Texts arrive as UTF-8 bytes. Separators are single ASCII bytes, so cutting the
bytes cuts the same words as cutting the characters. A-Z is lower-cased by the
same table. Work goes in small steps, so working memory
does not follow the length of a text.
"""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Text bytes handed on at a time, and bytes hashed at a time (to stay in a core's cache).
SLICE = 1 << 20
STEP = 1 << 16

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for things costly to load."""
    holder = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    return holder.__dict__.setdefault("cache", {})


def separators(keep_letters_only: bool = False) -> np.ndarray:
    """Which bytes part words: white space, or every ASCII byte but letters and digits."""
    table = np.zeros(256, dtype=bool)
    if keep_letters_only:
        table[:128] = True
        for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
            table[ord(first) : ord(last) + 1] = False
    else:
        table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    if len(cache.get("powers", ((), ()))[0]) < length:
        made = []
        for base in (_MULTIPLIER, _INVERSE):
            steps = np.full(length, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        cache["powers"] = tuple(made)
    return cache["powers"]


def _slice_hashes(
    buffer: np.ndarray, parts: np.ndarray, lower: np.ndarray, first_bytes: int | None
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of one slice, or of the heads of longer words."""
    inside = ~parts[buffer]
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    if first_bytes:
        longer = ends - starts > first_bytes
        starts = starts[longer]
        ends = starts + first_bytes
    up, down = _powers(STEP + 2)
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum((lower[buffer].astype(np.uint64) + np.uint64(1)) * up[: len(buffer)], out=sums[1:])
    values = (sums[ends] - sums[starts]) * down[starts]
    return mix(values + mix((ends - starts + (1 << 32 if first_bytes else 0)).astype(np.uint64))), starts


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    new = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]


def stem_hashes(texts: list[bytes | None], parts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the first `size` bytes of each longer word, number of them per text)."""
    return word_hashes(texts, parts, size)


def word_hashes(
    texts: list[bytes | None], parts: np.ndarray, first_bytes: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text), in order; None has no words."""
    lower = _lower_table()
    joined = np.frombuffer(b" ".join(t or b"" for t in texts), dtype=np.uint8)
    sizes = np.array([len(t or b"") for t in texts], dtype=np.int64)
    firsts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    hashes, places, at = [], [], 0
    while at < len(joined):
        stop = min(at + STEP, len(joined))
        if stop - at == STEP:
            gaps = np.flatnonzero(parts[joined[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # one word longer than a step
                while stop < len(joined) and not parts[joined[stop]]:
                    more = np.flatnonzero(parts[joined[stop : stop + STEP]])
                    stop = stop + int(more[0]) if len(more) else min(stop + STEP, len(joined))
                digest = hashlib.blake2b(lower[joined[at:stop]].tobytes(), digest_size=8).digest()
                hashes.append(np.frombuffer(digest, dtype=np.uint64))
                places.append(np.array([at]))
                at = stop
                continue
        found, starts = _slice_hashes(joined[at:stop], parts, lower, first_bytes)
        hashes.append(found)
        places.append(starts + at)
        at = stop
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.concatenate(places) if places else np.zeros(0, np.int64)
    owner = np.searchsorted(firsts, where, side="right") - 1
    return every, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def shingle_sets(texts: list[bytes | None], width: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text, one after another; set sizes).

    A text with fewer than `width` words has its whole sequence as one shingle, a
    text without words has none.
    """
    words, counts = word_hashes(texts, parts)
    starts = np.concatenate(([0], np.cumsum(counts)))
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for i in range(width if len(rolled) else 0):
        rolled += words[i : len(words) - width + 1 + i] * np.uint64(_MULTIPLIER + 2 * i)
        rolled = mix(rolled)
    sets, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, count in enumerate(counts):
        if count >= width:
            made = _distinct(rolled[starts[i] : starts[i] + count - width + 1])
        elif count:
            text = words[starts[i] : starts[i + 1]].tobytes()
            made = np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), dtype=np.uint64)
        else:
            continue
        sets.append(made)
        sizes[i] = len(made)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The batch in runs of rows whose texts make up about `limit` bytes."""
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= limit or i + 1 == len(texts):
            yield batch.slice(first, i + 1 - first), texts[first : i + 1]
            first, size = i + 1, 0

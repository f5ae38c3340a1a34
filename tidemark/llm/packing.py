"""Vector bin packing of examples into training sequences.

An item has several sizes at once: its tokens, its segment (always one) and its
loss-bearing tokens. A sequence has a limit for each. Sequences are filled one at
a time: of the waiting items that fit, the one whose sizes, taken as shares of the
limits, have the largest dot product with the room left goes in. So an item that
needs most of what is still plentiful comes first.

Packing runs inside the tasks that read the rows, on a window of waiting items of
bounded length, so nothing is shuffled and no key can be hot. A retried task reads
the same rows in the same order and forms the same sequences.
"""

from __future__ import annotations

import os
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import slices, worker_cache

# Waiting items of one task: filling starts at the upper count and stops at the lower.
WINDOW = (1024, 2048)
# Words whose token ids a worker remembers.
CACHE_WORDS = 1_000_000
# Texts whose unknown words are learned together.
TEXTS = 4


class _Waiting:
    """Items waiting for a sequence: a row per limit with the items' sizes, and a payload each."""

    def __init__(self, limits: tuple[int, int, int]):
        self.limits = np.array(limits, dtype=np.float64)
        self.sizes = np.zeros((3, 0))
        self.here = np.zeros(0, dtype=bool)
        self.items: list = []
        self.count = 0

    def add(self, sizes: list[tuple[int, int, int]], items: list) -> None:
        if items:
            self.sizes = np.concatenate((self.sizes, np.array(sizes, dtype=np.float64).T), axis=1)
            self.here = np.concatenate((self.here, np.ones(len(items), dtype=bool)))
            self.items.extend(items)
            self.count += len(items)

    def drop(self, picked: list[int]) -> None:
        self.here[picked] = False
        self.count -= len(picked)

    def close_gaps(self) -> None:
        self.items = [self.items[i] for i in np.flatnonzero(self.here)]
        self.sizes = self.sizes[:, self.here]
        self.here = np.ones(len(self.items), dtype=bool)

    def longest(self) -> int:
        return int(np.argmax(np.where(self.here, self.sizes[0], -1.0)))

    def fill(self) -> tuple[list[int], np.ndarray]:
        """The items of one sequence in order, and the room that is left."""
        room = self.limits.copy()
        free = np.flatnonzero(self.here)
        sizes = self.sizes[:, free]
        picked: list[int] = []
        while True:
            # Room only shrinks, so what does not fit once never will.
            fits = (sizes[0] <= room[0]) & (sizes[1] <= room[1]) & (sizes[2] <= room[2])
            free, sizes = free[fits], sizes[:, fits]
            if not len(free):
                return picked, room
            best = int(np.argmax((room / self.limits**2) @ sizes))
            picked.append(int(free[best]))
            room -= sizes[:, best]
            sizes[:, best] = np.inf


def _sequence_ids() -> Iterator[int]:
    base = TaskContext.get().partitionId() << 40
    number = 0
    while True:
        yield base + number
        number += 1


# ---- whole examples ----


def pack_examples(
    examples: DataFrame, max_tokens: int = 2048, max_segments: int = 64, max_loss_tokens: int = 2048
) -> DataFrame:
    """`examples(example_id, n_tokens, n_loss_tokens)` with (sequence_id, offset) added.

    Examples are never cut. One that breaks a limit by itself, or whose sizes are
    NULL, gets a NULL sequence and offset; one of 0 tokens takes a segment only.
    Equal rows are packed each. Other columns are left out; an empty table gives an
    empty result.
    """
    limits = (max_tokens, max_segments, max_loss_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, waiting = _sequence_ids(), _Waiting(limits)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def placed(least: int) -> list[tuple]:
            rows = []
            while waiting.count > least:
                picked, _ = waiting.fill()
                number, offset = next(ids), 0
                for i in picked:
                    rows.append((*waiting.items[i], number, offset))
                    offset += waiting.items[i][1]
                waiting.drop(picked)
            waiting.close_gaps()
            return rows

        names = ["example_id", "n_tokens", "n_loss_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows = []
            for item in zip(*(c.to_pylist() for c in batch.columns)):
                _, tokens, loss = item
                if tokens is None or loss is None or tokens > max_tokens or loss > max_loss_tokens:
                    rows.append((*item, None, None))
                    continue
                waiting.add([(tokens, 1, loss)], [item])
                if waiting.count >= WINDOW[1]:
                    rows += placed(WINDOW[0])
            yield table(rows)
        yield table(placed(0))

    longs = [F.col(c).cast("long").alias(c) for c in ("example_id", "n_tokens", "n_loss_tokens")]
    return examples.select(*longs).mapInArrow(
        run, "example_id long, n_tokens long, n_loss_tokens long, sequence_id long, offset long"
    )


# ---- documents ----


class WordTokens:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, remembered per word.

    For vocabularies that drop white space and never join across it, and that
    compare ASCII letters case-blind: a text's ids are then those of its words.
    """

    def __init__(self, path: str):
        # Tasks share the cores already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)}
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _bytes(ids: Iterable[int]) -> bytes:
        made = array("I", ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(x.ids) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        known, plain, letters, alone = self.known, {}, [], []
        tokenize, to_bytes = self.tokenizer.model.tokenize, self._bytes
        for word in words:
            core = word.rstrip(b".,;:!?")
            if core != word and core[-1:].isalnum():
                end = word[len(core) :]
                if end not in known:
                    known[end] = self._alone([end.decode()])[0]
                plain[word] = (core, end)
                word = core
            if word in known:
                continue
            known[word] = b""
            if word.isalpha():  # ASCII letters only
                known[word] = to_bytes([t.id for t in tokenize(word.decode())])
            else:
                (letters if word.decode("utf-8", "replace").isalpha() else alone).append(word)
        joined = " ".join(x.decode("utf-8", "replace") for x in letters)
        ids = self.tokenizer.encode(joined, add_special_tokens=False).ids if letters else []
        cut = [i + 1 for i, x in enumerate(ids) if x in self.ends]
        if len(cut) == len(letters):
            for word, a, b in zip(letters, [0, *cut], cut):
                known[word] = to_bytes(ids[a:b])
        else:
            alone += letters
        known.update(zip(alone, self._alone([x.decode("utf-8", "replace") for x in alone])))
        for word, (core, end) in plain.items():
            known[word] = known[core] + known[end]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        made: list[bytes] = []
        for i in range(0, len(texts), TEXTS):
            made += self._encode_some(texts[i : i + TEXTS])
        return made

    def _encode_some(self, texts: list[bytes | None]) -> list[bytes]:
        special = [i for i, t in enumerate(texts) if t and any(s in t for s in self.special)]
        words = [(t or b"").lower().split() for t in texts]
        for i in special:
            words[i] = []
        missing = set().union(*words).difference(self.known)
        if missing:
            self._learn(missing)
        of = self.known.__getitem__
        made = [b"".join(map(of, x)) for x in words]
        for i in special:
            made[i] = self._alone([texts[i].decode("utf-8", "replace")])[0]
        return made


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    max_tokens: int = 2048,
    max_segments: int = 2048,
    max_loss_tokens: int = 2048,
    cut_from: int = 32,
) -> DataFrame:
    """Pieces of `docs(doc_id, text)` in sequences of at most `max_tokens` tokens.

    Returns doc_id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, loss_tokens, sequence_id, offset. A document's ids are those of its
    text and then `end_id`; NULL counts as empty. Full-length pieces are cut off
    first and are sequences of their own; the rest is packed. A piece's first token
    bears no loss. A rest is cut once more only where a sequence would stay
    `cut_from` tokens or more short. Equal rows are packed each, with or without a
    doc_id; other columns are left out; an empty table gives an empty result.
    """
    limits = (max_tokens, max_segments, max_loss_tokens)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if ("tokens", tokenizer_path) not in cache:
            cache[("tokens", tokenizer_path)] = WordTokens(tokenizer_path)
        tokens: WordTokens = cache[("tokens", tokenizer_path)]
        numbers, waiting = _sequence_ids(), _Waiting(limits)
        end = int(end_id).to_bytes(4, "little")

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def sizes(item: tuple) -> tuple[int, int, int]:
            n = len(item[2]) // 4
            return n, 1, n - 1

        def piece(item: tuple, number: int, offset: int) -> tuple:
            doc_id, start, ids, total = item
            n = len(ids) // 4
            return doc_id, start, n, ids, total, n - 1, number, offset

        def placed(least: int) -> list[tuple]:
            rows = []
            while waiting.count > least:
                picked, room = waiting.fill()
                number, offset = next(numbers), 0
                for i in picked:
                    rows.append(piece(waiting.items[i], number, offset))
                    offset += len(waiting.items[i][2]) // 4
                waiting.drop(picked)
                gap = int(min(room[0], room[2] + 1))
                if gap >= cut_from and room[1] >= 1 and waiting.count:
                    # Nothing that waits fits whole: fill up with the head of the longest.
                    i = waiting.longest()
                    doc_id, start, ids, total = waiting.items[i]
                    rows.append(piece((doc_id, start, ids[: 4 * gap], total), number, offset))
                    waiting.drop([i])
                    rest = (doc_id, start + gap, ids[4 * gap :], total)
                    waiting.add([sizes(rest)], [rest])
            waiting.close_gaps()
            return rows

        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows: list[tuple] = []
                found: list[tuple] = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokens.encode(texts)):
                    ids += end
                    total, start = len(ids) // 4, 0
                    while total - start >= max_tokens and max_loss_tokens >= max_tokens - 1:
                        item = (doc_id, start, ids[4 * start : 4 * (start + max_tokens)], total)
                        rows.append(piece(item, next(numbers), 0))
                        start += max_tokens
                    if start < total:
                        found.append((doc_id, start, ids[4 * start :], total))
                waiting.add([sizes(x) for x in found], found)
                if waiting.count >= WINDOW[1]:
                    rows += placed(WINDOW[0])
                yield table(rows)
        yield table(placed(0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run,
        "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long",
    )

"""How much conversations share: a trie of their turns, built in range shards.

Turns are numbered by a dictionary, so a conversation is a short list of numbers.
The lists are sorted and cut into ranges; every range becomes a ternary search tree
(smaller, equal and larger child) into which the median list goes first, then the
medians of both halves, so that searches among the children of a node stay short.
One pass over a tree's nodes, children before parents, adds up members, leaves and
savings.

Neighbouring ranges share nodes, but only ones on the path of their first or last
list. All other nodes are whole inside their range, with everything below them. The
shared candidates carry a digest of their path and what hangs from them inside the
range; they are merged by digest, and sums over their subtrees are formed by pointer
doubling: after k rounds a node holds the sum of all below it within 2**k levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lookups import lookup
from tidemark.operators.ordered import row_numbers
from tidemark.sources.scratch import materialize

# Turns and conversations of one tree; a range with more is cut again.
TREE_TURNS = 200_000
# Rows of an output batch.
ROWS = 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()

# A node that is whole has no key; one that other ranges may share has a key and no digest of ends.
NODES = (
    "key binary, parent_key binary, range long, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, weight long, ends string"
)
_SCHEMA = pa.schema(
    [
        ("key", pa.binary()), ("parent_key", pa.binary()), ("range", pa.int64()), ("conv_id", pa.int64()),
        ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("weight", pa.int64()), ("ends", pa.string()),
    ]
)


class TernaryTree:
    """Lists of numbers; node 0 is the empty list, and parents come before children."""

    def __init__(self) -> None:
        self.turn, self.weight, self.parent, self.depth = [-1], [0], [-1], [0]
        self.smaller, self.larger, self.equal = [-1], [-1], [-1]
        self.ends: list[list[int]] = [[]]

    def _new(self, turn: int, weight: int, parent: int) -> int:
        self.turn.append(turn)
        self.weight.append(weight)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        for links in (self.smaller, self.larger, self.equal):
            links.append(-1)
        self.ends.append([])
        return len(self.turn) - 1

    def insert(self, turns: list[int], weights: list[int], ids: list[int]) -> list[int]:
        """Add one list that ends at `ids`; the nodes on its path."""
        path, at = [0], 0
        for turn, weight in zip(turns, weights):
            links, place = self.equal, at
            while (child := links[place]) >= 0 and self.turn[child] != turn:
                links, place = (self.smaller if turn < self.turn[child] else self.larger), child
            if child < 0:
                child = links[place] = self._new(turn, weight, at)
            path.append(at := child)
        self.ends[at].extend(ids)
        return path

    def sums(self) -> tuple[list[int], list[int], list[int], list[int | None]]:
        """Members, children, leaves and smallest member of each node, children first."""
        members = [len(x) for x in self.ends]
        children, leaves = [0] * len(members), [0] * len(members)
        least = [min(x) if x else None for x in self.ends]
        for node in range(len(members) - 1, 0, -1):
            up = self.parent[node]
            members[up] += members[node]
            children[up] += 1
            leaves[node] = leaves[node] or 1
            leaves[up] += leaves[node]
            if least[up] is None or least[node] < least[up]:
                least[up] = least[node]
        return members, children, leaves, least


def insert_medians_first(tree: TernaryTree, lists: list[tuple[list[int], list[int], list[int]]]) -> dict[int, list[int]]:
    """Insert sorted lists, the median first; the paths of the first and the last."""
    kept, open_ranges = {}, [(0, len(lists))]
    while open_ranges:
        low, high = open_ranges.pop()
        if low < high:
            middle = (low + high) // 2
            path = tree.insert(*lists[middle])
            if middle in (0, len(lists) - 1):
                kept[middle] = path
            open_ranges += [(low, middle), (middle + 1, high)]
    return kept


def path_keys(tree: TernaryTree, path: list[int]) -> list[bytes]:
    """A digest for every prefix of a path, the same in all ranges."""
    digest, keys = hashlib.blake2b(digest_size=16), []
    for node in path:
        digest.update(tree.turn[node].to_bytes(8, "little", signed=True))
        keys.append(digest.digest())
    return keys


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def tree_rows(lists: list[tuple[list[int], list[int], list[int]]], number: int) -> Iterator[tuple]:
    """Rows of NODES for one range of sorted distinct lists (turns, weights, ids)."""
    tree = TernaryTree()
    keys: dict[int, bytes] = {}
    for path in insert_medians_first(tree, lists).values():
        keys |= dict(zip(path, path_keys(tree, path)))
    members, children, leaves, least = tree.sums()
    saved = [(n - 1) * w for n, w in zip(members, tree.weight)]
    inner = [0] * len(members)
    for node in range(len(members) - 1, 0, -1):
        up = tree.parent[node]
        if node not in keys:
            saved[up] += saved[node]
            if up in keys:
                inner[up] += saved[node]
    shared_below = [0] * len(members)
    shared_leaves = [0] * len(members)
    for node in keys:
        if node:
            shared_below[tree.parent[node]] += 1
            shared_leaves[tree.parent[node]] += leaves[node]
    for node, up in enumerate(tree.parent):
        end = tree.ends[node]
        if node in keys:
            whole_children = children[node] - shared_below[node]
            whole_leaves = leaves[node] - shared_leaves[node] if whole_children else 0
            yield (
                keys[node], keys.get(up), number, least[node], tree.depth[node], None, members[node],
                whole_children, whole_leaves, inner[node], tree.weight[node], _joined(end) if end else None,
            )
        else:
            digest = hashlib.sha256(_joined(end).encode()).hexdigest() if end else NO_ENDS
            yield (
                None, keys.get(up), number, least[node], tree.depth[node], None if up in keys else least[up],
                members[node], children[node], leaves[node], saved[node], tree.weight[node], digest,
            )


def _trees(batches: Iterator[pa.RecordBatch], tree_turns: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the trees of one task's rows (turns, weights, conv_id), sorted by turns and conv_id."""
    number, held = TaskContext.get().partitionId() << 32, 0
    lists: list[tuple[list[int], list[int], list[int]]] = []

    def built() -> Iterator[pa.RecordBatch]:
        rows = []
        for row in tree_rows(lists, number):
            rows.append(row)
            if len(rows) == ROWS:
                yield _record(rows)
                rows = []
        yield _record(rows)

    for batch in batches:
        for turns, weights, conv in zip(*(batch.column(c) for c in ("turns", "weights", "conv_id"))):
            turns, conv = turns.as_py(), conv.as_py()
            if held >= tree_turns:
                yield from built()
                lists, held, number = [], 0, number + 1
            if lists and lists[-1][0] == turns:
                lists[-1][2].append(conv)
                held += 1
            else:
                lists.append((turns, weights.as_py(), [conv]))
                held += len(turns) + 1
    if lists:
        yield from built()


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces of ends, which come sorted by (key, range), joined by commas."""
    schema = pa.schema([("key", pa.binary()), ("digest", pa.string())])
    now, digest = None, None
    for batch in batches:
        keys, made = [], []
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key != now:
                if now is not None:
                    keys.append(now)
                    made.append(digest.hexdigest())
                now, digest = key, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(made, pa.string())], schema=schema)
    last = ([now], [digest.hexdigest()]) if now is not None else ([], [])
    yield pa.RecordBatch.from_arrays([pa.array(last[0], pa.binary()), pa.array(last[1], pa.string())], schema=schema)


def subtree_sums(nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """`nodes(key, parent_key, *values)` with each value summed over the node's subtree.

    Round k adds what the nodes 2**k levels below hold; then pointers skip as far again.
    """
    held = nodes.select("key", F.col("parent_key").alias("up"), *values)
    reach = 1
    while reach <= deepest:
        sent = held.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(
            *[F.sum(v).alias(f"__{v}") for v in values]
        )
        hops = held.filter(F.col("up").isNotNull()).select(F.col("key").alias("up"), F.col("up").alias("__next"))
        held = materialize(
            lookup(held.join(sent, "key", "left"), hops, ["up"]).select(
                "key", F.col("__next").alias("up"), *[(F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values]
            ),
            "subtrees",
        )
        reach *= 2
    return held.drop("up")


def turn_trie(conversations: DataFrame, tree_turns: int = TREE_TURNS) -> DataFrame:
    """Nodes of the trie of `conversations(conv_id, turns, weights)`, whose arrays are parallel.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. A weight belongs to its turn. A conversation
    without turns is a member of the root; without conversations there is no node. A
    conversation's numbers must fit into a row.
    """
    spark = conversations.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        conversations.select("turns", "weights", "conv_id")
        .repartitionByRange(ranges, "turns", "conv_id")
        .sortWithinPartitions("turns", "conv_id")
    )
    found = materialize(dealt.mapInArrow(lambda batches: _trees(batches, tree_turns), NODES), "trees")

    whole = found.filter(F.col("key").isNull())
    shared = found.filter(F.col("key").isNotNull())
    merged = shared.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"),
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.max("weight").alias("weight"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    # A node has many shared children only where it has many ranges below it.
    below = merged.filter(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("shared_children")
    )
    merged = materialize(
        merged.join(below, "key", "left")
        .withColumn("n_children", F.col("n_children") + F.coalesce("shared_children", F.lit(0)))
        .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")))
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("weight"))
        .drop("shared_children"),
        "shared",
    )
    deepest = merged.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(merged, ["n_leaves", "saved_tokens"], deepest)
    pieces = shared.filter(F.col("ends").isNotNull()).select("key", "range", "ends")
    digests = pieces.repartition("key").sortWithinPartitions("key", "range").mapInArrow(_end_digests, "key binary, digest string")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    shape = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    met = (
        merged.drop("n_leaves", "saved_tokens")
        .join(sums, "key")
        .join(digests, "key", "left")
        .join(parents, "parent_key", "left")
        .withColumn("parent_conv_id", F.col("parent"))
        .withColumn("ends_sha256", F.coalesce("digest", F.lit(NO_ENDS)))
    )
    inner = (
        lookup(whole, parents, ["parent_key"])
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent"))
        .withColumnRenamed("ends", "ends_sha256")
    )
    return met.select(*shape).unionByName(inner.select(*shape))


# ---- conversations ----


def number_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn_key, weight) of `rows(conv_id, turn, role, text)`; places from 1.

    Turns are ordered by turn, NULL first, then by role and text. A weight is the text's
    UTF-8 bytes. NULL roles and texts count as empty; rows without conv_id are left out.
    """
    filled = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sized = F.octet_length("role").cast("string")
    return filled.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        # The role's length keeps ('a', 'bc') and ('ab', 'c') apart.
        F.unhex(F.sha2(F.concat(sized, F.lit(":"), "role", "text").cast("binary"), 256)).alias("turn_key"),
        F.octet_length("text").cast("long").alias("weight"),
    )


def encode_turns(numbered: DataFrame) -> DataFrame:
    """(conv_id, turns, weights) with turns as numbers of a dictionary of all distinct ones."""
    numbered = materialize(numbered, "turns")
    distinct = numbered.select("turn_key").distinct()
    dictionary = row_numbers(distinct, [], [F.col("turn_key")], "turn_id")
    encoded = lookup(numbered, dictionary, ["turn_key"], "inner")
    rows = F.array_sort(F.collect_list(F.struct("place", "turn_id", "weight")))
    return encoded.groupBy("conv_id").agg(rows.alias("x")).select(
        "conv_id", F.col("x.turn_id").alias("turns"), F.col("x.weight").alias("weights")
    )


def with_shared_heads(conversations: DataFrame, of: Column, length: Column, most: int) -> DataFrame:
    """Each conversation with its first `length` turns replaced by those of conversation `of`.

    If that one has fewer turns, all of them are taken; if it does not exist, none.
    `length` is at most `most`.
    """
    conversations = materialize(conversations, "conversations")
    heads = conversations.select(
        F.col("conv_id").alias("__of"),
        *[F.slice(c, 1, most).alias(f"__{c}") for c in ("turns", "weights")],
    )

    def rebuilt(name: str) -> Column:
        none = F.array().cast("array<bigint>")
        head = F.slice(F.coalesce(f"__{name}", none), F.lit(1), F.col("__length"))
        rest = F.slice(name, F.col("__length") + 1, F.size(name))
        return F.concat(head, rest).alias(name)

    met = conversations.withColumns({"__of": of, "__length": length.cast("int")}).join(heads, "__of", "left")
    return met.select("conv_id", rebuilt("turns"), rebuilt("weights"))

import hashlib
import random
import zlib
from collections import defaultdict

from compare import difference, duck

from tidemark.llm.queries import LLM_ORACLES, LLM_QUERIES
from tidemark.llm.turn_trie import TernaryTree, encode_turns, insert_medians_first, number_turns, turn_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(conversations):
    """Nodes of {conv_id: [(turn, weight), ...]} by the definition."""
    members, ends, weight = defaultdict(list), defaultdict(list), {(): 0}
    for conv, turns in conversations.items():
        path = tuple(t for t, _ in turns)
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
            if d:
                weight[path[:d]] = turns[d - 1][1]
        ends[path].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        found, open_paths = [], [path]
        while open_paths:
            at = open_paths.pop()
            found.append(at)
            open_paths += children[at]
        return found

    out = set()
    for path, who in members.items():
        under = below(path)
        out.add(
            (
                min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children[path]),
                sum(not children[p] for p in under), sum((len(members[p]) - 1) * weight[p] for p in under),
                hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
            )
        )
    return out


def frame(spark, conversations):
    rows = [(c, [t for t, _ in turns], [w for _, w in turns]) for c, turns in conversations.items()]
    return spark.createDataFrame(rows, "conv_id long, turns array<long>, weights array<long>")


def trie(df, **options):
    rows = [tuple(r) for r in turn_trie(df, **options).select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_conversations(seed, n):
    rng = random.Random(seed)
    made = {}
    for c in range(n):
        turns = rng.choice(list(made.values()))[: rng.randrange(7)] if made and rng.random() < 0.7 else []
        more = [rng.randrange(4) for _ in range(rng.randrange(4))]
        made[c * 7 % 101 + c] = [(t, 10 * t + 1) for t in [*(t for t, _ in turns), *more]]
    return made


def test_equals_brute_force_whatever_the_ranges(spark):
    for seed in range(3):
        made = some_conversations(seed, 60)
        for size in (1, 7, 200_000):
            assert trie(frame(spark, made), tree_turns=size) == brute(made)


def test_deep_paths_and_large_groups_of_copies(spark):
    long = [(i % 5, 3) for i in range(150)]
    made = {c: long for c in range(40)} | {100 + c: long[:c] for c in range(0, 140, 9)} | {500: [*long, (9, 2)]}
    assert trie(frame(spark, made), tree_turns=64) == brute(made)


def test_no_turns_and_no_conversations(spark):
    assert trie(frame(spark, {5: [], 3: []})) == brute({5: [], 3: []})
    assert trie(frame(spark, {5: []}).limit(0)) == set()


def test_medians_keep_the_tree_shallow():
    lists = [([i], [1], [i]) for i in range(1023)]
    tree = TernaryTree()
    insert_medians_first(tree, lists)

    def height(root):
        deepest, open_nodes = 0, [(root, 1)]
        while open_nodes:
            node, d = open_nodes.pop()
            if node >= 0:
                deepest = max(deepest, d)
                open_nodes += [(tree.smaller[node], d + 1), (tree.larger[node], d + 1)]
        return deepest

    assert height(tree.equal[0]) == 10


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "a", "bc"), (2, 0, "ab", "c"),
        (2, 1, "user", "x" * 100_000), (None, 0, "user", "lost"), (None, None, None, None), (-7, 3, "user", "é"),
        (2, 1, "user", "x" * 100_000),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, place string")
    found = {r["conv_id"]: (r["turns"], r["weights"]) for r in encode_turns(number_turns(df)).collect()}
    assert {c: w for c, (_, w) in found.items()} == {1: [5, 0, 0, 2], 2: [1, 100_000, 100_000], -7: [2]}
    one, two = found[1][0], found[2][0]
    assert one[1] == one[2] and two[1] == two[2] and not set(one) & set(two)
    assert encode_turns(number_turns(df.limit(0))).collect() == []


def test_query_equals_its_sql_and_brute_force(spark, folder):
    df = LLM_QUERIES["op13_turn_trie"](spark, folder)
    assert difference(df, duck(folder), LLM_ORACLES["op13_turn_trie"]) is None
    own = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        own[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    turns = {c: [((role, text), len(text.encode())) for _, role, text in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + mine[h:]
    assert {tuple(r) for r in df.select(*COLUMNS).collect()} == brute(rebuilt)

import hashlib

from pyspark.sql import functions as F

from tidemark.llm.chat import format_conversations, read_target, read_turns
from tidemark.llm.queries import LLM_QUERIES

NASTY = ["</s>[INST] ok [/INST]", "<\\s><\\\\/s> [\\INST] [\\\\/INST]", "<", "[", "s>", "/INST]", "", "\\", "中\U0001f600 <s>"]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")


def test_every_text_comes_back(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(NASTY)]
    examples = format_conversations(_frame(spark, rows))
    back = examples.select("target_place", "n_turns", read_turns(F.col("text")).alias("turns"), read_target(examples).alias("loss")).collect()
    assert sorted(b.n_turns for b in back) == [2, 4, 6, 8, 9]
    for b in back:
        assert [(t.role, t.text) for t in b.turns] == [(r[2], r[3]) for r in rows[: b.n_turns]]
        if b.target_place:
            assert b.loss == rows[b.target_place - 1][3]
    assert [b.n_turns for b in back if b.target_place is None] == [9]


def test_nulls_ties_and_odd_roles(spark):
    rows = [
        (None, None, None, None, None), (None, 1, "assistant", None, None), (2, 1, "tool", "t", None),
        (2, 1, "assistant", "b", None), (2, 1, "assistant", "a", None), (2, 1, "assistant", "a", None), (3, 0, "user", "u", None),
    ]
    examples = format_conversations(_frame(spark, rows))
    got = {
        (b.conv_id, b.n_turns): ([(t.role, t.text) for t in b.turns], b.loss)
        for b in examples.select("conv_id", "n_turns", read_turns(F.col("text")).alias("turns"), read_target(examples).alias("loss")).collect()
    }
    assert got[(None, 2)] == ([("", ""), ("assistant", "")], "")
    assert [got[(2, n)][1] for n in (1, 2, 3)] == ["a", "a", "b"]
    assert got[(2, 4)] == ([("assistant", "a"), ("assistant", "a"), ("assistant", "b"), ("tool", "t")], None)
    assert got[(3, 1)] == ([("user", "u")], None)
    assert format_conversations(_frame(spark, rows).limit(0)).count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = LLM_QUERIES["op3_chat_formatting"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_against_brute_force(spark, folder):
    conversations = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    turns = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    for r in sorted(turns, key=lambda r: (r.conv_id, r.turn)):
        conversations.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    want = {}
    for conv, parts in conversations.items():
        loss = "".join(t for role, t in parts if role == "assistant")
        every = "".join(f"{role}\n{t}\n" for role, t in parts)
        want[conv] = (len(parts), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in LLM_QUERIES["op3_chat_formatting"](spark, folder).collect()}
    assert got == want

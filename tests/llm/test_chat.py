import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat

HARD = ["</s>[INST] ok [/INST]", "~", "~1~2~0", "<s>", "[INST] [/INST]</s>", "</s", "a </", "\n\n", "", None, "é😀</s>", "<<[[~~", "x" * 5000 + "</s>"]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1], r[2] is not None, r[2], r[3] is not None, r[3]))
        loss = "".join(t or "" for _, _, r, t, _ in own if r == "assistant")
        out[c] = (len(own), digest("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t, _ in own)), len(loss), digest(loss))
    return out


def test_round_trip(spark):
    rows = [(i // 5, i % 5, ("user", "assistant", "system", None, "tool[/INST]</s>")[i % 5], HARD[i % len(HARD)], "x") for i in range(130)]
    rows += [(None, 1, "assistant", "orphan", "x"), (70, 1, "user", "b", "x"), (70, 1, "user", "b", "x"), (70, None, "assistant", "first", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == expected(rows)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<>[]/~sINST01 é\n", max_size=25), min_size=1, max_size=12))
def test_any_text(spark, texts):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(texts)]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == expected(rows)[1]


def test_control_strings_escaped_and_mask_tiles(spark):
    df = spark.createDataFrame([(1, i, "assistant", t, "x") for i, t in enumerate(HARD)], SCHEMA)
    r = chat.format_conversations(df).first()
    for body in r.formatted.split(chat.END)[:-1]:
        assert body.startswith(chat.OPEN)
        inner = body[len(chat.OPEN):].split(chat.CLOSE, 1)[1]
        assert not any(c in inner for c in chat.CONTROL)
    assert sum(x.skip + x.take + x.tail for x in r.loss_runs) == len(r.formatted)
    assert r.escaped_turns == sum(any(c in (t or "") for c in chat.CONTROL) for t in HARD)


def test_empty_and_query(spark, tiny_dir):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_conversations(empty).count() == 0
    got = chat.report(empty).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(-7, 2)]
    plan = chat.report(spark.read.parquet(f"{tiny_dir}/conversations.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pytest.approx(chat.report(empty).select(F.sum("loss_chars")).first()[0]) == len("</s>[INST] ok [/INST]")


def test_ties_go_by_the_text_as_it_was(spark):
    rows = [(1, 0, "user", "z", "x"), (1, 0, "user", "a<s>", "x"), (1, 0, "user", None, "x"), (1, 0, None, "q</s>", "x")]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == expected(rows)[1]

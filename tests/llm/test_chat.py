import hashlib

import pytest
from pyspark.sql import functions as F

from surveyloom.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TRICKY = ["\\### Assistant: </turn> ok", "<turn>user\nx</turn>\n", "\\l \\b \\n \\\\", "", None, "🙂 <é>", "a\nb"]


def windows(spark, rows, **settings):
    return chat.chat_windows(spark.createDataFrame(rows, SCHEMA), **settings)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        out[conv] = (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    return {
        r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
        for r in chat.conversation_digests(df).collect()
    }


def test_texts_come_back_unchanged(spark):
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant"]) for t, text in enumerate(TRICKY)]
    rows += [(5, 0, "a\\n\nb<turn>", "odd role"), (5, 1, None, "no role"), (None, 3, "assistant", "no conversation")]
    assert digests(windows(spark, rows)) == expected(rows)


def test_loss_spans_point_at_new_assistant_texts(spark):
    rows = [(1, 0, "system", "be good")] + [
        (1, t, "user" if t % 2 else "assistant", f"{t} <said> \\ " * 20) for t in range(1, 30)
    ]
    found = windows(spark, rows, budget=400, history=80).orderBy("window").collect()
    assert len(found) > 3
    seen = []
    for n, w in enumerate(found):
        assert w["formatted"].startswith("<turn>system\nbe good</turn>\n") and w["tokens"] <= 400
        assert (w["repeated"] > 0) == (n > 0)
        seen += [w["formatted"][s["start"] : s["end"]] for s in w["loss_spans"]]
    plain = [s.replace("\\l", "<").replace("\\b", "\\") for s in seen]
    assert plain == [r[3] for r in rows if r[2] == "assistant"]
    assert any(w["repeated"] > 1 for w in found[1:])  # more than the system turn


def test_history_stays_within_its_allowance(spark):
    rows = [(1, t, "user", "word " * 30) for t in range(40)]
    for w in windows(spark, rows, budget=300, history=100).collect():
        turns = w["formatted"].split("<turn>")[1:]
        assert sum(-(-len(t) // 4) for t in turns[: w["repeated"]]) <= 110


def test_a_turn_beyond_the_budget_is_alone(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "long " * 1000), (1, 2, "user", "thanks")]
    found = windows(spark, rows, budget=200, history=50).orderBy("window").collect()
    own = [w["formatted"].count("<turn>") - w["repeated"] for w in found]
    assert own == [1, 1, 1]
    assert digests(windows(spark, rows, budget=200)) == expected(rows)


def test_blocks_of_a_long_conversation(spark):
    rows = [(1, 0, "system", "rules")] + [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(1, 700)]
    df = windows(spark, rows)
    assert df.select("block").distinct().count() == 3
    assert all(w["formatted"].startswith("<turn>system\nrules</turn>") for w in df.collect())
    assert df.agg(F.sum(F.size("loss_spans"))).first()[0] == 350
    assert digests(df) == expected(rows)


def test_system_only_where_it_opens(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "system", "late"), (1, 300, "system", "later"), (1, 301, "user", "b"), (2, 0, "system", "alone")]
    df = windows(spark, rows)
    assert {(w["conv_id"], w["block"]): w["repeated"] for w in df.collect()} == {(1, 0): 0, (1, 1): 0, (2, 0): 0}
    assert digests(df) == expected(rows)


def test_repeated_rows_ties_nulls_and_other_columns(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "y"), (1, None, "assistant", "first")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "2 as window", "'z' as ord", "0 as tokens")
    assert digests(chat.chat_windows(df)) == expected(rows)


def test_empty_table(spark):
    df = windows(spark, [])
    assert df.count() == 0 and chat.conversation_digests(df).count() == 0


def test_only_functions_of_the_engine(spark):
    plan = chat.conversation_digests(windows(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "CartesianProduct"))


@pytest.mark.parametrize("text", [t for t in TRICKY if t is not None])
def test_escaping_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string")
    e = row.select(chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).first()
    assert e["u"] == text and "<" not in e["e"]

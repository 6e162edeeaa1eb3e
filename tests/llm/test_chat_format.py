import hashlib

from levelstream.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def brute(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_round_trip_of_hard_texts(spark):
    hard = ["", "plain", "\\", "\\\\", "a\\", "</turn>", "</turn>\n", "<", "</turn", "### ", "#### x", "\\### Assistant: </turn> ok", "<\\/turn>", "##\\# ", "a: b", "\n\n", "é日本😀 </turn>\n### user: hi", "x" * 50_000 + "</turn>\n"]
    rows = [(i % 7, i, ["user", "assistant", "sys:tem\\", "### a"][i % 4], t, "clash") for i, t in enumerate(hard)]
    rows += [(100, 0, None, None, None), (None, None, "assistant", "a", None), (None, None, "assistant", "a", None)]
    made = C.format_conversations(spark.createDataFrame(rows, SCHEMA))
    assert all(r.identical for r in made.collect())
    got = {r.conv_id: tuple(r)[1:5] for r in C.digest(made).collect()}
    want = {}
    for c, _, r, t, _ in rows:
        want.setdefault(c, []).append((r or "", t or ""))
    assert got == {c: brute(t) for c, t in want.items()}


def test_least_escape(spark):
    rows = [(1, 0, "user", "a\\b", None), (2, 0, "user", "say </turn> now", None), (3, 0, "user", "plain", None)]
    got = {r.conv_id: r.formatted for r in C.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "### user: a\\\\b</turn>\n", 2: "### user: say <\\/turn> now</turn>\n", 3: "### user: plain</turn>\n"}


def test_mask_and_empty(spark):
    rows = [(1, 0, "user", "q", None), (1, 1, "assistant", "one </turn>", None), (1, 2, "assistant", "two", None)]
    r = C.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_mask] == ["one <\\/turn>", "two"]
    assert C.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_foreign_text_is_refused(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("nonsense</turn>\n### user: a</turn>\n",)], "t string").select(C.parse(F.col("t")).alias("p")).first().p
    assert got[0] is None and tuple(got[1]) == ("user", "a")

"""Layouts, escaping and digests of chat formatting against plain Python."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectile.llm.chat import DONE, SAYS, TURN, canonical_turns, conversation_digests, escape, format_turns, read_turns, unescape, unmatched_records, with_layout
from vectile.llm.suite import op7_chat

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("segment", T.StringType()), T.StructField("layout", T.StringType())])
NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|done|>\n", "<\\|turn|>", "<\\\\|", "\\", "<<SYS>> <<|", "[[/INST]]", "", "é\n\n𝒳", "<|", "|>", "$1 \\$2", "<s></s><\\/s>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((-(1 << 62) if turn is None else turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def test_escaping_is_reversible_and_complete(spark):
    draw = random.Random(1)
    texts = NASTY + ["".join(draw.choice(["<", "|", "\\", "s>", "/", "[", "INST]", "<SYS>>", ">", "a"]) for _ in range(draw.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in df.select("t", escape(F.col("t")), unescape(escape(F.col("t")))).collect():
        assert u == t
        assert not any(c in e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_turn_rows_read_back(spark):
    rows = [(1, i, draw, text) for i, (draw, text) in enumerate(zip(["user", "assistant"] * 10, NASTY))]
    rows += [(2, 0, "assistant", None), (2, None, None, "x"), (None, 1, "user", "a"), (None, 1, "assistant", "b"), (3, 5, "<|says|>", "y"), (3, 5, "<|says|>", "y"), (4, 0, "assistant", "long " * 100_000)]
    formatted = format_turns(canonical_turns(spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS)))
    got = {r.conv_id: tuple(r)[1:5] for r in conversation_digests(formatted).collect()}
    assert got == plain(rows)
    chars = {r.conv_id: r.formatted_chars for r in conversation_digests(formatted).collect()}
    sums = {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg(F.sum(F.length("segment")).alias("n")).collect()}
    assert chars == sums
    one = [r for r in formatted.collect() if r.conv_id == 1 and r.turn == 0][0]
    assert one.segment.startswith(TURN + "user" + SAYS) and one.segment.endswith(DONE) and one.loss_start is None


def test_layouts(spark):
    schema = "conv_id long, turn long, role string, text string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, prompt string, response string, instruction string, input string, output string, system string, other string"
    blank = dict.fromkeys(["turn", "role", "text", "messages", "conversations", "prompt", "response", "instruction", "input", "output", "system", "other"])
    rows = [
        {"conv_id": 1, "turn": 0, "role": "user", "text": "a"},
        {"conv_id": 2, "messages": [("user", "b"), ("assistant", "c")]},
        {"conv_id": 3, "conversations": [("human", "d"), ("gpt", "e")], "other": "x"},
        {"conv_id": 4, "prompt": "f", "response": "g", "system": "s"},
        {"conv_id": 5, "instruction": "h", "input": "i", "output": "j"},
        {"conv_id": 6, "instruction": "k", "output": "l"},
        {"conv_id": 7, "prompt": "no response"},
        {"conv_id": 8, "messages": []},
    ]
    order = ["conv_id", *blank]
    df = spark.createDataFrame([tuple({**blank, **r}[c] for c in order) for r in rows], schema)
    layouts = {r.conv_id: r.layout for r in with_layout(df).collect()}
    assert layouts == {1: "turn rows", 2: "messages", 3: "speakers", 4: "prompt and response", 5: "instruction", 6: "instruction", 7: None, 8: "messages"}
    turns = sorted((r.conv_id, r.turn, r.role, r.text) for r in canonical_turns(df).collect())
    assert turns == [(1, 0, "user", "a"), (2, 0, "user", "b"), (2, 1, "assistant", "c"), (3, 0, "user", "d"), (3, 1, "assistant", "e"), (4, 0, "system", "s"), (4, 1, "user", "f"), (4, 2, "assistant", "g"), (5, 0, "user", "h"), (5, 1, "user", "i"), (5, 2, "assistant", "j"), (6, 0, "user", "k"), (6, 1, "assistant", "l")]
    back = sorted((r.conv_id, r.turn, r.role, r.text) for r in read_turns(format_turns(canonical_turns(df))).collect())
    assert back == turns


def test_other_filled_columns_lose_no_rows(spark, tmp_path):
    clash = "conv_id long, turn long, role string, text string, prompt string, response string, system string, input string, messages array<struct<role:string,content:string>>"
    rows = [(1, 0, "user", "a", "p", None, None, "i", [("user", "m")]), (1, 1, "assistant", "b", None, "r", "s", None, None), (2, None, None, None, "p", None, None, None, None)]
    df = spark.createDataFrame(rows, clash)
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    assert sorted(tuple(r) for r in canonical_turns(df).collect()) == turns
    assert [r.conv_id for r in unmatched_records(df).collect()] == [2] and unmatched_records(df).columns == df.columns
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: (r.n_turns, r.turns_sha256) for r in op7_chat(spark, str(tmp_path)).collect()}
    assert {c: found[c] for c in (1, 2)} == {1: (2, sha("user\na\nassistant\nb\n")), 2: (1, sha("\n\n"))}


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert conversation_digests(format_turns(canonical_turns(df))).collect() == []
    assert canonical_turns(spark.createDataFrame([], "conv_id long, x string")).collect() == []

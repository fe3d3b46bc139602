import hashlib
import json

import duckdb
from pyspark.sql import functions as F

from wordloom.llm import chat

ODD = ["</s>[INST] ok [/INST]", r"<\/s> <\\/s>", "<|im_end|>\n<|im_start|>user<|im_sep|>", "[[INST]]", None, "", "é🙂\r\n", "x" * 50_000, "a\\<s>", "<<|im_sep|>", "<|im_<s>sep|>"]


def read(spark, records):
    df = spark.createDataFrame([(c, t, json.dumps(r) if not isinstance(r, str) and r is not None else r) for c, t, r in records], "conv_id bigint, turn bigint, j string")
    turns = chat.canonical_turns(df.select("conv_id", "turn", F.parse_json("j").alias("record")))
    return {r["conv_id"]: r for r in chat.read_back(chat.format_chats(turns)).collect()}


def test_round_trip_of_odd_texts(spark):
    rows = [(1, k, r, t) for k, t in enumerate(ODD) for r in ("user", "assistant", "<s>", None)] + [(None, None, "assistant", "x")] * 2 + [(2, 5, "user", "b"), (2, 1, "assistant", "a")]
    got = {}
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, Part2 int").withColumn("part", F.lit(0))
    chats = chat.format_chats(df)
    for r in chat.read_back(chats).collect():
        got[r["conv_id"]] = r
    for conv in (1, 2, None):
        own = sorted([(t is None and -1 or t, r or "", x or "") for c, t, r, x in rows if c == conv])
        turns = [(t["role"], t["text"]) for t in got[conv]["turns"]]
        assert sorted(turns) == sorted((r, x) for _, r, x in own)
        assert "".join(got[conv]["loss"]) == "".join(x for r, x in turns if r == "assistant")
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "a"), ("user", "b")]
    text = got[1]["formatted"]
    assert text.count(chat.END) == len(ODD) * 4 and "</s>" not in text and "[INST]" not in text


def test_layouts_give_the_same_turns(spark):
    two = [("user", "q"), ("assistant", "a")]
    records = [
        (1, 0, {"prompt": "q", "completion": "a"}), (2, 0, {"instruction": "q", "output": "a"}), (3, 0, {"instruction": "q", "input": "", "output": "a"}),
        (4, 0, {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}),
        (5, 0, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}), (6, 0, {"role": "user", "text": "q"}), (6, 1, {"role": "assistant", "text": "a"}),
        (7, 0, {"messages": []}), (8, 0, {"odd": [1, {"x": None}]}), (9, 0, None), (10, 0, {"prompt": None, "response": "a"}),
    ]
    got = {c: [tuple(t) for t in r["turns"]] for c, r in read(spark, records).items()}
    assert all(got[c] == two for c in range(1, 7))
    assert 7 not in got and got[8] == [("unknown", '{"odd":[1,{"x":null}]}')] and got[9] == [("unknown", "")] and got[10] == [("user", ""), ("assistant", "a")]


def test_long_conversation_and_oracle(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k} </s>") for k in range(1500)] + [(2, 0, "user", "only")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_back(chat.format_chats(chat.canonical_turns(chat.records_of(frame))))
    got = {r["conv_id"]: r for r in back.collect()}
    con = duckdb.connect()
    con.register("conversations", frame.toPandas())
    for conv, n, turns, chars, loss, total in con.execute(chat._SQL).fetchall():
        r = got[conv]
        said = "".join(f"{t['role']}\n{t['text']}\n" for t in r["turns"])
        assert (n, turns, chars, loss, total) == (len(r["turns"]), hashlib.sha256(said.encode()).hexdigest(), len("".join(r["loss"])),
                                                  hashlib.sha256("".join(r["loss"]).encode()).hexdigest(), len(r["formatted"]))
    assert set(got) == {1, 2, -7}
    empty = chat.read_back(chat.format_chats(chat.canonical_turns(chat.records_of(frame.limit(0))))).collect()
    assert [r["conv_id"] for r in empty] == [-7]

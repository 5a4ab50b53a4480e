from __future__ import annotations

import hashlib
import json
import random

from pyspark.sql import functions as F

from flowlake.llm import chat, registry

SF = "/root/testdata/sf0.001"
RECORDS = {
    "prompt_completion": ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    "prompt_response": ({"response": "c", "prompt": None}, [("user", ""), ("assistant", "c")]),
    "system_prompt_response": ({"system": "", "prompt": "p", "response": "c"}, [("user", "p"), ("assistant", "c")]),
    "question_answer": ({"question": "q", "answer": 5}, [("user", "q"), ("assistant", "5")]),
    "instruction": ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    "instruction_input": ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i"), ("user", "x"), ("assistant", "o")]),
    "messages": ({"messages": [{"role": "system", "content": "s"}, {"role": None, "content": None}]}, [("system", "s"), ("", "")]),
    "no_messages": ({"messages": []}, []),
    "message_parts": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [("user", "ab")]),
    "conversations": ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, [("user", "h"), ("assistant", "g")]),
    "nested_prompt": ({"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}, [("user", "p"), ("assistant", "c")]),
    "turn": ({"role": "tool", "text": "t"}, [("tool", "t")]),
}


def _json(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, record string")


def _turns(row):
    return [(t["role"], t["text"]) for t in row["turns"]]


def test_fingerprints_select_the_layout(spark):
    got = chat.canonical_turns(_json(spark, [json.dumps(r) for r, _ in RECORDS.values()]), "record").orderBy("id").collect()
    assert [r["layout"] for r in got] == list(RECORDS)
    assert [_turns(r) for r in got] == [turns for _, turns in RECORDS.values()]
    assert len({chat.path_tree(x.paths) for x in chat.LAYOUTS.values()}) == len(chat.LAYOUTS)


def test_unknown_layouts_are_told_not_guessed(spark):
    odd = ['{"prompt": "p", "completion": "c", "more": 1}', "no json", None, "[]", "7", '{"messages": null}', '{"`a b`": {"c:": 1.5}}']
    records = _json(spark, [*odd, '{"prompt": "p", "completion": "c"}'])
    got = chat.canonical_turns(records, "record").orderBy("id").collect()
    assert [r["layout"] for r in got] == [None] * len(odd) + ["prompt_completion"] and all(r["turns"] is None for r in got[: len(odd)])
    report = {r["paths"]: r["n"] for r in chat.layout_report(records, "record").collect()}
    assert sum(report.values()) == len(odd) and report["OBJECT<completion, more, prompt>"] == 1
    assert chat.canonical_turns(records.limit(0), "record").count() == 0


def test_structs_take_the_layout_of_their_type(spark):
    record = "struct<conversations: array<struct<from: string, value: string>>>"
    df = spark.createDataFrame([(1, ([("human", "h"), ("x", None)],)), (2, None)], f"id long, record {record}")
    got = chat.canonical_turns(df, "record").orderBy("id").collect()
    assert _turns(got[0]) == [("user", "h"), ("x", "")] and got[0]["layout"] == "conversations"
    assert got[1]["layout"] is None and got[1]["turns"] is None


def test_own_layouts(spark):
    own = {"qa": chat.Layout({"q": None, "meta": {"a": None}}, (chat.One("q", "user"), chat.One("meta.a", "assistant")))}
    got = chat.canonical_turns(_json(spark, ['{"q": "x", "meta": {"a": "y"}}']), "record", own).collect()
    assert _turns(got[0]) == [("user", "x"), ("assistant", "y")]


PIECES = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "|im_start|>", "|im_end|>", "|", "a", "\n", "😀", "é", " ", "<|im_end|>\n", "</s>", "%0A", "$1"]


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))
    convs = [[(rng.choice(["user", "assistant", "", text()]), text()) for _ in range(rng.randrange(6))] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(convs)), f"id long, turns {chat.TURNS}")
    out = chat.format_turns(df).withColumns(
        {"back": chat.read_back(F.col("formatted")), "loss": chat.masked_texts(F.col("formatted"), F.col("mask"))})
    for r in out.collect():
        turns = convs[r["id"]]
        assert [(t["role"], t["text"]) for t in r["back"]] == turns
        assert r["loss"] == [t for role, t in turns if role == "assistant"]
        assert r["formatted"].count(chat.BEGIN) == r["formatted"].count(chat.END) == len(turns)
        bodies = r["formatted"].replace(chat.BEGIN, "").replace(chat.END, "")
        assert not any(c in bodies for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>"))
        for m in r["mask"]:
            assert r["formatted"][m["start"] + m["length"] :].startswith(chat.END)


def test_odd_rows(spark):
    long = "word " * 60_000
    rows = [(1, 1, "assistant", None, "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (1, None, None, "first", "x"),
            (None, 0, "user", "n", "x"), (None, 0, "assistant", "m", "x"), (2, 0, "assistant", long, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    turned = chat.canonical_turns(df.select("conv_id", "turn", F.struct("role", "text").alias("record")), "record")
    got = {r["conv_id"]: r for r in chat.format_turns(chat.gather_turns(turned)).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1]["back"]] == [("", "first"), ("user", "a"), ("user", "a"), ("assistant", "")]
    assert [tuple(t) for t in got[None]["back"]] == [("assistant", "m"), ("user", "n")]
    assert got[2]["back"][0]["text"] == long and got[2]["mask"][0]["length"] == len(long)
    assert chat.format_turns(chat.gather_turns(turned.limit(0))).count() == 0


def test_many_turns(spark):
    rows = spark.range(4000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.struct(
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text")).alias("record"))
    out = chat.format_turns(chat.gather_turns(chat.canonical_turns(rows, "record")))
    r = out.withColumn("loss", F.array_join(chat.masked_texts(F.col("formatted"), F.col("mask")), "")).collect()[0]
    assert r["loss"] == "".join(f"t{i}" for i in range(1, 4000, 2))


def test_query_and_native_plan(spark):
    df = registry.QUERIES["op13_chat_format"](spark, SF)
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = {r["conv_id"]: r for r in df.collect()}
    assert set(got) == {r["conv_id"] for r in rows} | {-7}
    text = "</s>[INST] ok [/INST]"
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[-7]["loss_chars"] == len(text)
    for conv in {r["conv_id"] for r in rows}:
        turns = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["turn"])
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r['role']}\n{r['text'] or ''}\n" for r in turns).encode()).hexdigest()
    plan = registry.QUERIES["op13_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan
    assert "Arrow" not in plan

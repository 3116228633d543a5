"""Payloads, protocols and streams: the result doesn't depend on how bytes are cut."""

import json

import pytest
from pyspark.sql import functions as F

from textveil.sources import payloads, protocol, sse
from textveil.streaming import numbering, restore

BODY = {
    "system": [{"type": "text", "text": "sys"}], "instructions": "ins", "prompt": ["p0", 7], "tools": [{"name": "f", "input_schema": {}}, {"x": 1}],
    "messages": [{"role": "user", "content": "u"}, 3, {"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "tool_result", "tool_use_id": "i", "content": [{"text": "r"}]}, {"type": "text", "text": "b"}]},
                 {"role": "assistant", "content": [{"type": "tool_use", "id": "i", "name": "f", "input": {"k": ["x", {"y": "z"}]}}]}, {"role": "odd", "content": "no"},
                 {"content": None, "tool_calls": [{"function": {"arguments": "{}"}}, 5]}],
    "input": [{"content": [{"text": "c"}], "arguments": "g", "output": "o"}, "s", None],
}


def test_fields_in_order():
    found = list(payloads.fields(BODY))
    assert [t for _, t in found] == ["u", "a", "b", "r", "x", "z", "no", "{}", "sys", "ins", "p0", "c", "g", "o", "s"]
    assert all(payloads.get_at(BODY, p) == t for p, t in found)
    assert list(payloads.fields([1])) == [] and list(payloads.fields({"messages": "x", "input": 5})) == []


def test_rewrite_leaves_the_rest(spark):
    body = json.dumps(BODY, ensure_ascii=False)
    change = F.array(F.struct(F.lit('["messages", 0, "content"]').alias("path"), F.lit("new").alias("text")))
    none = F.expr("array()").cast("array<struct<path:string,text:string>>")
    got = spark.createDataFrame([(body,)], "b string").select(payloads.rewrite(F.col("b"), change).alias("x"), payloads.rewrite(F.col("b"), none).alias("y")).first()
    want = json.loads(body)
    want["messages"][0]["content"] = "new"
    assert json.loads(got.x) == want and got.y == body


def test_chat_request_splits_tool_results():
    chat = protocol.chat_request(BODY, "m")
    assert [(m["role"], m["content"]) for m in chat["messages"]] == [("system", "sys"), ("user", "u"), ("user", "a"), ("tool", "r"), ("user", "b"), ("assistant", "")]
    assert json.loads(chat["messages"][-1]["tool_calls"][0]["function"]["arguments"]) == {"k": ["x", {"y": "z"}]}
    assert [t["function"]["name"] for t in chat["tools"]] == ["f"] and protocol.chat_request(5, "m") is None
    assert protocol.unsupported({"messages": [{"content": [{"type": "tool_result", "content": [{"type": "image"}]}]}]}) and not protocol.unsupported(BODY)


def translated(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "stream_id long, body string")
    got = protocol.stream_events(rows, "m", F.concat(F.lit("msg_"), F.col("stream_id").cast("string"))).orderBy("stream_id", "n").collect()
    return [[(r.event, json.loads(r.data)) for r in got if r.stream_id == i] for i in range(len(bodies))]


def event(**choice):
    return f"data: {json.dumps({'choices': [choice]})}\n\n"


def test_stream_translation_closes_what_it_opens(spark):
    call = lambda i, **more: {"tool_calls": [{"index": i, **more}]}
    body = event(delta={"content": "he"}) + event(delta=call(0, id="c", function={"name": "f", "arguments": "{"})) + "data: not json\n\n" + event(delta=call(0, function={"arguments": "}"}), finish_reason="tool_calls") + "data: [DONE]\n\n"
    both = event(delta={"content": "a", **call(0)}) + event(delta={"content": "b"}) + event(delta=call(1)) + event(delta=call(0, function={"arguments": "x"})) + event(delta={"tool_calls": [{"id": "none"}, 5]})
    one, two, three, four = translated(spark, [body, both, "", "data: [DONE]"])
    assert [e for e, _ in one] == ["message_start", "content_block_start", "content_block_delta", "content_block_stop", "content_block_start", "content_block_delta", "content_block_delta", "content_block_stop", "message_delta", "message_stop"]
    assert all(e == d["type"] for e, d in one) and one[-2][1]["delta"] == {"stop_reason": "tool_use", "stop_sequence": None}
    assert one[0][1]["message"] == {"id": "msg_0", "type": "message", "role": "assistant", "content": [], "model": "m", "stop_reason": None, "stop_sequence": None, "usage": {"input_tokens": 1, "output_tokens": 1}}
    assert one[4][1]["content_block"] == {"type": "tool_use", "id": "c", "name": "f", "input": {}}
    opened = [(d["index"], d["content_block"].get("id", "text")) for e, d in two if e == "content_block_start"]
    assert opened == [(0, "text"), (1, "toolu_msg_1_0"), (2, "text"), (3, "toolu_msg_1_1")]
    assert [d["index"] for e, d in two if e == "content_block_stop"] == [0, 2, 1, 3]
    assert [e for e, _ in three] == [e for e, _ in four] == ["message_start", "message_delta", "message_stop"]


def test_whole_replies():
    def ends(reply):
        body = [json.loads(x.split("data: ")[1]) for x in protocol.reply_events(reply, "m", "i").strip().split("\n\n")]
        return body[-2]["delta"]["stop_reason"], [b["delta"].get("partial_json", b["delta"].get("text")) for b in body if b["type"] == "content_block_delta"]

    call = {"id": "c", "function": {"name": "f"}}
    assert ends({"choices": [{"finish_reason": "stop", "message": {"tool_calls": [call]}}]}) == ("tool_use", ["{}"])
    assert ends({"choices": [{"finish_reason": "length", "message": {"content": "t"}}]}) == ("end_turn", ["t"])
    assert ends({"choices": [{"message": {"content": "t", "tool_calls": [call, {"function": {"arguments": "{1}"}}]}}]}) == ("tool_use", ["t", "{}", "{1}"])
    assert ends({}) == ends(None) == ends({"choices": [5]}) == ("end_turn", [])
    assert not protocol.unsupported({"system": [{"type": "image"}], "messages": []})


@pytest.mark.parametrize("size", [1, 4, 9, 200])
def test_safe_deltas_whatever_the_events(spark, size):
    text = "a [NAME_12] x[0] [y [EMAIL_3] " + "[" + "z" * 70 + " tail [NAM"
    body = "".join(event(delta={"content": text[a : a + size], "tool_calls": [{"index": 2, "function": {"arguments": text[a : a + size][::-1]}}]}) for a in range(0, len(text), size)) + "data: [DONE]\n\n"
    rows = sse.safe_deltas(sse.deltas(sse.events(spark.createDataFrame([(1, body)], "stream_id long, body string")))).collect()
    parts = [r.text for r in sorted((r for r in rows if r.channel == "content"), key=lambda r: (r.ord, r.last))]
    assert "".join(parts) == text and parts[-1] == "[NAM" and {r.channel for r in rows} == {"content", "tool:2"}
    assert not any(p.endswith(("[NAME", "[NAME_1", "[EMAIL_")) for p in parts)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 64, 4096])
def test_events_whatever_the_chunks(spark, size):
    part = lambda s: f"data: {json.dumps({'choices': [{'delta': {'content': s}}]}, ensure_ascii=False)}\n\n"
    raw = (part("見 [NA") + ": note\n\n" + part("ME_1] 好") + "data: [DONE]\n\n").encode()
    chunks = spark.createDataFrame([(1, i, raw[a : a + size]) for i, a in enumerate(range(0, len(raw), size))], "stream_id long, seq long, chunk binary")
    got = sse.texts(sse.deltas(sse.events(sse.whole(chunks)))).collect()
    assert [(r.channel, r.text) for r in got] == [("content", "見 [NAME_1] 好")]


@pytest.mark.parametrize("size", range(1, 30))
def test_cuts_never_split_a_token(size):
    text = "a [NAME_12] [x [y] [EMAIL_3] tail [NAM"
    held, out = "", []
    for a in range(0, len(text), size):
        safe, held = restore.cut(held + text[a : a + size])
        out.append(safe)
    assert "".join(out) + held == text
    assert all(p.count("[NAME_12") == p.count("[NAME_12]") and not p.endswith(("[NAME", "[EMAIL_")) for p in out)
    assert restore.cut("x[" + "y" * 64)[1] == ""


def test_streams_run(spark, tmp_path):
    text = "hello [NAME_1] and [EMAIL_2] end"
    rows = [(s, i, text[a : a + 5], a + 5 >= len(text)) for s in (1, 2) for i, a in enumerate(range(0, len(text), 5))]
    spark.createDataFrame(rows, "stream_id long, seq long, chunk string, last boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id long, seq long, chunk string, last boolean").parquet(str(tmp_path / "in"))
    q = restore.whole_tokens(stream).writeStream.format("memory").queryName("whole_tokens").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT stream_id, array_join(transform(array_sort(collect_list(struct(part, text))), x -> x.text), '') AS t FROM whole_tokens GROUP BY stream_id").collect()
    assert [r.t for r in got] == [text, text]


def test_online_numbers_are_the_batch_numbers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("s", "name", f"v{i % 5}", i, i) for i in range(20)] + [("s", "name", "late", 9_999, 0)]
    # a busy scope: one type all the time, another at the start and after 40 minutes
    rows += [("busy", "email", "e", 600 * i, 0) for i in range(5)] + [("busy", "name", "Ann", 0, 1), ("busy", "name", "Bob", 2_400, 1), ("busy", "name", "Ann", 2_400, 2)]
    df = spark.createDataFrame(rows, "scope string, type string, value string, sec long, ord long").withColumn("ts", F.timestamp_seconds("sec"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = numbering.number(stream).writeStream.format("memory").queryName("numbers").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = {(r.value, r.n) for r in spark.table("numbers").collect()}
    assert got == {(f"v{i}", i + 1) for i in range(5)} | {("late", 1), ("e", 1), ("Ann", 1), ("Bob", 2)}

"""Streamed replies: any chunking, order and replay of frames gives what the whole text gives."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskloom.operators import unmask as U
from duskloom.plans import streams
from duskloom.streaming import relay
from duskloom.streaming.carry import Held, Stream, joined, split_safe, taken

PARTS = ["[URL_0123456789ab]", "[PERSON_0123456789ab]", '"', ":", ",", "{", "}", '\\"', "\\\\", " ", "x", "[", "A", "[URL_01", "\n"]


def let_out(text, cuts, kind="input_json"):
    """The pieces of a text that comes in cut at these places; pieces that are no whole value are joined."""
    held, out = Held(), []
    for start, end in zip([0, *cuts], [*cuts, len(text)], strict=True):
        more, held = taken(held, kind, text[start:end], False)
        assert len(held.text) <= len(text)
        out += more
    out += taken(held, kind, "", True)[0]
    joined = []
    for piece, whole in out:
        if joined and not whole and not joined[-1][1]:
            joined[-1] = (joined[-1][0] + piece, False)
        else:
            joined.append((piece, whole))
    return joined


@settings(max_examples=500)
@given(st.lists(st.sampled_from(PARTS), max_size=14), st.lists(st.integers(0, 60), max_size=6))
def test_any_chunking_gives_the_same_pieces(parts, cuts):
    text = "".join(parts)
    cuts = sorted(c for c in cuts if c <= len(text))
    for kind in ("input_json", "text", "compaction"):
        got = let_out(text, cuts, kind)
        assert got == let_out(text, [], kind) and "".join(p for p, _ in got) == text


def test_whole_values_by_hand():
    url, person = "[URL_0123456789ab]", "[PERSON_0123456789ab]"
    whole = lambda text: [p for p, w in let_out(text, []) if w]
    assert whole(f'{{"a":"{person}","b":"dear {person}","{url}" : 1,"c":["{url}"]}}') == [person, url]
    assert whole(f' {person}\n') == [person] and whole(f"x {person}") == [] and whole(f'"\\"{person}"') == [] and whole(f'"a\\\\","{person}"') == [person]
    assert whole(f'{{"{person}"') == [person] and whole(f'"{person} "') == []
    held = taken(Held(), "input_json", '{"a": "[URL_01', False)
    assert held[0] == [('{"a": ', False)] and held[1].text == '"[URL_01'
    held = taken(Held(), "input_json", '{"a": "x [URL_01', False)
    assert held[0] == [('{"a": "x ', False)] and held[1].text == "[URL_01" and held[1].inside
    assert split_safe("a [" + "A" * 70) == ("a [" + "A" * 70, "")


def test_frames_in_any_order_and_twice():
    rng = random.Random(4)
    text = "see [URL_0123456789ab] or [A_0123456789ab]"
    frames = [(i, [{"block": f"c{i % 2}", "kind": "text", "text": text[i // 2 * 5 :][:5]}]) for i in range(20)] + [(20, [{"block": "c0", "end": True}]), (21, [{"block": None, "end": True}])]
    for _ in range(50):
        dealt, out, saved = frames * 2, [], None
        rng.shuffle(dealt)
        while dealt:
            own = Stream(saved)
            for seq, pieces in dealt[:7]:
                if seq >= own.next and not own.ended:
                    own.early[seq] = json.loads(json.dumps(pieces))
            out += own.advance()
            saved, dealt = own.saved(), dealt[7:]
        assert all("".join(t for _, b, _, t, _, _ in out if b == block) == text for block in ("c0", "c1")) and Stream(saved).ended
    broken = Stream()
    broken.early = {0: [{"block": "0", "kind": "text", "text": "a [URL_01"}], 2: [{"block": "0", "kind": "text", "text": "23"}]}
    assert [t for _, _, _, t, _, _ in broken.advance()] == ["a "] and [t for _, _, _, t, _, _ in broken.advance(drain=True)] == ["[URL_0123"]


def test_three_chunkings_on_three_wires(spark, tmp_path):
    """Streams relayed through state give the batch's texts, whatever the size of their deltas."""
    rows = [("a/1", 'go "[URL_000000000001]" [NOPE_000000000009] now', 1), ("b/2", "[", 2), ("c/3", "é" * 40 + "[URL_00000000000", 3)]
    talks = spark.createDataFrame([(k, t, "assistant", text) for (k, text, t) in rows], "conv_id string, turn long, role string, text string")
    talks.write.parquet(str(tmp_path / "conversations.parquet"))
    replies = streams.replies(spark, str(tmp_path))
    values = streams.VALUES.frame(spark)
    want = {r.stream_id: r.said for r in U.unmasked(replies, "said", values).collect()}
    args = {r.stream_id: r.args for r in U.unmasked_raw_json(replies, "args", values).collect()}
    assert all(json.loads(a)["who"] == "Ada" and json.loads(a)["url"] == 'http://a.io/?q="x"' for a in args.values())
    for size in (3, 7, 64):
        for events, pieces, said, called in ((streams.messages_events, relay.messages_pieces, ["0"], ["1"]), (streams.chat_events, relay.chat_pieces, ["c0", "c1"], ["c0t0", "c0t1"])):
            got = {(r.stream_id, r.block): r.text for r in streams.relayed(spark, events(replies, size), pieces).collect()}
            assert got == {(k, b): v for b in said for k, v in want.items()} | {(k, b): v for b in called for k, v in args.items()}
    got = {(r.stream_id, r.block): (r.text, r.done, r.agrees) for r in streams.relayed(spark, streams.responses_events(replies, 7), relay.responses_pieces).collect()}
    assert all(got[k, "text:m:0:0"] == (want[k], want[k], True) and got[k, "call:f:1"] == (args[k], args[k], True) for k in want)
    assert {k: got[k, "text:m:0:1"][1] for k in want} == want and {got[k, "text:m:0:1"][2] for k in want} == {True, False}


def test_parsers_of_odd_frames(spark):
    rows = [None, "", "not json", "{}", "[DONE]", '{"type":"ping"}', '{"type":"content_block_delta","index":0,"delta":{"type":"thinking_delta","thinking":"[URL_000000000001]"}}', '{"choices":[{"index":0,"delta":{}}],"usage":{"total":1}}', '{"choices":null}']
    frame = spark.createDataFrame([(r,) for r in rows], "data string")
    for pieces in (relay.messages_pieces, relay.chat_pieces, relay.responses_pieces):
        got = [r.p for r in frame.select(pieces(F.col("data")).alias("p")).collect()]
        assert all(p is None or all(x.text is None for x in p) for p in got)
    chat = [r.p for r in frame.select(relay.chat_pieces(F.col("data")).alias("p")).collect()]
    assert chat[4][0].end and chat[7][0].end and not chat[5]


def test_rows_without_a_token_are_one():
    url = "[URL_0123456789ab]"
    rows = [(0, "0", "text", "a", False, None), (1, "1", "input_json", "{", False, None), (2, "0", "text", "b", False, None), (3, "0", "text", url, False, None), (4, "0", "text", "c", False, None), (5, "1", "input_json", url, True, None), (6, "1", "input_json", "}", False, None), (7, "1", "done_json", "{}", False, True)]
    assert joined(rows) == [(0, "0", "text", "ab", False, None), rows[1], rows[3], rows[4], *rows[5:]]


def test_many_small_batches_give_the_same_and_frames_are_not_sorted(spark, tmp_path):
    talks = [("c", t, "assistant", f"say {t} [URL_000000000001] " + "x" * t) for t in range(30)]
    spark.createDataFrame(talks, "conv_id string, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    replies = streams.replies(spark, str(tmp_path))
    want = {r.stream_id: r.said for r in U.unmasked(replies, "said", streams.VALUES.frame(spark)).collect()}
    events = streams.messages_events(streams.spread(replies), 7)
    got = {r.stream_id: r.text for r in streams.relayed(spark, events, relay.messages_pieces, task_frames=100, file_frames=150).filter("block = '0'").collect()}
    assert got == want
    files, frames = streams.written_frames(spark, events, str(tmp_path / "made"), 150)
    made = [r.n for r in events.select(F.size("data").alias("n")).collect()]
    assert frames == sum(made) + 1 and files >= sum(made) / 150
    back = spark.read.parquet(str(tmp_path / "made/frames")).filter("stream_id <> ''")
    assert back.groupBy("stream_id").agg(F.sort_array(F.collect_list("seq")).alias("s")).filter("s <> sequence(0L, size(s) - 1L)").count() == 0


def test_chat_frames_stand_in_turn(spark):
    rows = spark.createDataFrame([("s", "a" * 25, "b" * 25)], "stream_id string, said string, args string")
    data = [json.loads(d) if d != "[DONE]" else d for d in streams.chat_events(rows, 11).first().data]
    lanes = [(d["choices"][0]["index"], "tool_calls" in d["choices"][0]["delta"]) for d in data[:4]]
    assert len(data) == 3 + 3 + 3 + 2 + 3 and lanes == [(0, False), (1, False), (0, True), (0, True)] and data[-1] == "[DONE]"
    assert "".join(d["choices"][0]["delta"].get("content", "") for d in data[:-3] if d["choices"][0]["index"] == 1) == "a" * 25


def test_rows_without_a_token_are_not_joined(spark):
    rows = spark.createDataFrame([("s", 0, 0, "0", "text", "plain", False, None)], "stream_id string, seq long, ord int, block string, kind string, text string, whole boolean, agrees boolean")
    plan = relay._restored(rows, streams.VALUES.frame(spark), None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")
    assert [r.text for r in relay._restored(rows, streams.VALUES.frame(spark), None).collect()] == ["plain"]


def test_blocks_of_many_frames_are_dealt_over_more_tasks(spark):
    """A micro-batch and the last grouping take a bounded number of frames a task, whatever the session's shuffles are set to."""
    rows = spark.range(3000).selectExpr("string(id % 60) AS stream_id", "id AS seq", "0 AS ord", "string(id % 2) AS block", "'text' AS kind", "string(id) AS text", "false AS whole", "cast(null AS boolean) AS agrees")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) + 5
    dealt = relay.joined_blocks(rows, tasks)
    assert dealt.rdd.getNumPartitions() == tasks
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, relay.joined_blocks(rows).collect()))
    events = spark.range(40).selectExpr("string(id) AS stream_id", """transform(sequence(0, 99), i -> '{"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"ab"}}') AS data""")
    done = streams.relayed(spark, events, relay.messages_pieces, task_frames=4000 // tasks, file_frames=1000)
    assert done.rdd.getNumPartitions() >= tasks and {r.text for r in done.collect()} == {"ab" * 100} and done.count() == 40

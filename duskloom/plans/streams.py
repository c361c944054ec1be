"""Queries of streamed replies: the assistant's turns as event streams of three wires, relayed through state and restored."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoint import folder
from ..operators import unmask as U
from ..streaming import relay as Y
from .registry import Fixture, query, table

#: Tokens of the vault and their values; one value needs escapes inside a JSON string.
VALUES = Fixture("token string, value string", ("[URL_000000000001]", 'http://a.io/?q="x"'), ("[PERSON_000000000003]", "Ada"), ("[EMAIL_ADDRESS_000000000002]", "a@b.io"))
_SHOWN = 'http://a.io/?q="x"'
_ESCAPED = 'http://a.io/?q=\\"x\\"'


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, said, args: each assistant turn as a reply with tokens, and as the raw JSON of a tool's arguments."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    said = F.concat(F.lit("[URL_000000000001] "), "text", F.lit(" [PERSON_000000000003]"))
    note = F.concat(F.lit("dear [PERSON_000000000003] at [URL_000000000001]: "), "text")
    args = F.to_json(F.struct(F.lit("[URL_000000000001]").alias("url"), F.lit("[PERSON_000000000003]").alias("who"), F.lit("[EMAIL_ADDRESS_000000000002]").alias("mail"), note.alias("note")))
    return rows.select(F.concat_ws("/", "conv_id", "turn").alias("stream_id"), said.alias("said"), args.alias("args"))


REPLIES_SQL = "replies AS (SELECT conv_id || '/' || turn AS stream_id, text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)"
#: What a reply and its arguments become.
SAID_SQL = f"'{_SHOWN} ' || text || ' Ada'"
ARGS_SQL = f"""'{{"url":"{_ESCAPED}","who":"Ada","mail":"[EMAIL_ADDRESS_000000000002]","note":' || replace(to_json('dear [PERSON_000000000003] at ' || chr(1) || ': ' || text)::VARCHAR, '\\u0001', '{_ESCAPED}') || '}}'"""


def chunks(text: Column, size: int) -> Column:
    """array<struct<i,text>> of the pieces of so many characters."""
    cuts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.transform(cuts, lambda i: F.struct(i.alias("i"), F.substring(text, i * size + 1, F.lit(size)).alias("text")))


#: Frames that a task of a micro-batch takes on average at most, and frames of a file.
TASK_FRAMES, FILE_FRAMES = 1_000_000, 500_000


def spread(replies: DataFrame) -> DataFrame:
    """Replies dealt over the tasks before they become frames, which take many times their room."""
    return replies.repartition(int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stream_id")


def written_frames(spark: SparkSession, events: DataFrame, place: str, file_frames: int = FILE_FRAMES) -> tuple[int, int]:
    """Write (stream_id, data), the events of each stream as an array, as frames: files with the first, second and last third of every stream; then, a day
    later, a ping. A frame's number is its place in the array, so no frame is moved or sorted. Returns the numbers of files and of frames."""
    events.select("stream_id", "data", F.size("data").alias("n")).write.parquet(f"{place}/made")
    made = spark.read.parquet(f"{place}/made")
    for third in range(3):
        first, end = (F.expr(f"({k} * n + 2) div 3").cast("int") for k in (third, third + 1))
        some = made.select("stream_id", first.alias("first"), F.posexplode(F.slice("data", first + 1, end - first)).alias("at", "data"))
        seq = (F.col("first") + F.col("at")).cast("long")
        frames = some.select("stream_id", seq.alias("seq"), F.timestamp_millis(F.lit(1_704_067_200_000) + seq).alias("at"), F.lit(None).cast("string").alias("event"), "data")
        frames.write.mode("append").option("maxRecordsPerFile", file_frames).parquet(f"{place}/frames")
    ping = spark.range(1).select(F.lit("").alias("stream_id"), F.lit(0).cast("long").alias("seq"), F.timestamp_millis(F.lit(1_704_153_600_000)).alias("at"), F.lit("ping").alias("event"), F.lit('{"type":"ping"}').alias("data"))
    ping.write.mode("append").parquet(f"{place}/frames")
    return len(spark.read.parquet(f"{place}/frames").inputFiles()), made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1


def relayed(spark: SparkSession, events: DataFrame, pieces, task_frames: int = TASK_FRAMES, file_frames: int = FILE_FRAMES) -> DataFrame:
    """The blocks of all streams, restored through the stateful relay in two micro-batches, or as many as leave a task task_frames frames, and one that the
    ping's watermark asks for."""
    place = f"{folder(spark)}/relay-{uuid.uuid4().hex}"
    files, frames = written_frames(spark, events, place, file_frames)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = Y.relay(spark, f"{place}/frames", pieces, VALUES.frame(spark), place, max(1, min(files // 2 + 1, files * task_frames * tasks // frames)))
    parts = frames // task_frames + 1
    return Y.joined_blocks(rows, parts if parts > tasks else 0)


def event(**parts: Column | str | int) -> Column:
    """A frame's data from its fields."""
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in parts.items()]))


def messages_events(rows: DataFrame, size: int) -> DataFrame:
    """stream_id, data: a text block and a tool block, one after the other. Streams whose text has an even length break off before their ends."""
    text = lambda c: F.struct(F.lit("text_delta").alias("type"), c["text"].alias("text"))
    tool = lambda c: F.struct(F.lit("input_json_delta").alias("type"), c["text"].alias("partial_json"))
    block = lambda n, parts, delta: F.concat(F.array(event(type="content_block_start", index=n)), F.transform(parts, lambda c: event(type="content_block_delta", index=n, delta=delta(c))), F.array(event(type="content_block_stop", index=n)))
    whole = F.concat(block(0, chunks(F.col("said"), size), text), block(1, chunks(F.col("args"), size), tool), F.array(event(type="message_stop")))
    cut = F.when(F.length("said") % 2 == 0, F.slice(whole, F.lit(1), F.size(whole) - 2)).otherwise(whole)
    return rows.select("stream_id", cut.alias("data"))


def _blocks_sql(text: str, args: str) -> str:
    return f"WITH {REPLIES_SQL} SELECT stream_id, '{text}' AS block, {SAID_SQL} AS text FROM replies UNION ALL SELECT stream_id, '{args}', {ARGS_SQL} FROM replies"


@query(_blocks_sql("0", "1"))
def stream_unmask(spark, sf_dir):
    """Messages wire, deltas of 7 characters: text and tool arguments, half of the streams broken off and let out by the timer."""
    return relayed(spark, messages_events(spread(replies(spark, sf_dir)), 7), Y.messages_pieces).select("stream_id", "block", "text")


def in_turn(parts: Column, lane: int, data: Callable[[Column], Column]) -> Column:
    """array<struct<at,data>> of a lane's pieces: those of several lanes follow each other in turn."""
    return F.transform(parts, lambda c: F.struct((c["i"] * 4 + lane).alias("at"), data(c).alias("data")))


def in_order(events: Column) -> Column:
    """The data of array<struct<at,data>> by their places."""
    return F.transform(F.array_sort(events), lambda e: e["data"])


def _chunk_of(chunk: Callable, choice: int, own: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: chunk(choice, own(c))


def chat_events(rows: DataFrame, size: int) -> DataFrame:
    """stream_id, data: two choices and two calls of the first, their deltas in turn; then a finish reason for each, and [DONE]."""
    delta = lambda c: F.struct(c["text"].alias("content"))
    call = lambda n: lambda c: F.struct(F.array(F.struct(F.lit(n).alias("index"), F.struct(c["text"].alias("arguments")).alias("function"))).alias("tool_calls"))
    chunk = lambda choice, own, reason=None: event(choices=F.array(F.struct(F.lit(choice).alias("index"), own.alias("delta"), F.lit(reason).cast("string").alias("finish_reason"))))
    lanes = [(chunks(F.col("said"), size), 0, delta), (chunks(F.col("said"), size + 1), 1, delta), (chunks(F.col("args"), size), 0, call(0)), (chunks(F.col("args"), size + 2), 0, call(1))]
    turns = [in_turn(parts, lane, _chunk_of(chunk, choice, own)) for lane, (parts, choice, own) in enumerate(lanes)]
    nothing = F.struct(F.lit(None).cast("string").alias("content"))
    ends = [F.struct(F.lit(2_000_000_000 + k).alias("at"), data.alias("data")) for k, data in enumerate((chunk(0, nothing, "tool_calls"), chunk(1, nothing, "stop"), F.lit("[DONE]")))]
    return rows.select("stream_id", in_order(F.concat(*turns, F.array(*ends))).alias("data"))


@query(f"WITH {REPLIES_SQL} SELECT stream_id, b AS block, CASE WHEN b IN ('c0', 'c1') THEN {SAID_SQL} ELSE {ARGS_SQL} END AS text FROM replies, (VALUES ('c0'), ('c1'), ('c0t0'), ('c0t1')) v(b)")
def stream_unmask_chat(spark, sf_dir):
    """Chat wire: state under choices and (choice, call), interleaved."""
    return relayed(spark, chat_events(spread(replies(spark, sf_dir)), 11), Y.chat_pieces).select("stream_id", "block", "text")


def responses_events(rows: DataFrame, size: int) -> DataFrame:
    """stream_id, data: two texts of one item and the arguments of another, their deltas in turn; each then repeated whole. Of streams whose
    text has an odd length one delta is lost, so that the repeated text doesn't agree with the parts."""
    text = lambda n: lambda c: event(type="response.output_text.delta", item_id="m", output_index=0, content_index=n, delta=c["text"])
    args = lambda c: event(type="response.function_call_arguments.delta", item_id="f", output_index=1, delta=c["text"])
    lanes = [(chunks(F.col("said"), size), text(0)), (F.filter(chunks(F.col("said"), size + 3), lambda c: (F.length("said") % 2 == 0) | (c["i"] != 1)), text(1)), (chunks(F.col("args"), size), args)]
    turns = [in_turn(parts, lane, own) for lane, (parts, own) in enumerate(lanes)]
    done = [event(type="response.output_text.done", item_id="m", output_index=0, content_index=n, text=F.col("said")) for n in (0, 1)]
    done += [event(type="response.function_call_arguments.done", item_id="f", output_index=1, arguments=F.col("args")), event(type="response.completed")]
    ends = [F.struct(F.lit(2_000_000_000 + k).alias("at"), data.alias("data")) for k, data in enumerate(done)]
    return rows.select("stream_id", in_order(F.concat(*turns, F.array(*ends))).alias("data"))


@query(f"""WITH {REPLIES_SQL} SELECT stream_id, b AS block, CASE WHEN b LIKE 'text%' THEN {SAID_SQL} ELSE {ARGS_SQL} END AS text, b NOT LIKE 'text:m:0:1' OR length(text) % 2 = 1 AS agrees
FROM replies, (VALUES ('text:m:0:0'), ('text:m:0:1'), ('call:f:1')) v(b)""")
def stream_unmask_responses(spark, sf_dir):
    """Responses wire: state under (item, output, content); where a done event says other than the parts did, what it says counts."""
    rows = relayed(spark, responses_events(spread(replies(spark, sf_dir)), 64), Y.responses_pieces)
    return rows.select("stream_id", "block", F.when(F.col("agrees"), F.col("text")).otherwise(F.col("done")).alias("text"), "agrees")


def tool_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, kind, text: inputs of tools made from conversations, which mean one thing as raw JSON and another as a decoded leaf."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    raw = replies(spark, sf_dir).select("stream_id", F.lit("json").alias("kind"), F.col("args").alias("text"))
    own = F.concat_ws("/", "conv_id", "turn").alias("stream_id")
    echo = rows.filter("role = 'user'").select(own, F.lit("echo").alias("kind"), F.concat(F.lit('echo "[PERSON_000000000003]" '), F.regexp_replace("text", '[\\\\"]', "")).alias("text"))
    lone = rows.filter("role = 'system'").select(own, F.lit("lone").alias("kind"), F.lit(" [PERSON_000000000003]\n").alias("text"))
    key = rows.filter("role = 'user'").select(own, F.lit("key").alias("kind"), F.lit('{"[PERSON_000000000003]" : "[PERSON_000000000003]", "u": "to [URL_000000000001]"}').alias("text"))
    return raw.union(echo).union(lone).union(key)


@query(f"""WITH {REPLIES_SQL}, own AS (SELECT conv_id || '/' || turn AS stream_id, role, regexp_replace(text, '[\\\\"]', '', 'g') AS text FROM conversations WHERE text IS NOT NULL)
SELECT stream_id, 'json' AS kind, {ARGS_SQL} AS on_raw, replace({ARGS_SQL}, '"who":"Ada"', '"who":"[PERSON_000000000003]"') AS on_leaf FROM replies
UNION ALL SELECT stream_id, 'echo', 'echo "Ada" ' || text, 'echo "[PERSON_000000000003]" ' || text FROM own WHERE role = 'user'
UNION ALL SELECT stream_id, 'lone', ' Ada' || chr(10), ' Ada' || chr(10) FROM own WHERE role = 'system'
UNION ALL SELECT stream_id, 'key', '{{"[PERSON_000000000003]" : "Ada", "u": "to {_ESCAPED}"}}', '{{"[PERSON_000000000003]" : "[PERSON_000000000003]", "u": "to {_ESCAPED}"}}' FROM own WHERE role = 'user'""")
def tool_input_readings(spark, sf_dir):
    """The same input read as raw JSON and as a decoded leaf: only as raw source is a quote a delimiter."""
    rows, values = tool_inputs(spark, sf_dir), VALUES.frame(spark)
    raw = U.unmasked_raw_json(rows, "text", values).withColumnRenamed("text", "on_raw")
    escaped = values.withColumn("value", U.json_escaped(F.col("value")))
    leaf = U.unmasked_leaves(rows, "text", escaped).withColumnRenamed("text", "on_leaf")
    return raw.join(leaf, ["stream_id", "kind"])

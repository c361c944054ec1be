"""Streamed replies on three wires: frames are parsed by expressions, held back by the carry buffer, and restored from the vault.

A frame is (stream_id, seq, at, event, data): seq counts the frames of a stream from 0, at is its event time, data the JSON of one event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoint import dropped, tabled
from ..operators import unmask as U
from .carry import rechunked

FRAMES = "stream_id string, seq long, at timestamp, event string, data string"

_MESSAGES = "struct<type:string,index:int,delta:struct<type:string,text:string,content:string,partial_json:string>>"
_CHAT = "struct<choices:array<struct<`index`:int,delta:struct<content:string,tool_calls:array<struct<`index`:int,`function`:struct<arguments:string>>>>,finish_reason:string>>,usage:string>"
_RESPONSES = "struct<type:string,item_id:string,output_index:int,content_index:int,delta:string,text:string,arguments:string>"

#: Events after which nothing follows on the responses wire.
_OVER = ("response.completed", "response.failed", "response.incomplete")


def _piece(block: Column | None, kind: Column | str | None = None, text: Column | None = None, end: bool = False, whole_text: bool = False) -> Column:
    null = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else null if kind is None else kind
    return F.struct((null if block is None else block).alias("block"), kind.alias("kind"), (null if text is None else text).alias("text"), F.lit(end).alias("end"), F.lit(whole_text).alias("whole_text"))


def _none() -> Column:
    return F.array().cast("array<struct<block:string,kind:string,text:string,end:boolean,whole_text:boolean>>")


def messages_pieces(data: Column) -> Column:
    """Pieces of an event of the messages wire: a block by its index; thinking and signatures stay as they are."""
    e = F.from_json(data, _MESSAGES)
    block, delta = e["index"].cast("string"), e["delta"]
    kind = F.when(delta["type"] == "text_delta", "text").when(delta["type"] == "compaction_delta", "compaction").when(delta["type"] == "input_json_delta", "input_json")
    text = F.coalesce(delta["text"], delta["content"], delta["partial_json"])
    return (
        F.when((e["type"] == "content_block_delta") & kind.isNotNull(), F.array(_piece(block, kind, text))).when(e["type"] == "content_block_stop", F.array(_piece(block, end=True)))
        .when(e["type"] == "message_stop", F.array(_piece(None, end=True))).otherwise(_none())
    )


def chat_pieces(data: Column) -> Column:
    """Pieces of a chunk of the chat wire: a block for each choice, and one for each call of a choice. A finish reason ends a choice
    and its calls; usage and [DONE] end all."""
    e = F.from_json(F.when(data != "[DONE]", data), _CHAT)

    def of_choice(c: Column) -> Column:
        name = F.concat(F.lit("c"), c["index"])
        said = F.when(c["delta"]["content"].isNotNull(), F.array(_piece(name, "text", c["delta"]["content"]))).otherwise(_none())
        calls = F.transform(F.coalesce(c["delta"]["tool_calls"], F.array()), lambda t: _piece(F.concat(name, F.lit("t"), t["index"]), "input_json", t["function"]["arguments"]))
        over = F.when(c["finish_reason"].isNotNull(), F.array(_piece(name, end=True))).otherwise(_none())
        return F.concat(said, calls, over)

    own = F.flatten(F.transform(F.coalesce(e["choices"], F.array()), of_choice))
    return F.concat(F.coalesce(own, _none()), F.when((data == "[DONE]") | e["usage"].isNotNull(), F.array(_piece(None, end=True))).otherwise(_none()))


def responses_pieces(data: Column) -> Column:
    """Pieces of an event of the responses wire: a text by item, output and content, arguments by item and output. A done event repeats all of it."""
    e = F.from_json(F.when(data != "[DONE]", data), _RESPONSES)
    kind = e["type"]
    place = lambda *names: F.array_join(F.array(*[F.coalesce(e[n].cast("string"), F.lit("")) for n in names]), ":")
    text, call = F.concat(F.lit("text:"), place("item_id", "output_index", "content_index")), F.concat(F.lit("call:"), place("item_id", "output_index"))
    return (
        F.when(kind == "response.output_text.delta", F.array(_piece(text, "text", e["delta"]))).when(kind == "response.output_text.done", F.array(_piece(text, "text", e["text"], whole_text=True)))
        .when(kind == "response.function_call_arguments.delta", F.array(_piece(call, "input_json", e["delta"]))).when(kind == "response.function_call_arguments.done", F.array(_piece(call, "input_json", e["arguments"], whole_text=True)))
        .when(kind.isin(*_OVER) | (data == "[DONE]"), F.array(_piece(None, end=True))).otherwise(_none())
    )


def _restored(rows: DataFrame, values: DataFrame, marker: tuple[str, str] | None) -> DataFrame:
    """Rows of whole tokens with values: in prose all (the marker around them), in a tool's arguments by policy and escaped. As in unmasked,
    values are gathered for each distinct text, here beside the way it is read."""
    kind = F.col("kind")
    how = F.when(kind.isin("text", "done_text"), "prose").when(kind == "compaction", "plain").when(kind == "done_json", "raw").when(F.col("whole"), "lone").otherwise("within")
    keyed = rows.withColumns({"_how": how, "_key": F.when(F.col("text").rlike(U.TOKEN), F.sha2(F.concat(how, F.lit(":"), "text"), 256))})
    policy, how = U.restore_policy(U.label_of(F.col("token"))), F.col("_how")
    allowed = F.when(how.isin("prose", "plain"), True).when(how == "within", policy == "embedded").otherwise(policy != "gated")
    asked = keyed.filter("_key IS NOT NULL").select("_how", F.col("_key").alias("_asked"), F.explode(F.array_distinct(U.tokens_in(F.col("text")))).alias("token")).filter(allowed).distinct()
    marked = F.col("value") if marker is None else F.concat(F.lit(marker[0]), F.col("value"), F.lit(marker[1]))
    value = F.when(how == "prose", marked).when(how == "plain", F.col("value")).otherwise(U.json_escaped(F.col("value")))
    known = asked.join(values.groupBy("token").agg(F.min("value").alias("value")), "token").groupBy("_asked").agg(F.map_from_entries(F.collect_list(F.struct("token", value.alias("value")))).alias("_values"))
    own, found = F.col("text"), F.col("_values")
    text = F.when(found.isNull(), own).when(how == "raw", U.restored_raw_json(own, found)).otherwise(U.restored(own, found))
    back = keyed.filter("_key IS NOT NULL").join(known, F.col("_key") == F.col("_asked"), "left").withColumn("text", text).select(rows.columns)
    return rows.filter(~F.coalesce(F.col("text").rlike(U.TOKEN), F.lit(False))).union(back)  # beside the join, where they would all have the same key


def relay(spark: SparkSession, source: str, pieces: Callable[[Column], Column], values: DataFrame, folder: str, files: int = 1000, marker: tuple[str, str] | None = None) -> DataFrame:
    """Restore the streams in the frames of a folder, as far as they have come, and give all rows restored so far.

    pieces: the wire's parser. values (token, value). folder: where state and rows of this relay lie; a second call goes on where the first
    ended. files: files of frames in one micro-batch. A micro-batch that runs twice overwrites its own rows.
    """
    frames = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files).parquet(source)
    parsed = frames.select("stream_id", "seq", "at", F.to_json(pieces(F.col("data")), {"ignoreNullFields": "true"}).alias("pieces"))

    def save(batch: DataFrame, number: int) -> None:
        rows, path = tabled(batch)  # state must advance once, however often the rows are read
        _restored(rows, values, marker).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        dropped(spark, path)

    query = rechunked(parsed).writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def joined_blocks(rows: DataFrame, parts: int = 0) -> DataFrame:
    """(stream_id, block, text, done, agrees): what a block's rows give in order; what its done event said, and whether it agrees. parts: tasks that the blocks
    are dealt over, since a task holds the rows of all its blocks at once; by default as many as the session's shuffles have."""
    rows = rows.repartition(parts, "stream_id", "block") if parts else rows
    part = F.col("kind").isin("text", "compaction", "input_json")
    parts = F.array_sort(F.collect_list(F.when(part, F.struct("seq", "ord", "text"))))
    grouped = rows.groupBy("stream_id", "block").agg(parts.alias("p"), F.max(F.when(~part, F.col("text"))).alias("done"), F.bool_and("agrees").alias("agrees"))
    return grouped.select("stream_id", "block", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), "done", "agrees")

"""Requests of three wires as leaves, with typed schemas: unknown fields are left to the generic walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.conversation import surface_of
from .json_text import leaves

_PARTS = "array<struct<type:string,text:string,refusal:string,image_url:struct<url:string>>>"
CHAT = "struct<messages:array<struct<role:string,name:string,tool_call_id:string,content:string,tool_calls:array<struct<id:string,`function`:struct<name:string,arguments:string>>>>>>"
RESPONSES = "struct<instructions:string,input:string,metadata:string>"
ITEMS = "array<struct<type:string,role:string,content:string,arguments:string,output:string>>"


def _texts(content: Column) -> Column:
    """A content that is a text, or a list of parts, as a list of texts. The address of an image is one, its data aren't."""
    address = lambda p: F.when(~p["image_url"]["url"].startswith("data:"), p["image_url"]["url"])
    parts = F.transform(F.from_json(content, _PARTS), lambda p: F.coalesce(p["text"], p["refusal"], address(p)))
    return F.when(content.startswith("["), F.array_compact(parts)).otherwise(F.array_compact(F.array(content)))


def chat_leaves(requests: DataFrame, key: str, body: str) -> DataFrame:
    """key, leaf, surface, text: message texts, refusals and addresses of images, the names of who speaks, the arguments and names of tool calls, and the
    ids that a tool's messages answer to. Names of tools are no text of anyone: they are leaves of the surface tool_name, for scans, not for masking."""
    messages = requests.select(key, F.posexplode(F.from_json(F.col(body), CHAT)["messages"]).alias("m", "x"))
    role = F.col("x.role")
    texts = messages.select(key, F.concat(F.lit("/messages/"), "m", F.lit("/content")).alias("leaf"), surface_of(role, "chat").alias("surface"), F.explode(_texts(F.col("x.content"))).alias("text"))
    calls = messages.select(key, "m", F.posexplode("x.tool_calls").alias("c", "call"))
    arguments = calls.select(key, F.concat(F.lit("/messages/"), "m", F.lit("/tool_calls/"), "c").alias("leaf"), F.lit("tool_use_input").alias("surface"), F.col("call.function.arguments").alias("text"))
    tools = calls.select(key, F.concat(F.lit("/messages/"), "m", F.lit("/tool_calls/"), "c", F.lit("/name")).alias("leaf"), F.lit("tool_name").alias("surface"), F.col("call.function.name").alias("text"))
    spoken = messages.select(key, F.concat(F.lit("/messages/"), "m", F.lit("/name")).alias("leaf"), F.lit("user_message").alias("surface"), F.col("x.name").alias("text"))
    answers = messages.filter(role == "tool").select(key, F.concat(F.lit("/messages/"), "m", F.lit("/tool_call_id")).alias("leaf"), F.lit("tool_result").alias("surface"), F.col("x.tool_call_id").alias("text"))
    return texts.union(arguments.union(tools).union(spoken).union(answers).filter("text IS NOT NULL"))


def responses_leaves(requests: DataFrame, key: str, body: str) -> DataFrame:
    """key, leaf, surface, text: instructions, a text input or its items, function arguments and outputs, and every string of the metadata at any depth."""
    parsed = requests.select(key, F.from_json(F.col(body), RESPONSES).alias("r"))
    head = parsed.filter("r.instructions IS NOT NULL").select(key, F.lit("/instructions").alias("leaf"), F.lit("system_prompt").alias("surface"), F.col("r.instructions").alias("text"))
    source = F.col("r.input")
    plain = parsed.filter(~source.startswith("[")).select(key, F.lit("/input").alias("leaf"), F.lit("user_message").alias("surface"), source.alias("text"))
    items = parsed.filter(source.startswith("[")).select(key, F.posexplode(F.from_json(source, ITEMS)).alias("i", "x"))
    leaf = F.concat(F.lit("/input/"), "i")
    texts = items.filter("x.content IS NOT NULL").select(key, leaf.alias("leaf"), surface_of(F.col("x.role"), "responses").alias("surface"), F.explode(_texts(F.col("x.content"))).alias("text"))
    call = items.filter("x.arguments IS NOT NULL").select(key, leaf.alias("leaf"), F.lit("tool_use_input").alias("surface"), F.col("x.arguments").alias("text"))
    out = items.filter("x.output IS NOT NULL").select(key, leaf.alias("leaf"), F.lit("tool_result").alias("surface"), F.col("x.output").alias("text"))
    notes = parsed.select(key, F.explode(leaves(F.col("r.metadata"), ())).alias("l"))
    noted = notes.select(key, F.concat(F.lit("/metadata"), F.expr("substring(l.path, 2)")).alias("leaf"), F.lit("user_message").alias("surface"), F.col("l.text").alias("text"))
    return head.union(plain).union(texts).union(call).union(out).union(noted)


def block_surface(block: Column) -> tuple[Column, Column]:
    """Text and kind of a content block given as JSON: a tool call shows as name(arguments), a result only where it says so."""
    kind = F.get_json_object(block, "$.type")
    call = F.concat(F.get_json_object(block, "$.name"), F.lit("("), F.coalesce(F.get_json_object(block, "$.input"), F.lit("")), F.lit(")"))
    text = F.when(kind == "tool_use", call).when(kind == "tool_result", F.get_json_object(block, "$.content")).otherwise(F.get_json_object(block, "$.text"))
    return text, F.when(kind.isin("tool_use", "tool_result"), kind).otherwise("message")


def sse_events(stream: Column) -> Column:
    """array<struct<event,data>> of a server-sent event stream; several data lines join with a line feed. A frame without either stays as event null, data null."""

    def frame(f: Column) -> Column:
        lines = F.regexp_extract_all(f, F.lit("(?m)^data: ?(.*)$"), F.lit(1))
        return F.struct(F.nullif(F.regexp_extract(f, "(?m)^event: ?(.*)$", 1), F.lit("")).alias("event"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("data"))

    return F.transform(F.filter(F.split(F.replace(stream, F.lit("\r\n"), F.lit("\n")), "\n\n"), lambda f: F.trim(f) != ""), frame)


def sse_frame(event: Column, data: Column) -> Column:
    lines = F.array_join(F.transform(F.split(data, "\n"), lambda d: F.concat(F.lit("data: "), d)), "\n")
    return F.concat(F.coalesce(F.concat(F.lit("event: "), event, F.lit("\n")), F.lit("")), lines, F.lit("\n\n"))

"""Queries of wires, transcripts, brokers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..operators import apply as A
from ..operators import broker as B
from ..operators import detect as D
from ..operators import gate
from ..operators import transcript as R
from ..operators import unmask as U
from ..sources import json_text as J
from ..sources import wires as W
from ..sources.files import parsed_transcript
from ..streaming import carry
from . import streams as V
from .masking import POLICY, masked_sql
from .registry import Fixture, query, table
from .sqltext import token_sql

BODIES = Fixture(
    "id int, body string",
    (1, '{"model":"m@x.io","messages":[{"role":"user","content":"mail a@b.io"},{"role":"assistant","content":[{"type":"text","text":"hi"},{"type":"image","data":"aGk="}]}],"metadata":{"note":"to c@d.io"}}'),
    (2, '{"z":1.50,"a":[true,null,"x"],"t":{"s":"é a@b.io"}}'), (3, '"bare a@b.io"'), (4, "[]"), (5, None),
).over("clicks", "click_id", text="props")
#: The clicks' own JSON, and one of the bodies above beside each. What is no JSON has no leaves.
_BODIES = f"(SELECT id, n, body FROM (SELECT id, unnest([0, 1]) AS n, unnest([own, body]) AS body FROM {BODIES.sql}) WHERE json_valid(body))"
_SKIP = "[.](" + "|".join(J.CONTRACT_KEYS["messages"]) + r")([.]|\[|$)"


@query(f"SELECT b.id, b.n, t.fullkey AS path, t.value ->> '$' AS text FROM {_BODIES} b, json_tree(b.body) t WHERE t.type = 'VARCHAR' AND NOT regexp_matches(t.fullkey, '{_SKIP}')")
def json_leaves(spark, sf_dir):
    bodies = BODIES.frame(spark, sf_dir).select("id", F.posexplode(F.array("own", "body")).alias("n", "body"))
    return bodies.select("id", "n", F.explode(J.leaves(F.col("body"))).alias("l")).select("id", "n", "l.path", "l.text")


#: A note that no row of the table has: it is masked beside the text.
_NOTE = "write to c@d.io"


def conversation_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, body: every turn as a JSON body, with paths that read alike and a contract key. A turn without a text becomes a body that is no JSON."""
    rows = table(spark, sf_dir, "conversations")
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    inner = F.struct(F.lit(_NOTE).alias("b"))
    body = F.to_json(F.struct(F.lit("m@x.io").alias("model"), "role", F.col("text").alias("a.b"), inner.alias("a"), content.alias("content")))
    return rows.select("conv_id", "turn", F.when(F.col("text").isNull(), '{"text": ').otherwise(body).alias("body"))


@query(f"""SELECT conv_id, turn, path, CASE path WHEN '$.role' THEN role WHEN '$.a.b ' THEN '{_NOTE}' ELSE text END AS text FROM (SELECT conv_id, turn, role, text, unnest(['$.role', '$.a.b', '$.a.b ', '$.content[0].text']) AS path FROM conversations WHERE text IS NOT NULL)""".replace("SELECT conv_id, turn, path,", "SELECT conv_id, turn, trim(path) AS path,", 1))
def json_leaves_conversations(spark, sf_dir):
    rows = conversation_bodies(spark, sf_dir).select("conv_id", "turn", F.explode(J.leaves(F.col("body"))).alias("l"))
    return rows.select("conv_id", "turn", "l.path", "l.text")


@query("SELECT conv_id, turn, contains(text, 'the') AS in_text, role = 'user' AS in_key FROM conversations WHERE text IS NOT NULL")
def tripwire_json(spark, sf_dir):
    """A secret inside a string leaf, or as an object key: a user's turn has its role as a key."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    body = F.to_json(F.struct(F.create_map("role", F.lit(1)).alias("roles"), F.col("text").alias("t")))
    own = rows.select("conv_id", "turn", J.keys_and_texts(body).alias("own"))
    return own.select("conv_id", "turn", F.exists("own", lambda x: x.contains("the")).alias("in_text"), F.exists("own", lambda x: x == "user").alias("in_key"))


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN '$.schema.enum[0]' WHEN 'system' THEN '$.tools[0].input_schema.title' END AS path FROM conversations WHERE role IN ('user', 'system') AND text IS NOT NULL AND contains(text, 'the')")
def tripwire_carve_out(spark, sf_dir):
    """Places that are never rewritten where a registered secret ('the') stands: such a request is refused. Base64 data is no text."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    schema, tool = F.struct(F.array("text").alias("enum")), F.struct(F.struct(F.col("text").alias("title")).alias("input_schema"))
    image = F.struct(F.lit("base64").alias("type"), F.col("text").alias("data"))
    body = F.when(F.col("role") == "user", F.to_json(F.struct(schema.alias("schema")))).when(F.col("role") == "system", F.to_json(F.struct(F.array(tool).alias("tools")))).otherwise(F.to_json(F.struct(image.alias("source"))))
    found = rows.select("conv_id", "turn", F.explode(J.carved_out(body)).alias("l")).filter(F.col("l.text").contains("the"))
    return found.select("conv_id", "turn", "l.path")


def masked_texts(texts: DataFrame) -> DataFrame:
    """(kind, text, changed): texts masked by every recognizer under the strict policy."""
    return D.with_detected(texts, POLICY, D.ALL).select("kind", "text", A.masked(F.col("text"), F.col("spans"), POLICY).alias("changed"))


_TURNS = "(SELECT conv_id || '/' || turn AS id, text FROM conversations)"
_MAIL = token_sql("salt", "'EMAIL_ADDRESS'", "'c@d.io'")


@query(f"""WITH {masked_sql(_TURNS, "id")} SELECT c.conv_id, c.turn, '{{"model":"m@x.io","role":' || to_json(c.role)::VARCHAR || ',"a.b":' || to_json(m.text)::VARCHAR || ',"a":{{"b":"write to ' || {_MAIL} || '"}},"content":[{{"type":"text","text":' || to_json(m.text)::VARCHAR || '}}]}}' AS body
FROM conversations c JOIN masked m ON m.id = c.conv_id || '/' || c.turn""")
def mask_json_roundtrip(spark, sf_dir):
    """Leaves outside the contract are masked by every recognizer and put back; all else stays as it was, in its order. What is no JSON becomes null."""
    return J.with_leaves_changed(conversation_bodies(spark, sf_dir), "body", masked_texts)


SECRETS = Fixture("name string, value string, case_sensitive boolean", ("key_a", "the", True), ("key_b", "ENE", False))


@query(f"""WITH {masked_sql(_TURNS, "id")}, turns AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn % 4 AS form FROM conversations),
named AS (SELECT t.*, m.text AS masked, CASE WHEN form <> 2 THEN NULL WHEN contains(t.text, 'the') THEN 'key_a' WHEN contains(translate(t.text, 'EN', 'en'), 'ene') THEN 'key_b' END AS secret
  FROM turns t JOIN masked m ON m.id = t.conv_id || '/' || t.turn)
SELECT conv_id, turn, secret, CASE form WHEN 1 THEN 'not_json' WHEN 3 THEN 'too_deep' ELSE CASE WHEN secret IS NOT NULL THEN 'secret_in_contract' END END AS refusal,
  CASE WHEN form = 0 THEN '{{"id":"r","text":' || to_json(coalesce(masked, ''))::VARCHAR || '}}' WHEN form = 2 AND secret IS NULL THEN '{{"id":' || to_json(text)::VARCHAR || '}}' END AS body FROM named""")
def gated_bodies(spark, sf_dir):
    """Every turn as a body: its text in a leaf, the same with a comma behind it, as an id that is never rewritten, or below 300 brackets. What can't be masked is refused."""
    text, form = F.coalesce("text", F.lit("")), F.col("turn") % 4
    plain, contract = F.to_json(F.struct(F.lit("r").alias("id"), text.alias("text"))), F.to_json(F.struct(text.alias("id")))
    deep = F.concat(F.lit("[" * 300), F.to_json(F.array(text)), F.lit("]" * 300))
    body = F.when(form == 0, plain).when(form == 1, F.concat(plain, F.lit(","))).when(form == 2, contract).otherwise(deep)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))
    return gate.gated(rows, "body", SECRETS.frame(spark), masked_texts).select("conv_id", "turn", "secret", "refusal", "body")


def response_kind(path: str) -> str | None:
    """How a response's leaf is restored: prose with all values, a tool's input by policy, other leaves not at all."""
    return "tool" if ".input" in path else "prose" if path.endswith(".text") else None


@query(f"""WITH {V.REPLIES_SQL} SELECT stream_id, '{{"content":[{{"type":"text","text":' || to_json({V.SAID_SQL})::VARCHAR || '}},{{"type":"thinking","thinking":"[URL_000000000001]"}},{{"type":"tool_use","input":' || {V.ARGS_SQL} || '}}]}}' AS body FROM replies""")
def unmask_json(spark, sf_dir):
    """Text blocks get every value back, tool inputs by policy, thinking none."""
    values = V.VALUES.frame(spark)
    rows = V.replies(spark, sf_dir).select("stream_id", F.concat(F.lit('{"content":[{"type":"text","text":'), F.regexp_extract(F.to_json(F.array("said")), r"(?s)^\[(.*)\]$", 1), F.lit('},{"type":"thinking","thinking":"[URL_000000000001]"},{"type":"tool_use","input":'), "args", F.lit("}]}")).alias("body"))

    def restored(texts: DataFrame) -> DataFrame:
        own = texts.withColumn("changed", F.col("text"))
        return U.unmasked(own.filter("kind = 'prose'"), "changed", values).union(U.unmasked_leaves(own.filter("kind = 'tool'"), "changed", values))

    return J.with_leaves_changed(rows, "body", restored, kind_of=response_kind)


def _with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("text IS NOT NULL").withColumn("id", F.concat_ws("/", "conv_id", "turn"))


def _wire_sql(*leaves: tuple[str, str, str]) -> str:
    """A row for each leaf (place, surface, SQL of its text) of every turn."""
    rows = ", ".join(f"{{'leaf': '{leaf}', 'surface': '{surface}', 'text': {text}}}" for leaf, surface, text in leaves)
    return f"SELECT id, l.leaf AS leaf, l.surface AS surface, l.text AS text FROM (SELECT conv_id || '/' || turn AS id, unnest([{rows}]) AS l FROM conversations WHERE text IS NOT NULL)"


_INPUT = """'{"q":' || to_json(text)::VARCHAR || '}'"""


@query(_wire_sql(("/messages/0/content", "system_prompt", "'be brief'"), ("/messages/1/content", "user_message", "text"), ("/messages/1/content", "user_message", "'https://a.io/' || conv_id"), ("/messages/1/name", "user_message", "role"),
    ("/messages/2/tool_calls/0", "tool_use_input", _INPUT), ("/messages/2/tool_calls/0/name", "tool_name", "'find'"), ("/messages/3/content", "tool_result", "text"), ("/messages/3/tool_call_id", "tool_result", "'call-' || turn")))
def leaves_chat_wire(spark, sf_dir):
    """Each turn in a chat request: said by someone with a name beside two images, given to a tool, and answered by it."""
    rows = _with_id(spark, sf_dir)
    none = F.lit(None).cast("string")
    image = lambda url: F.struct(F.lit("image_url").alias("type"), none.alias("text"), F.struct(url.alias("url")).alias("image_url"))
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("struct<url:string>").alias("image_url")), image(F.concat(F.lit("https://a.io/"), "conv_id")), image(F.lit("data:image/png;base64,aGk="))))
    call = F.to_json(F.array(F.struct(F.lit("1").alias("id"), F.struct(F.lit("find").alias("name"), F.to_json(F.struct(F.col("text").alias("q"))).alias("arguments")).alias("function"))))
    body = F.concat(
        F.lit('{"model":"m","messages":[{"role":"developer","content":"be brief"},{"role":"user","name":"'), "role", F.lit('","content":'), parts, F.lit('},{"role":"assistant","content":null,"tool_calls":'), call,
        F.lit('},{"role":"tool","tool_call_id":"call-'), "turn", F.lit('","content":'), F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1), F.lit("}]}"),
    )
    return W.chat_leaves(rows.select("id", body.alias("body")), "id", "body")


@query(f"""{_wire_sql(("/instructions", "system_prompt", "'be kind to ' || role"), ("/input/0", "user_message", "text"), ("/input/1", "tool_use_input", _INPUT), ("/input/2", "tool_result", "text"), ("/input/3", "assistant_text", "'no'"),
    ("/metadata.note", "user_message", "text"), ("/metadata.by.names[1]", "user_message", "role"), ("/metadata.by.names[0]", "user_message", "'it'"))} UNION ALL SELECT conv_id || '/' || turn || '/plain', '/input', 'user_message', text FROM conversations WHERE text IS NOT NULL AND NOT starts_with(text, '[')""")  # fmt: skip
def leaves_responses_wire(spark, sf_dir):
    """Each turn in a responses request, as the items of its input, in its metadata, and once more as a plain input."""
    rows = _with_id(spark, sf_dir).withColumn("quoted", F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1))
    arguments = F.regexp_extract(F.to_json(F.array(F.to_json(F.struct(F.col("text").alias("q"))))), r"(?s)^\[(.*)\]$", 1)
    body = F.concat(
        F.lit('{"instructions":"be kind to '), "role", F.lit('","input":[{"type":"message","role":"user","content":[{"type":"input_text","text":'), "quoted", F.lit('}]},{"type":"function_call","arguments":'), arguments,
        F.lit('},{"type":"function_call_output","output":'), "quoted", F.lit('},{"role":"assistant","content":[{"type":"refusal","refusal":"no"}]}],"metadata":{"note":'), "quoted", F.lit(',"n":1,"by":{"names":["it","'), "role", F.lit('"]}}}'),
    )
    plain = rows.filter(~F.col("text").startswith("[")).select(F.concat("id", F.lit("/plain")).alias("id"), F.concat(F.lit('{"input":'), "quoted", F.lit("}")).alias("body"))
    return W.responses_leaves(rows.select("id", body.alias("body")).union(plain), "id", "body")


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'ls({"p":' || to_json(text)::VARCHAR || '})' WHEN 2 THEN text END AS text, CASE turn % 4 WHEN 1 THEN 'tool_use' WHEN 2 THEN 'tool_result' ELSE 'message' END AS kind FROM conversations WHERE text IS NOT NULL""")
def surface_extract(spark, sf_dir):
    """Turns as content blocks: in turn a text, a tool call with the text in its input, a result, and an image that shows nothing."""
    rows, part = table(spark, sf_dir, "conversations").filter("text IS NOT NULL"), F.col("turn") % 4
    call = F.struct(F.lit("tool_use").alias("type"), F.lit("ls").alias("name"), F.struct(F.col("text").alias("p")).alias("input"))
    result, image = F.struct(F.lit("tool_result").alias("type"), F.col("text").alias("content")), F.struct(F.lit("image").alias("type"), F.struct(F.col("text").alias("data")).alias("source"))
    block = F.when(part == 0, F.to_json(F.struct(F.lit("text").alias("type"), "text"))).when(part == 1, F.to_json(call)).when(part == 2, F.to_json(result)).otherwise(F.to_json(image))
    text, kind = W.block_surface(F.col("block"))
    return rows.withColumn("block", block).select("conv_id", "turn", text.alias("text"), kind.alias("kind"))


ARGS = Fixture("id int, args string", (1, '{ "b" : 1, "a" : [ 1.0, 2 ] }'), (2, "not json"), (3, '"x"'), (4, None)).over("clicks", "click_id", text="props")


@query(f"SELECT id, CASE WHEN json_valid(args) THEN json(args)::VARCHAR ELSE args END AS args FROM (SELECT id, unnest([own, args]) AS args FROM {ARGS.sql})")
def canonical_args(spark, sf_dir):
    """The clicks' own JSON, and one of the arguments above beside each."""
    return ARGS.frame(spark, sf_dir).select("id", F.explode(F.array("own", "args")).alias("args")).select("id", J.canonical(F.col("args")).alias("args"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a transcript: conv_id, turn, uuid and parent of each turn."""
    name = lambda turn: F.concat(F.lit("c"), "conv_id", F.lit("-"), turn)
    return table(spark, sf_dir, "conversations").withColumns({"uuid": name(F.col("turn")), "parent": F.when(F.col("turn") > 0, name(F.col("turn") - 1))})


_TRANSCRIPT = "(SELECT *, 'c' || conv_id || '-' || turn AS uuid, CASE WHEN turn > 0 THEN 'c' || conv_id || '-' || (turn - 1) END AS parent FROM conversations)"


@query(f"SELECT conv_id * 1000000 + turn AS idx, uuid, parent, role AS type, to_json({{'content': text}})::VARCHAR AS message FROM {_TRANSCRIPT} WHERE text IS NOT NULL")
def transcript_scan(spark, sf_dir):
    """The conversations written as the lines of a transcript, each followed by a blank one, and read back."""
    rows = transcript(spark, sf_dir).filter("text IS NOT NULL")
    record = F.struct("uuid", F.col("parent").alias("parentUuid"), F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message"))
    lines = rows.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("idx"), F.explode(F.array(F.to_json(record), F.lit("  "))).alias("value"))
    return parsed_transcript(lines).select("idx", "uuid", "parent", "type", "message")


STREAMS = Fixture("id int, body string", (1, 'event: a\ndata: {"x":1}\n\nevent: b\ndata: l1\ndata: l2\n\n: ping\n\n'), (2, "data: only\r\n\r\n"), (3, "")).over("documents", "doc_id", text="text")
_PARSED = "(SELECT id, unnest(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10) || chr(10))) AS f FROM (SELECT id, body || 'event: doc' || chr(10) || 'data: ' || replace(replace(own, chr(13), ''), chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS body FROM {}))"


@query(f"""SELECT id, nullif(regexp_extract(f, '(?m)^event: ?(.*)$', 1), '') AS event, CASE WHEN regexp_matches(f, '(?m)^data:') THEN array_to_string(regexp_extract_all(f, '(?m)^data: ?(.*)$', 1), chr(10)) END AS data
FROM {_PARSED.format(STREAMS.sql)} WHERE trim(f) <> ''""")
def sse_parse(spark, sf_dir):
    """One of the streams above, then an event with a whole document."""
    rows = STREAMS.frame(spark, sf_dir).withColumn("body", F.concat("body", W.sse_frame(F.lit("doc"), F.replace("own", F.lit("\r"), F.lit("")))))
    return rows.select("id", F.explode(W.sse_events(F.col("body"))).alias("e")).select("id", "e.event", "e.data")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN '' ELSE 'event: ' || role || chr(10) END || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame FROM conversations")
def sse_frame(spark, sf_dir):
    """Turns as frames of a stream, those of users without an event."""
    event = F.when(F.col("role") != "user", F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", W.sse_frame(event, F.col("text")).alias("frame"))


RUNS = Fixture("id int, text string", (1, "a [URL_000000000001] b [X_00000000000a]"), (2, "[URL_000000000001]"), (3, "plain"), (4, "")).over("documents", "doc_id", text="text", into="text")


@query(f"""SELECT id, k, kind, text FROM (SELECT id, i * 2 AS k, 'plain' AS kind, g[i] AS text FROM (SELECT id, unnest(range(1, len(string_split_regex(text, '{U.TOKEN}')) + 1)) AS i, string_split_regex(text, '{U.TOKEN}') AS g FROM {RUNS.sql})
UNION ALL SELECT id, i * 2 + 1, 'token', m[i] FROM (SELECT id, unnest(range(1, len(regexp_extract_all(text, '{U.TOKEN}')) + 1)) AS i, regexp_extract_all(text, '{U.TOKEN}') AS m FROM {RUNS.sql})) WHERE text <> ''""")
def segment_runs(spark, sf_dir):
    """Plain and token runs in turn: their texts in order are the text."""
    rows = RUNS.frame(spark, sf_dir).select("id", F.posexplode(U.pieces(F.col("text"))).alias("i", "p"))
    plain = rows.select("id", ((F.col("i") + 1) * 2).cast("long").alias("k"), F.lit("plain").alias("kind"), F.col("p.text").alias("text"))
    token = rows.select("id", ((F.col("i") + 1) * 2 + 1).cast("long").alias("k"), F.lit("token").alias("kind"), F.col("p.token").alias("text"))
    return plain.union(token).filter("text <> ''")


VALUE_ROWS = Fixture("id int, preview string", (1, "ada@x.io wrote to ada@x.io and bob"), (2, "nobody"), (3, "bobada@x.io")).over("documents", "doc_id", text="text", into="preview")


@query(f"""SELECT id, value, strpos(preview, value) - 1 AS start, strpos(preview, value) - 1 + length(value) AS stop FROM {VALUE_ROWS.sql}, (VALUES ('ada@x.io'), ('bob')) v(value) WHERE contains(preview, value)""")
def value_spans(spark, sf_dir):
    """The first place of each known value in a preview."""
    values = F.array(F.lit("ada@x.io"), F.lit("bob"))
    rows = VALUE_ROWS.frame(spark, sf_dir).select("id", "preview", F.explode(values).alias("value")).withColumn("start", (F.call_function("position", F.col("value"), F.col("preview")) - 1).cast("long"))
    return rows.filter("start >= 0").select("id", "value", "start", (F.col("start") + F.length("value")).alias("stop"))


CALLS = Fixture(
    "id int, secret string, tool string, pointer string, value string",
    (1, "db", "psql", "/command", "psql -h DB.internal -U u"), (2, "db", "psql", "/command", "postgres://u:p@evil.com/x"), (3, "db", "Bash", "/command", "x"), (4, "db", "mcp__x", "/a", "x"), (5, "api", "curl", "/url", "https://api.a.io/v1?k=[T]"),
    (6, "api", "curl", "/url", "no url"), (7, "other", "curl", "/url", "https://api.a.io"), (8, "ssh-key", "ssh", "/args", "ssh -i key user@host.a.io:22 ls"), (9, "db", "mysql", "/c", "mysql --host=db2 x"), (10, "db", "psql", "/c", "host=db.internal port=1"), (11, "db", "Task", "/c", "x"), (12, "api", "curl", "/url", "https://api.a.io.evil.com"),
).over("clicks", "click_id")
RULE_ROWS = [(1, "db", "psql", "/c*", ["db.internal"]), (2, "api", "curl", "/url", ["API.a.io"]), (3, "ssh-*", "ssh", "*", None), (4, "db", "mysql", "*", ["db1"])]


@query(f"""SELECT c.id, t.decision, t.host FROM {CALLS.sql} c JOIN (VALUES (1, 'resolve', 'db.internal'), (2, 'host_not_allowed', 'evil.com'), (3, 'opaque_command', NULL), (4, 'egress_boundary', NULL), (5, 'resolve', 'api.a.io'), (6, 'host_unparsed', NULL), (7, 'no_rule', 'api.a.io'),
(8, 'resolve', 'host.a.io'), (9, 'host_not_allowed', 'db2'), (10, 'resolve', 'db.internal'), (11, 'egress_boundary', NULL), (12, 'host_not_allowed', 'api.a.io.evil.com')) t(id, decision, host) ON t.id = c.row""")
def broker_decide(spark, sf_dir):
    """Each click stands for a tool call."""
    rules = spark.createDataFrame(RULE_ROWS, "rule_idx int, secret_glob string, tool_glob string, param_glob string, hosts array<string>")
    return B.decided(CALLS.frame(spark, sf_dir), rules, "id")


@query("SELECT page_id, nullif(lower(regexp_extract(url, '[A-Za-z][A-Za-z0-9+.-]*://(?:[^\\s/@\"'']*@)?([^\\s/:?#\"'']+)', 1)), '') AS host FROM pages")
def dest_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", B._url_host(F.col("url")).alias("host"))


@query("""SELECT page_id AS id, '$.url' AS path, CASE WHEN page_id % 2 = 0 THEN 'https://api.a.io/?k=v@lue&at=' || url ELSE url || '&k=[BROKER__API_000000000001]' END AS text FROM pages WHERE url IS NOT NULL""")
def broker_resolve(spark, sf_dir):
    """Leaves of a tool's input that hold a broker token: resolved where the policy allows it, else left. Calls go to an allowed host or to a page's own."""
    pages = table(spark, sf_dir, "pages").filter("url IS NOT NULL")
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://api.a.io/?k=[BROKER__API_000000000001]&at="), "url")).otherwise(F.concat("url", F.lit("&k=[BROKER__API_000000000001]")))
    bodies = pages.select(F.col("page_id").alias("id"), F.to_json(F.struct(url.alias("url"))).alias("body"))
    leaves = bodies.select("id", F.explode(J.leaves(F.col("body"), ())).alias("l")).select("id", "l.path", F.col("l.text").alias("value"))
    calls = leaves.select(F.col("id"), F.lit("api").alias("secret"), F.lit("curl").alias("tool"), F.lit("/url").alias("pointer"), "value", "path")
    rules = spark.createDataFrame(RULE_ROWS, "rule_idx int, secret_glob string, tool_glob string, param_glob string, hosts array<string>")
    decided = B.decided(calls, rules, "id").join(leaves, "id")
    value = F.when(F.col("decision") == "resolve", F.replace("value", F.lit("[BROKER__API_000000000001]"), F.lit("v@lue"))).otherwise(F.col("value"))
    return decided.select("id", "path", value.alias("text"))


_REMOVED = "coalesce(length(text) % 3 <> 0, true)"


@query(f"""WITH RECURSIVE t AS (SELECT uuid, parent, {_REMOVED} AS removed FROM {_TRANSCRIPT}), walk AS (
  SELECT uuid, parent, 0 AS n FROM t WHERE NOT removed
  UNION ALL SELECT w.uuid, t.parent, n + 1 FROM walk w JOIN t ON t.uuid = w.parent WHERE t.removed)
SELECT uuid, parent FROM walk QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY n DESC) = 1""")
def relink_parents(spark, sf_dir):
    """Two turns in three are removed, by the length of their text: what is left hangs on the nearest turn that stays."""
    return R.relinked(transcript(spark, sf_dir).select("uuid", "parent", F.expr(_REMOVED).alias("removed")))


@query("""SELECT session, idx, kind FROM (SELECT *, min(idx) FILTER (redacted) OVER (PARTITION BY session) AS f FROM (SELECT conv_id AS session, turn AS idx, CASE role WHEN 'assistant' THEN 'thinking' ELSE 'text' END AS kind, coalesce(length(text) % 5 = 0, false) AS redacted FROM conversations))
WHERE f IS NULL OR idx < f OR kind <> 'thinking'""")
def drop_thinking(spark, sf_dir):
    """Assistant turns stand for thinking, every text whose length divides by five for a redacted one."""
    kind = F.when(F.col("role") == "assistant", "thinking").otherwise("text")
    records = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("idx"), kind.alias("kind"), F.coalesce(F.length("text") % 5 == 0, F.lit(False)).alias("redacted"))
    return R.drop_thinking(records).select("session", "idx", "kind")


BUFFERS = Fixture("id int, buffer string", *enumerate(["hello", "x [EMA", "x [EMAIL_ADDRESS_0123456789ab]", "x [not a", "[", "a [A_0] b [C_1", "[" + "A" * 70, "[A_0123456789ab"])).over("documents", "doc_id", text="text", into="buffer")
_TAIL_SQL = r"regexp_extract(buffer, '\[[A-Z0-9_a-f]*$')"


@query(f"SELECT id, CASE WHEN length({_TAIL_SQL}) <= 63 THEN substr(buffer, 1, length(buffer) - length({_TAIL_SQL})) ELSE buffer END AS safe, CASE WHEN length({_TAIL_SQL}) <= 63 THEN {_TAIL_SQL} ELSE '' END AS held FROM {BUFFERS.sql}")
def split_safe(spark, sf_dir):
    held = carry.held_tail(F.col("buffer"))
    return BUFFERS.frame(spark, sf_dir).select("id", F.substring("buffer", F.lit(1), F.length("buffer") - F.length(held)).alias("safe"), held.alias("held"))


PROFILE_TEXTS = Fixture("kind string, needle string, text string", ("EMAIL_ADDRESS", "a@b.io", "mail a@b.io"), ("IP_ADDRESS", "8.8.8.8", "host 8.8.8.8 up"), ("CREDIT_CARD", "4111111111111111", "card 4111111111111111"), ("NONE", "", "no data 12.5"), ("NONE", "", "v1.2.3")).over("clients", "client_id")


@query(f"""SELECT profile, kind, count(*) AS n, (count(*) * max(found / n))::BIGINT AS found, 0::BIGINT AS wrong FROM {PROFILE_TEXTS.sql} JOIN (VALUES ('strict', 'EMAIL_ADDRESS', 1, 1, 0), ('strict', 'IP_ADDRESS', 1, 1, 0), ('strict', 'CREDIT_CARD', 1, 1, 0), ('strict', 'NONE', 2, 0, 0), ('balanced', 'EMAIL_ADDRESS', 1, 1, 0), ('balanced', 'IP_ADDRESS', 1, 0, 0), ('balanced', 'CREDIT_CARD', 1, 1, 0), ('balanced', 'NONE', 2, 0, 0),
('minimal', 'EMAIL_ADDRESS', 1, 0, 0), ('minimal', 'IP_ADDRESS', 1, 0, 0), ('minimal', 'CREDIT_CARD', 1, 1, 0), ('minimal', 'NONE', 2, 0, 0), ('secrets_only', 'EMAIL_ADDRESS', 1, 0, 0), ('secrets_only', 'IP_ADDRESS', 1, 0, 0), ('secrets_only', 'CREDIT_CARD', 1, 0, 0), ('secrets_only', 'NONE', 2, 0, 0)) t(profile, kind, n, found, wrong) USING (kind) GROUP BY profile, kind""")
def profile_recall(spark, sf_dir):
    """Needles found and false finds by profile and entity."""
    from .policy import PROFILES, Policy

    rows, parts = PROFILE_TEXTS.frame(spark, sf_dir), []
    for profile in PROFILES:
        spans = D.detected(F.col("text"), Policy(profile=profile), (P.EMAIL, P.IPV4, P.CARD))
        hit = F.exists(spans, lambda s: (s["entity"] == F.col("kind")) & (s["value"] == F.col("needle")))
        wrong = F.size(F.filter(spans, lambda s: s["entity"] != F.col("kind")))
        parts.append(rows.select(F.lit(profile).alias("profile"), "kind", hit.cast("int").alias("hit"), wrong.alias("bad")))
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.union(part)
    return joined.groupBy("profile", "kind").agg(F.count("*").alias("n"), F.sum("hit").alias("found"), F.sum("bad").alias("wrong"))

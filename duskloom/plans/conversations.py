"""Queries over conversations and events: surfaces, turns, ledgers, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import conversation as C
from ..operators import ledger as L
from .registry import Fixture, query, table

_SURFACE = "CASE role WHEN 'assistant' THEN 'assistant_text' WHEN 'system' THEN 'system_prompt' ELSE 'user_message' END"
_LANE = "CASE role WHEN 'system' THEN 'harness_frame' WHEN 'assistant' THEN 'assistant' ELSE 'user_input' END"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.withColumns({"surface": C.surface_of(F.col("role")), "lane": C.provenance(F.lit("message"), F.col("role"), F.col("text")), "hash": C.block_hash(F.col("text"))})


@query(f"SELECT conv_id, turn, '/messages/' || turn || '/content' AS leaf, {_SURFACE} AS surface, text FROM conversations")
def leaves_from_conversations(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.concat(F.lit("/messages/"), F.col("turn"), F.lit("/content")).alias("leaf"), "surface", "text")


@query(f"SELECT role, {_SURFACE} AS surface, count(*) AS n FROM conversations GROUP BY role")
def role_surface(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("role", "surface").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, {_LANE} AS lane FROM conversations")
def provenance(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", "lane")


LANE_ROWS = Fixture(
    "id int, kind string, role string, text string",
    (1, "system", None, " x-anthropic-billing: 1"), (2, "system", None, "You are"), (3, "tool_use", "assistant", "ls"), (4, "tool_result", "user", "out"), (5, "message", "system", "hook"), (6, "message", "assistant", "hi"),
    (7, "message", "user", "<system-reminder>\nContents of CLAUDE.md"), (8, "message", "user", "<system-reminder>todo"), (9, "message", "user", "  <command-name>x"), (10, "message", "user", "hello"), (11, "message", None, "?"), (12, "message", "user", "<command-message>go"),
).over("documents", "doc_id", text="text", into="text", first=True)
_MARKS = " OR ".join(f"contains(lower(substr(ltrim(text), 18, 600)), '{m}')" for m in ("claudemd", "claude.md", "memory.md", "# memory", "codebase and user instructions", "user''s private global instructions"))


@query(f"""SELECT id, CASE WHEN kind IN ('system', 'instructions') AND starts_with(ltrim(text), 'x-anthropic') THEN 'harness_meta' WHEN kind IN ('system', 'instructions') THEN 'harness_frame' WHEN kind IN ('tool_use', 'tool_result') THEN 'tool_io'
WHEN role = 'system' THEN 'harness_frame' WHEN role = 'assistant' THEN 'assistant' WHEN starts_with(ltrim(text), '<system-reminder>') AND ({_MARKS}) THEN 'userctx' WHEN starts_with(ltrim(text), '<system-reminder>') THEN 'harness_frame'
WHEN starts_with(ltrim(text), '<command-message>') OR starts_with(ltrim(text), '<command-name>') THEN 'harness_frame' ELSE 'user_input' END AS lane FROM {LANE_ROWS.sql}""")
def provenance_lanes(spark, sf_dir):
    return LANE_ROWS.frame(spark, sf_dir).select("id", C.provenance(F.col("kind"), F.col("role"), F.col("text")).alias("lane"))


@query("SELECT conv_id, turn, sha256(text)[1:16] AS hash FROM conversations")
def block_hash(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", "hash")


@query("SELECT doc_id, CASE WHEN length(text) > 131072 THEN substr(text, 1, 131072) || '…' ELSE text END AS preview FROM documents")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.preview(F.col("text")).alias("preview"))


@query("""SELECT conv_id, coalesce(CASE WHEN length(t) > 48 THEN substr(t, 1, 48) || '…' ELSE t END, 'conversation ' || conv_id) AS label
FROM (SELECT conv_id, min_by(trim(regexp_replace(text, '\\s+', ' ', 'g')), turn) FILTER (role NOT IN ('system', 'assistant') AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') AS t FROM conversations GROUP BY conv_id)""")
def conversation_labels(spark, sf_dir):
    return C.labels(turns(spark, sf_dir), "conv_id", "turn", "text", "lane")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_index FROM conversations")
def turn_index(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns(spark, sf_dir).select("conv_id", "turn", F.row_number().over(w).cast("long").alias("turn_index"))


@query("""WITH n AS (SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS inputs FROM conversations),
m AS (SELECT *, (inputs > coalesce(lag(inputs) OVER (PARTITION BY conv_id ORDER BY turn), 0))::INT AS new FROM n)
SELECT conv_id, turn, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS human_turn FROM m""")
def human_turn_index(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    counted = turns(spark, sf_dir).withColumn("inputs", F.count_if(F.col("lane") == "user_input").over(w))
    return C.human_turns(counted, "conv_id", ["turn"], "inputs").select("conv_id", "turn", "human_turn")


def words_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surface for each distinct word of a turn: hashes that turns of a conversation share."""
    own = F.explode(F.array_distinct(F.split(F.col("text"), " ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("w")).select("conv_id", "turn", C.block_hash(F.col("w")).alias("hash"))


_WORDS = "words AS (SELECT DISTINCT conv_id, turn, sha256(unnest(string_split(text, ' ')))[1:16] AS hash FROM conversations)"


@query(f"""WITH {_WORDS}, sizes AS (SELECT conv_id, turn, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM words GROUP BY conv_id, turn),
fresh AS (SELECT w.conv_id, w.turn, count(*) AS n FROM words w JOIN sizes s USING (conv_id, turn) LEFT JOIN words p ON p.conv_id = w.conv_id AND p.turn = s.last AND p.hash = w.hash WHERE p.hash IS NULL GROUP BY ALL)
SELECT s.conv_id, s.turn, CASE WHEN k = 1 OR last + 1 <> s.turn THEN s.n ELSE coalesce(f.n, 0) END AS n_added, CASE WHEN k = 1 THEN 'first' WHEN last + 1 <> s.turn THEN 'prev_unavailable' END AS flag FROM sizes s LEFT JOIN fresh f USING (conv_id, turn)""")
def turn_delta(spark, sf_dir):
    return C.turn_deltas(words_of_turns(spark, sf_dir), "conv_id", "turn", "hash")


@query(f"""WITH {_WORDS}, shared AS (SELECT a.conv_id, a.turn, b.turn AS previous, count(*) AS overlap FROM words a JOIN words b ON a.conv_id = b.conv_id AND a.hash = b.hash AND b.turn < a.turn GROUP BY ALL)
SELECT conv_id, turn, previous, overlap FROM shared QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, previous DESC) = 1""")
def predecessor_turn(spark, sf_dir):
    return C.predecessors(words_of_turns(spark, sf_dir), "conv_id", "turn", "hash")


IDS = Fixture("id int, value string", (1, "abc"), (2, ""), (3, None), (4, "  "), (5, "x" * 129), (6, "a\nb"), (7, " pad "), (8, "é" * 65)).over("clients", "client_id", text="email")
_BOUND = "CASE WHEN coalesce(trim(value), '') = '' THEN 'unknown' WHEN strlen(value) > 128 OR regexp_matches(value, '[\\x00-\\x1F\\x7F]') THEN 'h-' || sha256(value)[1:16] ELSE trim(value) END"


@query(f"SELECT id, {_BOUND} AS bound FROM (SELECT id, unnest([value, own]) AS value FROM {IDS.sql})")
def bound_id(spark, sf_dir):
    """The clients' addresses as ids, and one of the ids above beside each."""
    return IDS.frame(spark, sf_dir).select("id", F.explode(F.array("value", "own")).alias("value")).select("id", C.bounded_id(F.col("value")).alias("bound"))


SESSIONS = Fixture("id int, metadata string", (1, '{"user_id": "{\\"session_id\\": \\"s-1\\"}"}'), (2, '{"user_id": "plain"}'), (3, "{}"), (4, None)).over("clicks", "click_id")


@query(f"SELECT id, try_cast(json_extract_string(metadata, '$.user_id') AS JSON) ->> '$.session_id' AS session FROM {SESSIONS.sql}")
def session_id(spark, sf_dir):
    return SESSIONS.frame(spark, sf_dir).select("id", F.get_json_object(F.get_json_object("metadata", "$.user_id"), "$.session_id").alias("session"))


HEADERS = Fixture("id int, conversation string, session string, thread string", (1, "c", "s", "t"), (2, " ", "s", "t"), (3, None, "", "t"), (4, None, None, None), (5, "", "", "  ")).over("clicks", "click_id")


@query(f"SELECT id, coalesce(nullif(trim(conversation), ''), nullif(trim(session), ''), nullif(trim(thread), '')) AS conversation_id FROM {HEADERS.sql}")
def conversation_id(spark, sf_dir):
    return HEADERS.frame(spark, sf_dir).select("id", F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("conversation", "session", "thread")]).alias("conversation_id"))


# Events stand for the requests of a ledger: a user is a token, an event type a lane, in a fixed and documented mapping.
EVENT_LANES = {"view": "tool_io", "click": "assistant", "purchase": "user_input", "signup": "userctx"}
_EVENT_LANE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_LANES.items()) + " ELSE 'harness_frame' END"
_RANK = "CASE lane " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.LANES.items()) + " ELSE 0 END"


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    lane = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_LANES.items()], F.lit("harness_frame"))
    return events.select(T.token("salt", "USER", F.col("user_id").cast("string")).alias("token"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), lane.alias("lane"), F.col("user_id").cast("string").alias("value"), (F.col("user_id") % 3 != 0).alias("peekable"), "event_id")


_USES = f"uses AS (SELECT '[USER_' || sha256('saltUSER:' || user_id)[1:12] || ']' AS token, epoch_us(ts) AS at_us, {_EVENT_LANE} AS lane, user_id::VARCHAR AS value, user_id % 3 <> 0 AS peekable, event_id FROM events)"
_LEDGER = f"{_USES}, ledger AS (SELECT token, count(*) AS n, min(at_us) AS first_seen, max(at_us) AS last_seen, arg_max(lane, {_RANK}) AS lane, coalesce(max(CASE WHEN peekable THEN value END), '') AS value FROM uses GROUP BY token)"


@query(f"WITH {_LEDGER} SELECT * FROM ledger")
def token_ledger(spark, sf_dir):
    return L.token_ledger(uses(spark, sf_dir))


@query(f"WITH {_LEDGER} SELECT token, last_seen FROM ledger ORDER BY (lane = 'user_input') DESC, last_seen DESC, token LIMIT 5000")
def ledger_top_k(spark, sf_dir):
    """The 5000 entries that stay when the ledger is cut: those of the current manifest first, then by recency."""
    rows = L.token_ledger(uses(spark, sf_dir))
    return L.newest(rows, L.TOP_TOKENS, (F.col("lane") == "user_input").desc(), F.col("last_seen").desc(), F.col("token")).select("token", "last_seen")


CLASSES = Fixture("id int, kind string, entity string", (1, "pii", "CVV"), (2, "broker", "DB"), (3, "local", "HOME"), (4, "pii", "EMAIL_ADDRESS"), (5, None, "URL")).over("documents", "doc_id")


@query(f"SELECT id, CASE WHEN entity = 'CVV' THEN 'sad' WHEN kind = 'broker' THEN 'broker' WHEN kind = 'local' THEN 'local' ELSE 'auto_pii' END AS class, CASE WHEN entity = 'CVV' OR kind IN ('broker') THEN false ELSE true END AS peekable FROM {CLASSES.sql}")
def token_class(spark, sf_dir):
    own = L.token_class(F.col("kind"), F.col("entity"))
    return CLASSES.frame(spark, sf_dir).select("id", own.alias("class"), (~own.isin("sad", "broker")).alias("peekable"))


@query("SELECT conv_id, max(turn) AS turn_count, max(turn * 60) AS last_updated, count(*) FILTER (role = 'system') AS pending FROM conversations GROUP BY conv_id")
def conversation_rollup(spark, sf_dir):
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.lit(None).cast("long").alias("human_turn"), (F.col("turn") * 60).alias("at"), (F.col("role") == "system").alias("pending"))
    return L.conversations(rows)


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recent_records(spark, sf_dir):
    return L.newest(table(spark, sf_dir, "events"), L.RECENT, F.col("ts").desc(), F.col("event_id").desc()).select("event_id", "event_type")


@query("SELECT user_id, last_seen FROM (SELECT user_id, epoch_us(max(ts)) AS last_seen FROM events GROUP BY user_id) ORDER BY last_seen DESC, user_id LIMIT 1024")
def hot_conversations(spark, sf_dir):
    """The 1024 keys of per-conversation state that stay, by when they were last seen; users stand for conversations."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("last_seen"))
    return L.newest(seen, L.CONVERSATIONS, F.col("last_seen").desc(), F.col("user_id"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first FROM events GROUP BY user_id")
def dedupe_last_wins(spark, sf_dir):
    return L.last_wins(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


_CHANNEL = "CASE WHEN user_id % 4 = 0 THEN 'body' WHEN user_id % 4 = 1 THEN 'path_query' WHEN user_id % 4 = 2 THEN 'header' ELSE 'carve_out' END"


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger events: five strings, never a value. Events with a value under 5 stand for refused requests."""
    channel = F.element_at(F.array(*map(F.lit, ("body", "path_query", "header", "carve_out"))), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").filter("value < 5").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.concat(F.lit("p"), F.col("user_id") % 7).alias("project"), F.lit("refused").alias("action"), F.upper("event_type").alias("entity_class"), channel.alias("channel"))


_REFUSALS = f"refusals AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, 'p' || (user_id % 7) AS project, 'refused' AS action, upper(event_type) AS entity_class, {_CHANNEL} AS channel FROM events WHERE value < 5)"


@query(f"WITH {_REFUSALS} SELECT * FROM refusals")
def refusal_ledger(spark, sf_dir):
    return refusals(spark, sf_dir)


@query(f"WITH {_REFUSALS} SELECT coalesce(entity_class, 'all') AS entity_class, coalesce(channel, 'all') AS channel, count(*) AS n FROM refusals GROUP BY CUBE (entity_class, channel)")
def refusals_rollup(spark, sf_dir):
    return refusals(spark, sf_dir).cube("entity_class", "channel").agg(F.count("*").alias("n")).select(F.coalesce("entity_class", F.lit("all")).alias("entity_class"), F.coalesce("channel", F.lit("all")).alias("channel"), "n")


@query(f"""WITH {_LEDGER} SELECT 'ledger' AS part, token AS key, first_seen AS at_us FROM ledger UNION ALL
SELECT 'conversation', conv_id::VARCHAR, max(turn) FROM conversations GROUP BY conv_id UNION ALL
SELECT * FROM (SELECT 'record', event_id::VARCHAR, epoch_us(ts) FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)""")
def monitor_snapshot(spark, sf_dir):
    ledger = L.token_ledger(uses(spark, sf_dir)).select(F.lit("ledger").alias("part"), F.col("token").alias("key"), F.col("first_seen").alias("at_us"))
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("at_us")).select(F.lit("conversation").alias("part"), F.col("conv_id").cast("string").alias("key"), "at_us")
    records = L.newest(table(spark, sf_dir, "events"), L.RECENT, F.col("ts").desc(), F.col("event_id").desc()).select(F.lit("record").alias("part"), F.col("event_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return ledger.union(talks).union(records)


_NOW = "2024-01-30 12:00:00"


@query(f"SELECT user_id, max(ts) >= TIMESTAMP '{_NOW}' - INTERVAL 10 MINUTES AS routed FROM events WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY user_id")
def routed_recently(spark, sf_dir):
    now = F.lit(_NOW).cast("timestamp")
    seen = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).filter(F.col("ts") <= now)
    return seen.groupBy("user_id").agg((F.max("ts") >= now - F.expr("INTERVAL 10 MINUTES")).alias("routed"))


@query("""WITH commands AS (SELECT user_id, ts AS since, CASE WHEN event_id % 4 = 0 THEN ts + to_seconds(1800) WHEN event_id % 4 = 2 THEN ts + to_seconds(least((value * 1000)::BIGINT, 86400)) ELSE ts END AS until FROM events WHERE event_type = 'signup'),
held AS (SELECT e.event_id, e.ts, c.until FROM events e ASOF LEFT JOIN commands c ON e.user_id = c.user_id AND e.ts >= c.since WHERE e.event_type <> 'signup')
SELECT event_id, coalesce(ts < until, false) AS off FROM held""")
def masking_off_windows(spark, sf_dir):
    """A signup stands for a command: with an even id it switches masking off, for 1000 seconds a unit of value or, where 4 divides the id, for the time that counts without one; else on."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    commands = events.filter("event_type = 'signup'").select("user_id", "at", (F.col("event_id") % 2 == 0).alias("off"), F.when(F.col("event_id") % 4 == 2, F.round(F.col("value") * 1000).cast("long")).alias("seconds"))
    return L.masking_off(commands, events.filter("event_type <> 'signup'"), "user_id")


@query("""WITH asked AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS answered FROM events),
open AS (SELECT *, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW) AS pending FROM asked)
SELECT event_id, CASE WHEN pending > 32 THEN 'backpressure_rejected' WHEN answered IS NULL OR answered > ts + INTERVAL 300 SECONDS THEN 'timed_out' ELSE 'answered' END AS outcome FROM open""")
def approval_outcomes(spark, sf_dir):
    """A user's next event answers an approval that this one asks for; more than 32 within 300 seconds are refused. How many are pending depends on
    the instant alone, so it is worked out once for each."""
    events = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    span = L.APPROVAL_S * 1_000_000
    own = Window.partitionBy("user_id").orderBy("us", "event_id")
    asked = events.select("event_id", "us", F.lead("us").over(own).alias("answered"))
    pending = L.within(events.groupBy("us").agg(F.count("*").alias("n")), "us", "n", span)
    outcome = F.when(F.col("pending") > L.PENDING, "backpressure_rejected").when(F.col("answered").isNull() | (F.col("answered") > F.col("us") + span), "timed_out").otherwise("answered")
    return asked.join(pending, "us").select("event_id", outcome.alias("outcome"))


HOLDS = Fixture("id int, mode string, found boolean, enabled boolean", *[(i, m, f, e) for i, (m, f, e) in enumerate((m, f, e) for m in ("off", "detections", "all") for f in (True, False) for e in (True, False))]).over("events", "event_id")


@query(f"SELECT id, CASE WHEN NOT enabled THEN false WHEN mode = 'all' THEN true WHEN mode = 'detections' THEN found ELSE false END AS hold FROM {HOLDS.sql}")
def hold_decision(spark, sf_dir):
    hold = F.when(~F.col("enabled"), False).when(F.col("mode") == "all", True).when(F.col("mode") == "detections", F.col("found")).otherwise(False)
    return HOLDS.frame(spark, sf_dir).select("id", hold.alias("hold"))


LIVES = Fixture(
    "request string, seq int, state string",
    ("a", 1, "pending"), ("a", 2, "accepted"), ("a", 3, "dispatched"), ("a", 4, "completed"), ("a", 5, "aborted"), ("b", 1, "pending"), ("b", 2, "rejected"), ("b", 3, "dispatched"), ("c", 1, "auto_accepted"), ("c", 2, "dispatched"), ("d", 1, "backpressure_rejected"),
).over("clicks", "click_id")


@query(f"""WITH l AS (SELECT *, min(seq) FILTER (state IN {L.TERMINAL}) OVER (PARTITION BY request) AS e FROM (SELECT DISTINCT request || '-' || (id // 11) AS request, seq, state FROM {LIVES.sql}))
SELECT request, arg_max(state, seq) AS final, count(*) AS n FROM l WHERE e IS NULL OR seq <= e GROUP BY request""")
def request_lifecycle(spark, sf_dir):
    """Clicks stand for what is logged: eleven in a row are the states of four requests. A click that is logged twice counts once."""
    logged = LIVES.frame(spark, sf_dir).select(F.concat("request", F.lit("-"), F.expr("id div 11").cast("string")).alias("request"), "seq", "state").distinct()
    return L.lifecycles(logged, "request", "seq", "state")


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (e IS NULL OR event_id <= e) AS final, count(*) FILTER (e IS NULL OR event_id <= e) AS n
FROM (SELECT *, min(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS e FROM events) GROUP BY user_id""")
def event_lifecycle(spark, sf_dir):
    """The same fold over events, where a purchase is a completion."""
    state = F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))
    rows = L.lifecycles(table(spark, sf_dir, "events").withColumn("state", state), "user_id", "event_id", "state")
    return rows.select("user_id", F.when(F.col("final") == "completed", "purchase").otherwise(F.col("final")).alias("final"), "n")


@query("SELECT DISTINCT value FROM (SELECT unnest([city, segment, source]) AS value FROM clients) WHERE value IS NOT NULL")
def allow_list_union(spark, sf_dir):
    """Lists of three layers: the clients' cities, segments and sources."""
    lists = F.array(*[F.struct(F.lit(layer).alias("layer"), F.col(c).alias("value")) for layer, c in (("user", "city"), ("project", "segment"), ("local", "source"))])
    rows = table(spark, sf_dir, "clients").select(F.inline(lists))
    parts = [rows.filter(F.col("layer") == layer).select("value") for layer in ("user", "project", "local")]
    return parts[0].union(parts[1]).union(parts[2]).filter("value IS NOT NULL").distinct()


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each user's turn, that repeats all of its conversation's user turns so far: id, at, blocks. Texts of equal length modulo 3 stand for
    equal ones, so that conversations share beginnings; they speak in turn, the later turns after all earlier ones."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    block = F.substring(F.sha2((F.coalesce(F.length("text"), F.lit(0)) % 3).cast("string"), 256), 1, 16)
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    said = rows.withColumn("blocks", F.collect_list(block).over(so_far))
    return said.select((F.col("turn") * 1_000_000_000 + F.col("conv_id")).alias("id"), F.col("turn").alias("at"), "blocks")


@query("""WITH RECURSIVE said AS (SELECT turn * 1000000000 + conv_id AS id, turn AS came, list(sha256((coalesce(length(text), 0) % 3)::VARCHAR)[1:16]) OVER (PARTITION BY conv_id ORDER BY turn) AS blocks FROM conversations WHERE role = 'user'),
asked AS (SELECT id, 'auto-' || blocks[1] AS base, array_to_string(blocks, '|') || '|' AS seq, sha256(array_to_string(blocks, '|'))[1:8] AS digest, row_number() OVER (PARTITION BY blocks[1] ORDER BY came, id) AS k FROM said),
walk AS (
  SELECT DISTINCT base, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::VARCHAR AS conversation, []::STRUCT(c VARCHAR, s VARCHAR)[] AS standing FROM asked
  UNION ALL
  SELECT base, k, id, c, list_append(list_filter(standing, lambda x: x.c <> c), {'c': c, 's': seq}) FROM (
    SELECT a.base, a.k, a.id, a.seq, w.standing, coalesce(list_sort(list_transform(list_filter(w.standing, lambda x: starts_with(a.seq, x.s)), lambda x: {'n': -length(x.s), 'c': x.c}))[1].c,
      CASE WHEN len(list_filter(w.standing, lambda x: x.c = a.base)) > 0 THEN a.base || '-' || a.digest ELSE a.base END) AS c
    FROM walk w JOIN asked a ON a.base = w.base AND a.k = w.k + 1))
SELECT id, conversation FROM walk WHERE k > 0""")
def prefix_conversations(spark, sf_dir):
    """The conversation of each request by the longest prefix that one stands at, in order of arrival; else a new one."""
    return C.content_conversations(transcripts(spark, sf_dir), "id", "at", "blocks")


SELECTIONS = Fixture("target string", ("local",), ("vendor",), ("gone",), ("beta",)).over("conversations", "conv_id")
TARGETS = Fixture("name string, user_verified boolean, attested boolean", ("local", True, False), ("vendor", False, True), ("beta", True, True))


@query(f"SELECT DISTINCT id AS conversation, CASE WHEN user_verified THEN target END AS target, CASE WHEN user_verified THEN 'restored' WHEN name IS NULL THEN 'reverted_missing' ELSE 'reverted_unverified' END AS outcome FROM {SELECTIONS.sql} LEFT JOIN {TARGETS.sql} ON name = target")
def revalidate_selections(spark, sf_dir):
    """Each conversation has chosen a target."""
    rows = SELECTIONS.frame(spark, sf_dir).select(F.col("id").alias("conversation"), "target").distinct().join(F.broadcast(TARGETS.frame(spark)), F.col("target") == F.col("name"), "left")
    outcome = F.when(F.col("user_verified"), "restored").when(F.col("name").isNull(), "reverted_missing").otherwise("reverted_unverified")
    return rows.select("conversation", F.when(F.col("user_verified"), F.col("target")).alias("target"), outcome.alias("outcome"))


@query("SELECT conv_id, substr(string_agg(text, '' ORDER BY turn), 1, 131072) AS captured FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def response_capture(spark, sf_dir):
    """Assistant turns appended in order, cut at a cap. Only what lies below the cap is gathered."""
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    used = rows.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).filter(F.col("before") < C.PREVIEW)
    kept = used.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, C.PREVIEW).alias("t")))).alias("p"))
    return kept.select("conv_id", F.substring(F.array_join(F.transform("p", lambda x: x["t"]), ""), 1, C.PREVIEW).alias("captured"))


@query("""WITH s AS (SELECT conv_id, turn, strlen(text) AS b, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS done FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, (done // 160 - (done - b) // 160)::BIGINT AS flushes FROM s WHERE done // 160 > (done - b) // 160""")
def progress_flushes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.octet_length("text").alias("b"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    done = rows.withColumn("done", F.sum("b").over(w))
    flushes = F.floor(F.col("done") / 160) - F.floor((F.col("done") - F.col("b")) / 160)
    return done.select("conv_id", "turn", flushes.alias("flushes")).filter("flushes > 0")

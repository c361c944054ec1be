"""Queries of masking, the vault and unmasking."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions import text as T
from ..functions.checkpoint import saved
from ..operators import apply as A
from ..operators import detect as D
from ..operators import unmask as U
from ..operators import vault as V
from .contextsql import birth_sql, code_sql, credential_sql, expiry_sql
from .detection import documents, spans_of
from .policy import CATEGORIES, Operator, Policy
from .registry import Fixture, query, table
from .sqltext import plausible_sql, recognized_sql, resolved_sql, spans_sql, token_sql

POLICY = Policy(profile="strict")
KEY = "0123456789abcdef0123456789abcdef"

#: Labels whose values masking cuts for good.
CUT = ("CREDIT_CARD", "CVV")
_KEPT = "repeat('*', greatest(length(value) - 4, 0)::INT) || right(value, 4)"

#: What a value's own text, or the text before it, says against it.
_RESERVED = r"""(regexp_matches(value, '^(127|10)[.]|^192[.]168[.]|^169[.]254[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]|^0+[.]0+[.]0+[.]0+$') OR regexp_matches(lower(value), '^(0{1,4}:){7}0{0,3}1$|^::1$|^::$|^(0{1,4}:){7}0{1,4}$|^fe[89ab][0-9a-f]:|^2001:0?db8:'))"""
_NAMESPACE = r"""regexp_matches(substr(t, 1, start), '(^|[^0-9A-Za-z_$.:-])(xmlns|xmlns:[0-9A-Za-z_.-]+|[$]schema|[$]id|[$]ref|targetNamespace|schemaLocation|[0-9A-Za-z_.-]+:schemaLocation)["'']?[ \t]*[=:][ \t]*["'']?$')"""
_FILE = "NOT contains(value, '/') AND NOT contains(value, ':') AND NOT starts_with(lower(value), 'www.') AND lower(string_split(value, '.')[-1]) IN ('cc', 'go', 'la', 'md', 'ml', 'pl', 'py', 'rb', 'rs', 'sh', 'so')"
_QUOTED = """(entity IN ('URL', 'DOMAIN') AND length(value) >= 3 AND value[1] = value[-1] AND value[1] IN ('"', '''', '`'))"""


def found_sql(source: str = "documents", key: str = "doc_id") -> str:
    """key, entity, start, stop, value of all that masking finds: every recognizer's spans through every gate, overlaps resolved."""
    used = [r for r in D.ALL if r.score >= POLICY.floor - 0.35]
    parts = []
    for order, r in enumerate(used):
        if isinstance(r, P.Recognizer):
            check = plausible_sql("value") if r is P.API_KEY else "true" if r is P.PREFIXED_KEY else None
            parts.append(recognized_sql(source, key, r.entity, r.plain, r.score, r.context, check, order))
        elif r is D.BIRTH:
            parts.append(birth_sql(source, key, order))
        elif r is D.CODE:
            parts.append(code_sql(source, key, order))
        elif r is D.EXPIRY:
            parts.append(expiry_sql(source, key, order))
        else:
            parts.append(credential_sql(source, key, order))
    rows = " UNION ALL ".join(parts)
    gates = f"score >= {POLICY.floor} AND NOT (entity = 'PHONE_NUMBER' AND score <= 0.4) AND NOT (entity = 'IP_ADDRESS' AND {_RESERVED}) AND NOT (entity = 'URL' AND {_NAMESPACE}) AND NOT (entity = 'DOMAIN' AND {_FILE})"
    gated = f"SELECT {key}, entity, CASE WHEN {_QUOTED} THEN start + 1 ELSE start END AS start, CASE WHEN {_QUOTED} THEN stop - 1 ELSE stop END AS stop, CASE WHEN {_QUOTED} THEN value[2:-2] ELSE value END AS value, score, ord FROM ({rows}) WHERE {gates}"
    return resolved_sql(gated, key)


def rendered_sql() -> str:
    return f"CASE entity WHEN 'CREDIT_CARD' THEN {_KEPT} WHEN 'CVV' THEN '[REDACTED]' ELSE {token_sql('salt', 'entity', 'value')} END"


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, spans: the resolved spans of all recognizers in every document under the strict policy."""
    return D.with_detected(documents(spark, sf_dir).select("doc_id", "text"), POLICY, D.ALL)


def each_span(*fields: str) -> Column:
    """A row for each span of document_spans with some of its fields. A filter on the column spans, written or inferred from its explosion, would be moved
    below all steps of detection and work them out again for itself, each as often as it is named; rows are dropped by exploding a new array instead."""
    return F.explode(F.transform("spans", lambda s: F.struct(*[s[f].alias(f) for f in fields])))


def masked_sql(source: str = "documents", key: str = "doc_id") -> str:
    """CTEs: found; masked (key, text, original) of the texts of a table."""
    return f"""
found AS ({found_sql(source, key)}),
numbered AS (SELECT *, {rendered_sql()} AS shown, row_number() OVER (PARTITION BY {key} ORDER BY start) AS k, lag(stop, 1, 0) OVER (PARTITION BY {key} ORDER BY start) AS prev FROM found),
joined AS (
  SELECT d.{key}, string_agg(substr(d.text, n.prev + 1, n.start - n.prev) || n.shown, '' ORDER BY n.k) AS head, max(n.stop) AS last
  FROM numbered n JOIN {source} d USING ({key}) GROUP BY d.{key}
),
masked AS (SELECT d.{key}, CASE WHEN j.last IS NULL THEN d.text ELSE j.head || substr(d.text, j.last + 1) END AS text, d.text AS original FROM {source} d LEFT JOIN joined j USING ({key}))
"""


MASKED_SQL = masked_sql()


@query(found_sql())
def document_found(spark, sf_dir):
    """All that masking finds in the documents, overlaps resolved."""
    rows = document_spans(spark, sf_dir).select("doc_id", each_span("entity", "start", "end", "value").alias("s"))
    return rows.select("doc_id", F.col("s.entity").alias("entity"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.value").alias("value"))


@query(f"WITH {MASKED_SQL} SELECT doc_id, text FROM masked")
def mask_documents(spark, sf_dir):
    """Flagship: every document with all that the recognizers find as tokens, cards cut to four digits and their codes redacted."""
    return document_spans(spark, sf_dir).select("doc_id", A.masked(F.col("text"), F.col("spans"), POLICY).alias("text"))


@query(f"WITH {MASKED_SQL} SELECT doc_id, text <> original AS changed FROM masked")
def changed_flag(spark, sf_dir):
    return document_spans(spark, sf_dir).select("doc_id", (A.masked(F.col("text"), F.col("spans"), POLICY) != F.col("text")).alias("changed"))


def all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_spans(spark, sf_dir).select("doc_id", each_span("entity", "value").alias("s")).select("doc_id", F.col("s.entity").alias("entity"), F.col("s.value").alias("value"))


@query(f"SELECT DISTINCT entity, {token_sql('salt', 'entity', 'value')} AS token, value FROM ({found_sql()})")
def mint_tokens(spark, sf_dir):
    return all_spans(spark, sf_dir).select("entity", T.token("salt", F.col("entity"), F.col("value")).alias("token"), "value").distinct()


@query(f"SELECT doc_id, value, '[' || entity || ':' || sha256(entity || ':' || value)[1:12] || ']' AS shown FROM ({found_sql()})")
def op_hash(spark, sf_dir):
    return all_spans(spark, sf_dir).select("doc_id", "value", T.hash_mark(F.col("entity"), F.col("value")).alias("shown"))


@query(f"SELECT doc_id, value, '[' || entity || ':' || sha256('pepper' || entity || ':' || value)[1:12] || ']' AS shown FROM ({found_sql()})")
def op_hash_salted(spark, sf_dir):
    return all_spans(spark, sf_dir).select("doc_id", "value", T.hash_mark(F.col("entity"), F.col("value"), "pepper").alias("shown"))


def mask_all(spark: SparkSession, sf_dir: str, operator: Operator) -> DataFrame:
    policy = Policy(profile="strict", overrides={e: operator for e in POLICY.entities()})
    masked = F.when(F.size("spans") > 0, F.array(A.masked(F.col("text"), F.col("spans"), policy)))
    return document_spans(spark, sf_dir).select("doc_id", F.explode(masked).alias("text"))


def mask_all_sql(shown: str) -> str:
    return f"WITH {MASKED_SQL.replace(rendered_sql(), shown)} SELECT doc_id, text FROM masked WHERE doc_id IN (SELECT doc_id FROM found)"


@query(mask_all_sql("'[REDACTED]'"))
def op_redact(spark, sf_dir):
    return mask_all(spark, sf_dir, Operator("redact"))


@query(mask_all_sql("repeat('#', greatest(length(value) - 3, 0)::INT) || right(value, 3)"))
def op_mask(spark, sf_dir):
    return mask_all(spark, sf_dir, Operator("mask", "#", 3))


@query(f"SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM ({found_sql()}))")
def op_keep(spark, sf_dir):
    return mask_all(spark, sf_dir, Operator("keep"))


@query(mask_all_sql(token_sql("salt", "'BROKER__' || entity", "value").replace("'salt' || 'BROKER__' || entity", "'salt' || ('BROKER__' || entity)")))
def op_broker(spark, sf_dir):
    return mask_all(spark, sf_dir, Operator("broker"))


@query(mask_all_sql(token_sql("salt", "entity", "value")))
def op_local(spark, sf_dir):
    return mask_all(spark, sf_dir, Operator("local"))


SLUGS = Fixture("id int, name string", *enumerate(["db-password", "API key (prod)", "", "é", "a" * 40, "x_1", "--"])).over("clients", "client_id", text="name")
_SLUG = "CASE WHEN name = '' THEN '_' ELSE upper(substr(regexp_replace(name, '[^0-9A-Za-z]', '_', 'g'), 1, 32)) END"


@query(f"SELECT id, {_SLUG} AS slug FROM (SELECT id, unnest([name, own]) AS name FROM {SLUGS.sql})")
def slugify(spark, sf_dir):
    """Slugs of the clients' names, and of one of the names above beside each."""
    return SLUGS.frame(spark, sf_dir).select("id", F.explode(F.array("name", "own")).alias("name")).select("id", T.slug(F.col("name")).alias("slug"))


BYPASS = Fixture(
    "id int, text string",
    (1, "mail a@b.io and >>c@d.io<< end"), (2, ">>x@y.io"), (3, ">>a@b.io<<>>c@d.io<<"), (4, "a >>b << c << d@e.io"), (5, ">>one\ntwo@x.io<< u@v.io"), (6, ""), (7, "no marks u@v.io"),
).over("documents", "doc_id", text="text", into="text")


@query(f"""WITH parts AS (
  SELECT id, unnest(range(1, len(string_split_regex(text, '(?s)>>(.*?)<<')) + 1)) AS n, string_split_regex(text, '(?s)>>(.*?)<<') AS o, regexp_extract_all(text, '(?s)>>(.*?)<<', 1) AS r FROM {BYPASS.sql}
), rows AS (SELECT id, n, o[n] AS part, coalesce(r[n], '') AS raw FROM parts),
spans AS (SELECT id, n, start, stop, value, lag(stop, 1, 0) OVER (PARTITION BY id, n ORDER BY start) AS prev, t FROM ({spans_sql("rows", "id, n", "part", P.EMAIL.plain)})),
heads AS (SELECT id, n, string_agg(substr(t, prev + 1, start - prev) || {token_sql("salt", "'EMAIL_ADDRESS'", "value")}, '' ORDER BY start) AS head, max(stop) AS last FROM spans GROUP BY id, n)
SELECT id, string_agg(CASE WHEN head IS NULL THEN part ELSE head || substr(part, last + 1) END || raw, '' ORDER BY n) AS text FROM rows LEFT JOIN heads USING (id, n) GROUP BY id""")
def user_bypass(spark, sf_dir):
    mask = lambda t: S.splice(t, S.find(t, P.EMAIL.plain, "EMAIL_ADDRESS", 1.0), A.rendered(POLICY))
    return BYPASS.frame(spark, sf_dir).select("id", A.with_bypass(F.col("text"), mask).alias("text"))


SURFACE_ROWS = Fixture("id int, surface string", *enumerate(["user_message", "system_prompt", "tool_result", "assistant_text", "tool_use_input"])).over("clients", "client_id", text="email")


@query(f"SELECT id, surface, CASE WHEN surface IN ('system_prompt', 'tool_use_input') THEN 'mail ' || own ELSE 'mail ' || {token_sql('salt', "'EMAIL_ADDRESS'", 'own')} END AS text FROM {SURFACE_ROWS.sql}")
def surface_gate(spark, sf_dir):
    """The clients' addresses, each on one of five surfaces: two aren't masked."""
    rows = SURFACE_ROWS.frame(spark, sf_dir).withColumn("text", F.concat(F.lit("mail "), "own"))
    masked = S.splice(F.col("text"), spans_of(P.EMAIL), A.rendered(POLICY))
    return rows.select("id", "surface", F.when(F.col("surface").isin("system_prompt", "tool_use_input"), F.col("text")).otherwise(masked).alias("text"))


@query(f"""WITH found AS ({found_sql()}), shown AS (SELECT *, {rendered_sql()} AS token FROM found),
shifted AS (SELECT *, coalesce(sum(length(token) - (stop - start)) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM shown)
SELECT doc_id, token, value, entity, start, stop, (start + shift)::INT AS masked_start, (start + shift + length(token))::INT AS masked_stop FROM shifted WHERE entity NOT IN ('CREDIT_CARD', 'CVV')""")
def manifest(spark, sf_dir):
    rows = document_spans(spark, sf_dir).select("doc_id", F.explode(A.manifest(F.col("spans"), POLICY)).alias("m"))
    return rows.select("doc_id", "m.token", "m.value", "m.entity", "m.start", F.col("m.end").alias("stop"), "m.masked_start", F.col("m.masked_end").alias("masked_stop"))


MARKED = Fixture("id int, text string", (1, "hello ⟪a@b.io⟫ there"), (2, "⟪⟫"), (3, "none"), (4, "⟪open")).over("documents", "doc_id", text="text", into="text")


@query(f"SELECT id, replace(replace(text, '⟪', ''), '⟫', '') AS text, contains(text, '⟪') OR contains(text, '⟫') AS marked FROM {MARKED.sql}")
def marker_strip(spark, sf_dir):
    left, right = U.MARKER
    text = F.col("text")
    return MARKED.frame(spark, sf_dir).select("id", F.replace(F.replace(text, F.lit(left), F.lit("")), F.lit(right), F.lit("")).alias("text"), (text.contains(left) | text.contains(right)).alias("marked"))


ANSI = Fixture("id int, text string", (1, "\x1b[31mred\x1b[0m plain"), (2, "cut \x1b["), (3, "\x1b lone"), (4, "none"), (5, "\x1b[1;2Hx")).over("documents", "doc_id", text="text", into="text")


@query(f"SELECT id, regexp_replace(text, '\x1b(\\[[^@-~]*[@-~]?)?', '', 'g') AS text FROM {ANSI.sql}")
def ansi_strip(spark, sf_dir):
    return ANSI.frame(spark, sf_dir).select("id", T.strip_ansi(F.col("text")).alias("text"))


SECRET = "thwh"


@query(f"""WITH spans AS (SELECT *, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS prev FROM ({spans_sql("documents", "doc_id", "text", SECRET, False)})),
heads AS (SELECT doc_id, string_agg(substr(t, prev + 1, start - prev) || '[REDACTED]', '' ORDER BY start) AS head, max(stop) AS last, any_value(t) AS t FROM spans GROUP BY doc_id)
SELECT doc_id, head || substr(t, last + 1) AS text FROM heads""")
def mask_when_disabled(spark, sf_dir):
    """With masking off, only registered secrets are still masked."""
    policy = Policy(overrides={"SECRET": Operator("redact")})
    text, found = F.col("text"), S.find_literal(F.col("text"), SECRET, "SECRET", "secret")
    return documents(spark, sf_dir).filter(text.contains(SECRET)).select("doc_id", S.splice(text, found, A.rendered(policy)).alias("text"))


@query(f"SELECT entity, count(*) AS n_spans, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS n_docs FROM ({found_sql()}) GROUP BY entity")
def entity_counts(spark, sf_dir):
    return all_spans(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("n_spans"), F.countDistinct("value").alias("n_values"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(n, 0) END AS n_spans FROM documents
LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({spans_sql("documents", "doc_id", "text", P.EMAIL.plain)}) GROUP BY doc_id) USING (doc_id)""")
def dedup_detect(spark, sf_dir):
    """Detection runs once for each distinct text, on the row with the least id; only ids, digests and counts move. A null text has none."""
    rows = documents(spark, sf_dir).select("doc_id", "text", F.sha2(F.concat(F.lit("leaf:"), "text"), 256).alias("k"))
    keys = rows.select("doc_id", "k")
    first = keys.filter("k IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    once = rows.join(first.select(F.col("doc_id").alias("f"), F.col("k").alias("fk")), (F.col("doc_id") == F.col("f")) & (F.col("k") == F.col("fk")), "left_semi")
    counted = once.select("k", F.size(spans_of(P.EMAIL)).cast("long").alias("n_spans")).groupBy("k").agg(F.max("n_spans").alias("n_spans"))
    return keys.join(counted, "k", "left").select("doc_id", "n_spans")


@query("SELECT doc_id, sha256('leaf:' || text) AS text_key FROM documents")
def text_key(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.concat(F.lit("leaf:"), "text"), 256).alias("text_key"))


_TOKENS = f"SELECT DISTINCT {token_sql('salt', 'entity', 'value')} AS token, value, entity FROM ({found_sql()}) WHERE entity NOT IN ('CREDIT_CARD', 'CVV')"


def tokens_of(spans: Column) -> Column:
    """array<struct<token,value,entity>> of the spans that become tokens."""
    reversible = F.filter(spans, lambda s: ~s["entity"].isin(*CUT))
    return F.transform(reversible, lambda s: F.struct(T.token("salt", s["entity"], s["value"]).alias("token"), s["value"].alias("value"), s["entity"].alias("entity")))


def vault_rows(rows: DataFrame) -> DataFrame:
    """token, value, kind, entity of all tokens that masking rows (spans) makes."""
    made = rows.select(F.explode(tokens_of(F.col("spans"))).alias("t"))
    return made.select("t.token", "t.value", F.lit("pii").alias("kind"), "t.entity")


def masked_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, n_cards: the masked documents; token, value: the vault): every text is searched once, and what is found is written."""
    n_cut = F.size(F.filter("spans", lambda s: s["entity"].isin(*CUT))).cast("long")
    rows = saved(document_spans(spark, sf_dir).select("doc_id", A.masked(F.col("text"), F.col("spans"), POLICY).alias("text"), n_cut.alias("n_cards"), F.col("spans")))
    return rows.drop("spans"), V.interned(vault_rows(rows)).select("token", "value")


@query(f"SELECT token, value, 'pii' AS kind FROM ({_TOKENS}) WHERE token NOT LIKE '[IP%0]'")
def vault_build(spark, sf_dir):
    """New tokens of this batch; those that end in 0 and stand for addresses have a tombstone."""
    rows = vault_rows(document_spans(spark, sf_dir))
    tombstones = rows.filter("token LIKE '[IP%0]'").select("token").distinct()
    return V.interned(rows, tombstones=tombstones)


@query(f"SELECT token, value FROM ({_TOKENS})")
def vault_roundtrip(spark, sf_dir):
    stored = V.interned(vault_rows(document_spans(spark, sf_dir))).withColumn("ciphertext", V.encrypted(F.col("value"), KEY))
    return stored.select("token", V.decrypted(F.col("ciphertext"), KEY).alias("value"))


@query(f"SELECT token, value FROM ({_TOKENS}) WHERE entity <> 'EMAIL_ADDRESS'")
def vault_tombstone(spark, sf_dir):
    vault = V.interned(vault_rows(document_spans(spark, sf_dir)))
    return V.without_tombstones(vault, vault.filter("token LIKE '[EMAIL%'")).select("token", "value")


@query(f"SELECT count(DISTINCT token) AS n_tokens FROM ({_TOKENS})")
def token_count(spark, sf_dir):
    return vault_rows(document_spans(spark, sf_dir)).agg(F.countDistinct("token").alias("n_tokens"))


_KINDS = "CASE entity WHEN 'EMAIL_ADDRESS' THEN 'local' WHEN 'IP_ADDRESS' THEN 'broker' ELSE 'pii' END"
_USES = f"uses AS (SELECT DISTINCT coalesce(source, '') AS session, {token_sql('salt', 'entity', 'value')} AS token, value, {_KINDS} AS kind FROM ({found_sql()}) JOIN documents USING (doc_id) WHERE entity NOT IN ('CREDIT_CARD', 'CVV'))"


@query(f"WITH {_USES} SELECT session, token, CASE WHEN kind = 'pii' OR (kind = 'local' AND session LIKE '%1%' AND token NOT LIKE '%0]') THEN value END AS value FROM uses")
def vault_promotions(spark, sf_dir):
    """A source is a session, e-mail addresses are local secrets, network addresses brokered. Sources with a 1 in their name ask for every token of theirs,
    twice, in two batches; tokens that end in 0 have a tombstone. What each session's tools may read."""
    rows = saved(D.with_detected(documents(spark, sf_dir).select("source", "text"), POLICY, D.ALL).select(F.coalesce("source", F.lit("")).alias("session"), F.explode(tokens_of(F.col("spans"))).alias("t")).select("session", "t.*").distinct())
    kind = F.when(F.col("entity") == "EMAIL_ADDRESS", "local").when(F.col("entity") == "IP_ADDRESS", "broker").otherwise("pii")
    vault = V.interned(rows.withColumn("kind", kind))
    asked, gone = rows.filter("session LIKE '%1%'").select("session", "token"), vault.filter("token LIKE '%0]'")
    first = V.promoted(asked.union(asked).filter("token LIKE '%a%'"), vault, gone)
    both = first.union(V.promoted(asked.union(asked), vault, gone, known=first))
    return V.tool_values(rows.select("session", "token").distinct(), vault, both)


#: A client's token, from its number; what is sold asks for it.
_CLIENT = "('[CLIENT_' || sha256(client_id::VARCHAR)[1:12] || ']')"
#: A vault of clients: two in four personal data, of which one runs out 60 days after it was last seen; the others a brokered secret and a local one.
_STORE = f"""store AS (SELECT {_CLIENT} AS token, max(email) AS value, CASE client_id % 4 WHEN 1 THEN 'broker' WHEN 2 THEN 'local' ELSE 'pii' END AS kind, CASE WHEN client_id % 4 IN (1, 2) THEN 'client-' || client_id END AS secret_name,
CASE WHEN client_id % 4 = 3 THEN max(updated_at) + INTERVAL 60 DAYS END AS expires_at FROM clients WHERE client_id IS NOT NULL GROUP BY client_id)"""
_ASKED = f"asked AS (SELECT sale_id AS id, {_CLIENT} AS token FROM sales)"
_NOW = "2024-04-15 00:00:00"


def client_token() -> Column:
    return F.concat(F.lit("[CLIENT_"), F.substring(F.sha2(F.col("client_id").cast("string"), 256), 1, 12), F.lit("]"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault with a token for each client."""
    seen = table(spark, sf_dir, "clients").filter("client_id IS NOT NULL").groupBy("client_id").agg(F.max("email").alias("value"), F.max("updated_at").alias("at"))
    part = F.col("client_id") % 4
    kind = F.when(part == 1, "broker").when(part == 2, "local").otherwise("pii")
    name = F.when(part.isin(1, 2), F.concat(F.lit("client-"), F.col("client_id").cast("string")))
    ends = F.when(part == 3, F.col("at").cast("timestamp") + F.expr("INTERVAL 60 DAYS"))
    return seen.select(client_token().alias("token"), "value", kind.alias("kind"), name.alias("secret_name"), ends.alias("expires_at"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sales").select(F.col("sale_id").alias("id"), client_token().alias("token"))


@query(f"WITH {_STORE}, {_ASKED} SELECT id, a.token, s.value FROM asked a LEFT JOIN store s ON s.token = a.token AND s.kind = 'pii' AND (s.expires_at IS NULL OR s.expires_at > TIMESTAMP '{_NOW}')")
def reveal(spark, sf_dir):
    """The address behind the client of each sale, where it may be shown and its time isn't up."""
    return V.revealed(asked(spark, sf_dir), store(spark, sf_dir), now=_NOW).select("id", "token", "value")


@query(f"WITH {_STORE}, {_ASKED} SELECT id, a.token, coalesce(kind, 'unknown') AS class, CASE WHEN kind IN ('pii', 'local') THEN value WHEN kind = 'broker' THEN secret_name END AS shown FROM asked a LEFT JOIN store s USING (token)")
def reveal_audit(spark, sf_dir):
    return V.audited(asked(spark, sf_dir), store(spark, sf_dir))


@query(f"WITH {MASKED_SQL} SELECT doc_id, regexp_extract_all(text, '{U.TOKEN}').len() AS n FROM masked WHERE regexp_matches(text, '{U.TOKEN}')")
def token_scan(spark, sf_dir):
    n = F.size(U.tokens_in(A.masked(F.col("text"), F.col("spans"), POLICY))).cast("long")
    return document_spans(spark, sf_dir).select("doc_id", F.explode(F.filter(F.array(n), lambda n: n > 0)).alias("n"))


@query(f"SELECT DISTINCT token, regexp_extract(token, '^.([A-Z0-9_]+)_[0-9a-f]{{12}}.$', 1) AS label FROM ({_TOKENS})")
def token_label(spark, sf_dir):
    return vault_rows(document_spans(spark, sf_dir)).select("token").distinct().select("token", U.label_of(F.col("token")).alias("label"))


@query(f"""SELECT d.doc_id, d.text, (CASE WHEN c.n IS NULL THEN 0 ELSE c.n END) AS n_cards FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({found_sql()}) WHERE entity IN ('CREDIT_CARD', 'CVV') GROUP BY doc_id) c USING (doc_id) WHERE c.n IS NULL""")
def unmask_roundtrip(spark, sf_dir):
    """Masked documents restored from the vault: without a card or its code, which masking cuts for good, the text is the original."""
    masked, vault = masked_once(spark, sf_dir)
    return U.unmasked(masked.filter("n_cards = 0"), "text", vault)


@query(f"WITH {MASKED_SQL.replace(rendered_sql(), "'⟪' || value || '⟫'")} SELECT doc_id, text FROM masked WHERE doc_id IN (SELECT doc_id FROM found) AND doc_id NOT IN (SELECT doc_id FROM found WHERE entity IN ('CREDIT_CARD', 'CVV'))")
def unmask_display(spark, sf_dir):
    masked, vault = masked_once(spark, sf_dir)
    return U.unmasked(masked.filter((F.col("n_cards") == 0) & F.col("text").rlike(U.TOKEN)).select("doc_id", "text"), "text", vault, U.MARKER)


REPLIES = Fixture("id int, text string", (1, "and [F_000000000006]"), (2, "[F_000000000006][Z_00000000000a]"), (3, "[a_000000000001] [A_00000000001]"), (4, "none"), (5, None)).over("clicks", "click_id")


@query(f"WITH {_STORE}, said AS (SELECT id, concat_ws(' ', {_CLIENT}, text) AS text FROM (SELECT *, id // 7 AS client_id FROM {REPLIES.sql})) SELECT id, token FROM (SELECT id, unnest(regexp_extract_all(text, '{U.TOKEN}')) AS token FROM said) WHERE token NOT IN (SELECT token FROM store)")
def fabricated_handles(spark, sf_dir):
    """A reply to each click names a client, which may not exist, and one of the texts above: tokens that the vault lacks."""
    said = REPLIES.frame(spark, sf_dir).withColumn("client_id", F.expr("id div 7"))
    seen = said.select("id", F.explode(U.tokens_in(F.concat_ws(" ", client_token(), "text"))).alias("token"))
    return seen.join(store(spark, sf_dir).select("token"), "token", "left_anti").select("id", "token")


_LABELS = [*dict.fromkeys(e for labels in CATEGORIES.values() for e in labels), "DATE_TIME", "MY_RULE"]
LABELS = Fixture("entity string", *[(e,) for e in _LABELS]).over("documents", "doc_id")
_RESTORE = f"CASE WHEN entity IN ('URL', 'DOMAIN', 'IP_ADDRESS') THEN 'embedded' WHEN entity IN {('MAC_ADDRESS', *CATEGORIES['personal'])} THEN 'whole_value' ELSE 'gated' END"


@query(f"SELECT id, entity, {_RESTORE} AS policy FROM {LABELS.sql}")
def restore_policy(spark, sf_dir):
    return LABELS.frame(spark, sf_dir).select("id", "entity", U.restore_policy(F.col("entity")).alias("policy"))


AROUND = Fixture(
    "id int, before string, after string",
    (1, "", ""), (2, "  ", "\n"), (3, '"', '"'), (4, '{"a": "', '"}'), (5, '"', '": 1'), (6, '\\"', '"'), (7, '\\\\"', '"'), (8, 'curl "', ' x"'), (9, '"', ""), (10, "x", ""), (11, '"', '"  :'),
).over("clicks", "click_id")
_BARE = "regexp_replace(before || after, '\\s+', '', 'g') = ''"


@query(f"""SELECT id, CASE WHEN {_BARE} THEN 'bare' WHEN ends_with(before, '"') AND length(regexp_extract(before, '(\\\\*)"$', 1)) % 2 = 0 AND starts_with(after, '"') AND NOT regexp_matches(after, '^"[ \\t\\r\\n]*:') THEN 'quoted' END AS on_raw,
CASE WHEN {_BARE} THEN 'bare' END AS on_leaf FROM {AROUND.sql}""")
def whole_value(spark, sf_dir):
    b, a = F.col("before"), F.col("after")
    return AROUND.frame(spark, sf_dir).select("id", U.whole_value(b, a, True).alias("on_raw"), U.whole_value(b, a, False).alias("on_leaf"))


TOOL = Fixture(
    "id int, text string",
    (1, "curl [URL_000000000001] -v"), (2, "[EMAIL_ADDRESS_000000000002]"), (3, " [PERSON_000000000003] "), (4, "dear [PERSON_000000000003]"), (5, "[MAC_ADDRESS_000000000004]"), (6, "[DATE_TIME_000000000005]"), (7, "x [DOMAIN_000000000006] [URL_00000000000f]"),
).over("documents", "doc_id", text="source")
TOOL_VALUES = Fixture("token string, value string", ("[URL_000000000001]", "http://a.io"), ("[EMAIL_ADDRESS_000000000002]", "a@b.io"), ("[PERSON_000000000003]", "Ada"), ("[MAC_ADDRESS_000000000004]", "00:1A"), ("[DATE_TIME_000000000005]", "2020"), ("[DOMAIN_000000000006]", "b.io"))


@query(f"""WITH parts AS (SELECT id, text, unnest(range(1, len(string_split_regex(text, '{U.TOKEN}')) + 1)) AS i FROM {TOOL.sql}),
cut AS (SELECT id, i, string_split_regex(text, '{U.TOKEN}')[i] AS piece, regexp_extract_all(text, '{U.TOKEN}')[i] AS token, text FROM parts),
joined AS (SELECT c.*, value, regexp_extract(token, '^.([A-Z0-9_]+)_[0-9a-f]{{12}}.$', 1) AS entity FROM cut c LEFT JOIN {TOOL_VALUES.sql} v USING (token))
SELECT id, string_agg(piece || coalesce(CASE WHEN {_RESTORE} = 'embedded' OR ({_RESTORE} = 'whole_value' AND trim(text) = token) THEN value END, token, ''), '' ORDER BY i) AS text FROM joined GROUP BY id""")
def unmask_tool_input(spark, sf_dir):
    """A decoded leaf of a tool's input: request targets come back anywhere, names only as the whole value, all else stays."""
    policy = U.restore_policy(U.label_of(F.col("token")))
    allowed = (policy == "embedded") | ((policy == "whole_value") & (F.trim("_whole") == F.col("token")))
    return U.unmasked(TOOL.frame(spark, sf_dir).select("id", "text"), "text", TOOL_VALUES.frame(spark), allowed=allowed)


CUSTOM = Fixture("id int, text string", (1, "deploy <<PROJECT>> now"), (2, "<<PROJECT>><<CODE>>"), (3, "nothing")).over("documents", "doc_id", text="text", into="text")


@query(f"SELECT id, replace(replace(text, '<<PROJECT>>', 'Apollo'), '<<CODE>>', 'x9') AS text FROM {CUSTOM.sql}")
def literal_token_unmask(spark, sf_dir):
    text = F.col("text")
    for token, value in (("<<PROJECT>>", "Apollo"), ("<<CODE>>", "x9")):
        text = F.replace(text, F.lit(token), F.lit(value))
    return CUSTOM.frame(spark, sf_dir).select("id", text.alias("text"))


@query(f"""WITH f AS ({found_sql()}), s AS (SELECT doc_id, count(*) FILTER (entity NOT IN ('CREDIT_CARD', 'CVV')) AS tokens, count(*) FILTER (entity IN ('CREDIT_CARD', 'CVV')) AS masked, count(*) AS spans FROM f GROUP BY doc_id)
SELECT d.source, count(*) AS leaves, count(*) FILTER (s.doc_id IS NULL) AS clean, coalesce(sum(tokens), 0)::BIGINT AS tokens, coalesce(sum(masked), 0)::BIGINT AS masked, coalesce(sum(spans), 0)::BIGINT AS spans FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.source""")
def mask_stats(spark, sf_dir):
    rows = D.with_detected(documents(spark, sf_dir).select("source", "text"), POLICY, D.ALL)
    cards = F.size(F.filter("spans", lambda s: s["entity"].isin(*CUT)))
    return rows.groupBy("source").agg(F.count("*").alias("leaves"), F.count_if(F.size("spans") == 0).alias("clean"), F.sum(F.size("spans") - cards).alias("tokens"), F.sum(cards).alias("masked"), F.sum(F.size("spans")).alias("spans"))

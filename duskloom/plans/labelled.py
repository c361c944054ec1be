"""Queries of label-driven recognizers and registered secrets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import context as X
from ..functions import spans as S
from ..functions import text as T
from ..operators import detect as D
from ..operators import secrets as G
from .contextsql import birth_sql, cards_sql, code_sql, credential_sql, expiry_sql
from .detection import documents
from .registry import Fixture, query, table
from .sqltext import spans_sql

#: Texts, and what each label-driven recognizer finds in them, written by hand.
CARE_ROWS: list[tuple[str | None, list[tuple[str, str]]]] = [
    ("DOB: 1990-01-02", [("DATE_OF_BIRTH", "1990-01-02")]), ("DOB:\n2023-11-15", [("DATE_OF_BIRTH", "2023-11-15")]), ("born January 2, 1990", [("DATE_OF_BIRTH", "January 2, 1990")]),
    ("1990-01-02 (DOB)", [("DATE_OF_BIRTH", "1990-01-02")]), ("12/25/1990 is my DOB", [("DATE_OF_BIRTH", "12/25/1990")]), ("dob 03 / 27 / 1985", [("DATE_OF_BIRTH", "03 / 27 / 1985")]),
    ("date of birth is 19901225", [("DATE_OF_BIRTH", "19901225")]), ("DOB: 1990-01-02T00:00", [("DATE_OF_BIRTH", "1990-01-02")]), ("D.O.B. 27/03/1985", [("DATE_OF_BIRTH", "27/03/1985")]),
    ("DOB 1990-01-02 DOB 1991-02-03", [("DATE_OF_BIRTH", "1990-01-02"), ("DATE_OF_BIRTH", "1991-02-03")]), ("DOB: 1985-03-27-99", []), ("DOB:\n\n\n\n123", []), ("born to run, ETA 12/25", []), ("1990-01-02 dob-related", []),
    ("card 4111111111111111 exp 03/27", [("CREDIT_CARD_EXPIRATION", "03/27")]), ("expiration date 11/2028 on the visa", [("EXPIRATION_DATE", "11/2028")]), ("my travel visa expires 03/26", [("EXPIRATION_DATE", "03/26")]),
    ("my gift card expires 03/26", [("EXPIRATION_DATE", "03/26")]), ("subscription valid thru 12/25", [("EXPIRATION_DATE", "12/25")]), ("4111 1111 1111 1111 exp 03/27", [("CREDIT_CARD_EXPIRATION", "03/27")]),
    ("credit card on file, exp 03/27", [("CREDIT_CARD_EXPIRATION", "03/27")]), ("card exp 03/27/2025", []), ("card exp 03/271", []), ("export 03/27", []), ("the cache expires 12/24", []), ("certificate expires Jan 2026", []),
    ("discard exp 03/27", []), ("the discovery expires 03/27", []), ("scorecard 1234 03/27", []), ("0000000000000 exp 03/27", []),
    ("CVV: 123", [("CVV", "123")]), ("cvv2=4567", [("CVV", "4567")]), ("123 (CVV)", [("CVV", "123")]), ("security code 4821", [("CVV", "4821")]), ("cvv is 123", [("CVV", "123")]), ("123 is my CVV", [("CVV", "123")]), ("CVV:\n321", [("CVV", "321")]),
    ("the security code is 200 lines long", []), ("cid=4096", []), ('{"csc": 200}', []), ("cvc2-500", []), ("CVV:\n\n\n\n123", []),
    ("https://a.io/?token=hunter2&x=1", [("URL_CREDENTIAL", "hunter2")]), ('password: "letmein"', [("URL_CREDENTIAL", "letmein")]), ("redis://:pw@host/0", [("URL_CREDENTIAL", ":pw")]), ("https://user:pass@h.io", [("URL_CREDENTIAL", "user:pass")]),
    ("Authorization: Basic dXNlcjpwYXNz", [("URL_CREDENTIAL", "dXNlcjpwYXNz")]), ('{"token":"Bearer letmein-jwt"}', [("URL_CREDENTIAL", "letmein-jwt")]), ("db_password=s3cr3t", [("URL_CREDENTIAL", "s3cr3t")]),
    ("shared_access_signature=abcd", [("URL_CREDENTIAL", "abcd")]), ("sharedaccesssignature=abce", [("URL_CREDENTIAL", "abce")]), ("x-amz-signature=ffff", [("URL_CREDENTIAL", "ffff")]), ("?token=ab,cd,ef&id=1", [("URL_CREDENTIAL", "ab,cd,ef")]),
    ("a%3Ftoken%3Dletmein-x", [("URL_CREDENTIAL", "letmein-x")]), ("?state=%7B%22token%22%3A%22letmein%22%7D", [("URL_CREDENTIAL", "letmein")]), ("x%253Ftoken%253Dletmein2x", [("URL_CREDENTIAL", "letmein2x")]),
    ("é%3Ftoken%3Dlétmein", [("URL_CREDENTIAL", "létmein")]), ("git@github.com", []), ("tokens this session : 8", []), ("?key=abc", []), ("sort-key=colname", []), ("redis://:p@h", []), ("", []), (None, []),
]
CARE = Fixture("id int, text string", *enumerate(t for t, _ in CARE_ROWS)).over("documents", "doc_id", text="text", into="text", first=True)


def care(spark: SparkSession, sf_dir: str, spans) -> DataFrame:
    """What is found in the whole documents, each with one of the texts above before its own."""
    rows = CARE.frame(spark, sf_dir).select("id", F.explode(spans(F.col("text"))).alias("s"))
    return rows.select("id", F.col("s.entity").alias("entity"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.value").alias("value"))


def _by_hand(found: Callable[[str, str], str], *entities: str) -> str:
    """The rows written by hand; every value stands first in its text. found: SQL of what the documents hold themselves, which lies behind."""
    wanted = Fixture("id int, entity string, value string", *[(i, e, v) for i, (_, found) in enumerate(CARE_ROWS) for e, v in found if e in entities])
    behind = f"SELECT id, entity, (start + length(text) - length(own))::INT AS start, (stop + length(text) - length(own))::INT AS stop, value FROM ({found('documents', 'doc_id')}) f JOIN {CARE.sql} c ON c.id = f.doc_id"
    return f"SELECT c.id, entity, (strpos(text, value) - 1)::INT AS start, (strpos(text, value) - 1 + length(value))::INT AS stop, value FROM {CARE.sql} c JOIN {wanted.sql} w ON c.row = w.id UNION ALL {behind}"


@query(_by_hand(birth_sql, "DATE_OF_BIRTH"))
def dob_spans(spark, sf_dir):
    return care(spark, sf_dir, lambda text: D.recognized(text, D.BIRTH))


@query(_by_hand(code_sql, "CVV"))
def cvv_spans(spark, sf_dir):
    return care(spark, sf_dir, X.security_codes)


@query(_by_hand(expiry_sql, "CREDIT_CARD_EXPIRATION", "EXPIRATION_DATE"))
def expiry_spans(spark, sf_dir):
    return care(spark, sf_dir, X.expiries)


@query(_by_hand(credential_sql, "URL_CREDENTIAL"))
def url_credential_spans(spark, sf_dir):
    return care(spark, sf_dir, X.credentials)


@query(f"SELECT doc_id, entity, start, stop, value FROM ({credential_sql('documents', 'doc_id')})")
def document_credentials(spark, sf_dir):
    """Values behind 'token = "...", and user:password before a host. The SQL reads texts as they stand: no document has a percent escape."""
    found = F.explode(D.recognized(F.col("text"), D.CREDENTIAL)).alias("s")
    return documents(spark, sf_dir).select("doc_id", found).select("doc_id", F.col("s.entity").alias("entity"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"), F.col("s.value").alias("value"))


@query(f"SELECT doc_id, unnest({cards_sql('text')}) AS digits FROM documents")
def luhn_cards(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(X.card_numbers(F.col("text"))).alias("digits"))


@query("SELECT doc_id, contains(w, ' the ') AS has_the, contains(w, ' apache license ') AS has_apache FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')) || ' ' AS w FROM documents)")
def term_match(spark, sf_dir):
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", X.has_term(text, ("the",)).alias("has_the"), X.has_term(text, ("apache license",)).alias("has_apache"))


#: Words of documents as a table of secrets: those of eleven letters and more with 'th' before them; every third length in any letter case, under
#: the name of their first four letters.
_SECRETS = "secrets AS (SELECT DISTINCT upper(w[1:4]) AS name, w AS value, length(w) % 3 <> 0 AS case_sensitive FROM (SELECT unnest(regexp_extract_all(text, 'th[a-z]{9,}')) AS w FROM documents))"


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit("th[a-z]{9,}"), F.lit(0))).alias("value"))
    return rows.select(F.upper(F.substring("value", 1, 4)).alias("name"), "value", (F.length("value") % 3 != 0).alias("case_sensitive")).distinct()


def _literal_sql(value: str, case: str) -> str:
    """Every place of every secret of a kind of letter case in the documents' texts: substrings of its length from each place."""
    return f"""SELECT doc_id, name, p - 1 AS start, p - 1 + n AS stop FROM (
  SELECT doc_id, t, unnest(range(1, length(t) - n + 2)) AS p, n FROM (SELECT doc_id, {value.format("text")} AS t FROM documents) CROSS JOIN (SELECT DISTINCT length(value) AS n FROM secrets WHERE {case}) WHERE length(t) >= n
) JOIN (SELECT name, {value.format("value")} AS v FROM secrets WHERE {case}) ON substr(t, p, n) = v"""


@query(f"WITH {_SECRETS} SELECT doc_id, name, start::INT AS start, stop::INT AS stop FROM ({_literal_sql('{}', 'case_sensitive')} UNION ALL {_literal_sql('lower({})', 'NOT case_sensitive')})")
def secret_literal_spans(spark, sf_dir):
    """Every occurrence of thousands of secrets from a table, overlapping ones too."""
    rows = G.literal_hits(documents(spark, sf_dir).select("doc_id", "text"), "text", secrets(spark, sf_dir))
    return rows.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.name", "h.start", F.col("h.end").alias("stop"))


#: Names as three teams might write them: a client's city and segment with another mark between.
_NAMED = "(SELECT DISTINCT concat_ws(CASE client_id % 3 WHEN 0 THEN '-' WHEN 1 THEN '.' ELSE ' ' END, city, segment) AS name FROM clients)"
_SLUG = "upper(substr(regexp_replace(name, '[^0-9A-Za-z]', '_', 'g'), 1, 32))"


@query(f"SELECT {_SLUG} AS slug, count(*) AS n, array_to_string(list(name ORDER BY name), ',') AS names FROM {_NAMED} GROUP BY 1 HAVING count(*) > 1")
def slug_collisions(spark, sf_dir):
    mark = F.when(F.col("client_id") % 3 == 0, "-").when(F.col("client_id") % 3 == 1, ".").otherwise(" ")
    parts = F.array_compact(F.array("city", "segment"))
    names = table(spark, sf_dir, "clients").select(F.when(F.size(parts) == 2, F.concat(parts[0], mark, parts[1])).otherwise(F.array_join(parts, "")).alias("name"))
    return G.slug_collisions(names.distinct())


_TRIPWIRES = Fixture("name string, value string, case_sensitive boolean", ("first", "thwh", True), ("second", "Apache", False), ("third", "zzzzqq", True))


@query(f"""SELECT doc_id, arg_min(name, (start, name)) AS name FROM (SELECT doc_id, name, strpos(CASE WHEN case_sensitive THEN text ELSE lower(text) END, CASE WHEN case_sensitive THEN value ELSE lower(value) END) AS start
FROM documents JOIN {_TRIPWIRES.sql} ON true) WHERE start > 0 GROUP BY doc_id""")
def tripwire_hits(spark, sf_dir):
    """The name of the first registered secret in each text; the plan holds no value."""
    return G.first_hit(documents(spark, sf_dir).select("doc_id", "text"), "text", _TRIPWIRES.frame(spark), "name").filter("name IS NOT NULL").select("doc_id", "name")


BLOBS = Fixture("id int, body string", (1, "plain s3cr3t-value here"), (2, "blob czNjcjN0LXZhbHVl end"), (3, "xxx" + "eHhzM2NyM3QtdmFsdWU"), (4, "YXMzY3IzdC12YWx1ZQ"), (5, "nothing"), (6, None)).over("documents", "doc_id", text="text", into="body")


def _needles_sql() -> str:
    return " OR ".join(f"contains(body, '{n}')" for n in G.base64_needles("s3cr3t-value"))


@query(f"SELECT id, contains(body, 's3cr3t-value') AS exact, {_needles_sql()} AS encoded FROM {BLOBS.sql}")
def tripwire_base64(spark, sf_dir):
    body = F.col("body")
    return BLOBS.frame(spark, sf_dir).select("id", body.contains("s3cr3t-value").alias("exact"), G.contains_any(body, G.base64_needles("s3cr3t-value")).alias("encoded"))


#: Names and values, and the reason and operator written by hand.
CANDIDATE_ROWS = [
    ("DB_PASSWORD", "hunter2", "name_match", "redact"), ("AUTH_MODE", "oauth", "enum_like", None), ("API_KEY", "", "empty", None), ("DEBUG", "true", "boolean_like", None), ("PORT", "5432", "integer_like", None),
    ("APP_SECRET", "aB3$kL9!mN2@pQ5^", "both", "hash"), ("HOME", "/usr/local/bin", "low_entropy", None), ("X", "abc1", "too_short", None), ("NAME", "aaaaaaaaaaaa", "low_entropy", None),
    ("TOKEN", "0123456789abcdefghijklmnopqrstuv", "both", "hash"), ("RANDOM", "k3J9x2Lq8Zv1", "entropy", "redact"), ("password", "abcdefgh", "name_match", "redact"), ("FLAG", " Enabled ", "boolean_like", None),
    ("SIGNING_KEY", "aaaaaaaa1", "name_match", "redact"), ("DB_DSN", "aaaaaaaa1", "name_match", "redact"), ("BEARER", "aaaaaaaa1", "name_match", "redact"), ("PRIVATE", "aaaaaaaa1", "name_match", "redact"),
]
CANDIDATES = Fixture("name string, value string, reason string, operator string", *CANDIDATE_ROWS).over("clients", "client_id")


@query(f"SELECT * FROM {CANDIDATES.sql}")
def classify_secret(spark, sf_dir):
    reason, operator = G.classified(F.col("name"), F.col("value"))
    return CANDIDATES.frame(spark, sf_dir).select("id", "name", "value", reason.alias("reason"), operator.alias("operator"))


REFS = Fixture("id int, ref string", (1, "env:DB_PASSWORD"), (2, "dotenv:.env#API_KEY"), (3, "pass:work/db#user"), (4, "sops:secrets.yaml#a.b"), (5, "plain"), (6, "age:x.age"), (7, ":x")).over("clients", "client_id")


@query(f"SELECT id, nullif(regexp_extract(ref, '^([a-z]+):([^#]+)(?:#(.+))?$', 1), '') AS scheme, nullif(regexp_extract(ref, '^([a-z]+):([^#]+)(?:#(.+))?$', 2), '') AS path, nullif(regexp_extract(ref, '^([a-z]+):([^#]+)(?:#(.+))?$', 3), '') AS field FROM {REFS.sql}")
def secret_ref_parse(spark, sf_dir):
    return REFS.frame(spark, sf_dir).select("id", *[p.alias(n) for p, n in zip(G.parsed_ref(F.col("ref")), ("scheme", "path", "field"), strict=True)])


OUTPUTS = Fixture("id int, form string, field string, body string", (1, "first_line", None, "s3cret\nuser: ada\n"), (2, "key_value", "User", "s3cret\nuser: ada\nurl: x"), (3, "json", "a.b", '{"a": {"b": "deep"}}'), (4, "trim", None, "value\n"), (5, "dotenv", "KEY", "A=1\nKEY=two\n"), (6, "key_value", "none", "x")).over("clients", "client_id")


@query(f"""SELECT id, CASE form WHEN 'first_line' THEN split_part(body, chr(10), 1) WHEN 'key_value' THEN nullif(regexp_extract(body, '(?im)^' || field || ':[ \\t]*(.*)$', 1), '')
WHEN 'json' THEN CASE WHEN json_valid(body) THEN json_extract_string(body, '$.' || field) END WHEN 'dotenv' THEN nullif(regexp_extract(body, '(?m)^' || field || '=(.*)$', 1), '') ELSE rtrim(body, chr(10)) END AS value FROM {OUTPUTS.sql}""")
def secret_field(spark, sf_dir):
    return OUTPUTS.frame(spark, sf_dir).select("id", G.field_of(F.col("form"), F.col("field"), F.col("body")).alias("value"))


NEEDLES = ("alpha beta", "alpha")
SCRUB = Fixture("id int, text string", (1, "alpha beta alpha"), (2, "alphabet"), (3, "none"), (4, None), (5, 'say "alpha beta"')).over("documents", "doc_id", text="text", into="text")


@query(f"SELECT id, replace(replace(text, 'alpha beta', '[R]'), 'alpha', '[R]') AS text, (length(text) - length(replace(text, 'alpha beta', ''))) // 10 + (length(replace(text, 'alpha beta', '[R]')) - length(replace(replace(text, 'alpha beta', '[R]'), 'alpha', ''))) // 5 AS hits FROM {SCRUB.sql}")
def scrub_counts(spark, sf_dir):
    text, hits = G.scrubbed(F.col("text"), NEEDLES, "[R]")
    return SCRUB.frame(spark, sf_dir).select("id", text.alias("text"), hits.alias("hits"))


#: Values of the ledger's pairs: one is a part of the other, one is written otherwise inside a JSON string.
PAIRS = Fixture("value string, handle string", ("the", "[B]"), ("on the", "[A]"), ('x "y"', "[C]"))
_BODY = """'{"t":' || to_json('x "y" ' || text)::VARCHAR || '}'"""


@query(f"SELECT conv_id, turn, replace(replace(replace({_BODY}, 'x \\\"y\\\"', '[C]'), 'on the', '[A]'), 'the', '[B]') AS body FROM conversations WHERE text IS NOT NULL".replace('\\\\"', '\\"'))
def redact_values(spark, sf_dir):
    """Value and handle pairs in a JSON body, the longest value first, also as it is written inside a string."""
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    body = F.to_json(F.struct(F.concat(F.lit('x "y" '), "text").alias("t")))
    return G.redacted(rows.select("conv_id", "turn", body.alias("body")), "body", PAIRS.frame(spark), json_body=True)


@query("SELECT page_id, regexp_replace(url, '(://)[^/@]*@', '\\1***@') AS url FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, '://', '://user:pw@') ELSE url END AS url FROM pages)")
def redact_userinfo(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("url", F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("://"), F.lit("://user:pw@"))).otherwise(F.col("url")))
    return pages.select("page_id", G.without_userinfo(F.col("url")).alias("url"))


HEADER_NAMES = Fixture("name string", *[(n,) for n in ("Authorization", "X-Api-Key", "x-idempotency-key", "Cookie", "X-Amz-Security-Token", "Content-Type", "x-goog-signature", "Host", "Set-Cookie")]).over("clicks", "click_id")


@query(f"SELECT id, name, regexp_matches(lower(name), '{'|'.join(G.AUTH_WORDS)}') AS auth FROM {HEADER_NAMES.sql}")
def auth_header(spark, sf_dir):
    return HEADER_NAMES.frame(spark, sf_dir).select("id", "name", F.lower("name").rlike("|".join(G.AUTH_WORDS)).alias("auth"))


PATHS = Fixture("id int, path string", (1, "/s/abc%20d/v1/messages"), (2, "/s/x/../y"), (3, "/v1/messages"), (4, "/s/%zz/v1"), (5, "/s/a+b/v1/messages/batches"), (6, "/s/ok/v1/messages?x=1")).over("pages", "page_id")
_RAW = "regexp_extract(path, '^/s/([^/]+)/', 1)"


@query(f"""SELECT id, CASE WHEN regexp_matches(path, '(^|/)[.][.](/|$)') OR regexp_matches({_RAW}, '%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|$)') THEN NULL ELSE nullif(url_decode({_RAW}), '') END AS session,
regexp_matches(path, '/messages/batches(/|[?]|$)') AS batches FROM {PATHS.sql}""")
def session_path(spark, sf_dir):
    return PATHS.frame(spark, sf_dir).select("id", G.session_of(F.col("path")).alias("session"), F.col("path").rlike("/messages/batches(/|[?]|$)").alias("batches"))

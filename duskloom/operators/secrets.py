"""Registered secrets, tripwires, the eligibility classifier, scrubbing and header checks.

Values are literals of expressions here; callers whose plans are shown to others pass digests or a table instead.
"""

from __future__ import annotations

import base64
import os
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as T

# Fixed values.
BOOLEANS = ("true", "false", "yes", "no", "on", "off", "1", "0", "enabled", "disabled")
SECRET_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "credential", "dsn", "private", "auth", "bearer")
AUTH_WORDS = ("auth", "token", "secret", "credential", "cookie", "bearer", "password", "passwd", "signature", "hmac", "api-key", "apikey", "api_key", "access-key", "x-amz-security")
SHORTEST, RANDOM, VERY_RANDOM = 8, 3.5, 4.0


def slug_collisions(names: DataFrame) -> DataFrame:
    """Slugs that more than one registered name gives: the registration is refused."""
    rows = names.groupBy(T.slug(F.col("name")).alias("slug")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return rows.filter("n > 1")


#: Bytes of literals, names included, up to which their table is broadcast; a larger one is cut in parts of that size, each read by all texts.
LITERALS_BYTES = 64 << 20


class _Machines:
    """An automaton for each kind of letter case over (name, value, case_sensitive) rows. Letters that change their length in lower case
    stay as they are, so that places are those of the text."""

    def __init__(self, rows: list[tuple[str, str, bool]]):
        self.machines = []
        for sensitive in (True, False):
            names: dict[str, list[str]] = {}
            for name, value, case in rows:
                if value and bool(case) == sensitive:
                    names.setdefault(value if sensitive else self.lower(value), []).append(name)
            machine = ahocorasick.Automaton()
            for word, own in names.items():
                machine.add_word(word, (len(word), sorted(own)))
            if names:
                machine.make_automaton()
                self.machines.append((sensitive, machine))

    @staticmethod
    def lower(text: str) -> str:
        low = text.lower()
        return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)

    def find(self, text: str | None) -> list[dict]:
        found = [{"name": name, "start": end + 1 - n, "end": end + 1} for sensitive, machine in self.machines for end, (n, names) in machine.iter(text if sensitive else self.lower(text)) for name in names] if text else []
        return sorted(found, key=lambda x: (x["start"], -x["end"], x["name"]))


def literal_hits(texts: DataFrame, text: str, literals: DataFrame, name: str = "hits") -> DataFrame:
    """texts with every occurrence of every literal, overlapping ones too, as array<struct<name,start,end>> in order; null and empty texts have none.

    literals (name, value, case_sensitive): a table of any number of rows; null and empty values match nothing. Each text is read once by one
    automaton for each kind of letter case, whatever the number of literals. Their size is summed first: up to LITERALS_BYTES they are broadcast;
    of more, the values are dealt by hash into parts of that size, and each text is read once for each part.
    """
    spark = texts.sparkSession
    rows = literals.select("name", "value", F.coalesce("case_sensitive", F.lit(True)).alias("case_sensitive")).filter("value <> ''").distinct()
    size = rows.agg(F.sum(F.octet_length("value") + F.octet_length("name") + 32)).first()[0] or 0
    kind = "array<struct<name:string,start:int,end:int>>"
    parts = []
    for part in range(-(-size // LITERALS_BYTES) or 1):
        own = rows if size <= LITERALS_BYTES else rows.filter(F.pmod(F.xxhash64("value"), F.lit(-(-size // LITERALS_BYTES))) == part)
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # of a size that was summed

        def reader(sent=sent):
            state: list[_Machines] = []

            @F.pandas_udf(kind)
            def run(values: pd.Series) -> pd.Series:
                if not state:
                    state.append(_Machines(sent.value))
                return values.map(lambda v: state[0].find(v))

            return run

        parts.append(reader()(F.col(text)))
    return texts.withColumn(name, F.array_sort(F.concat(*parts)) if len(parts) > 1 else parts[0])


def hit_spans(hits: Column) -> Column:
    """Hits as spans that no gate drops; names that hit one place keep their order."""
    return F.transform(hits, lambda h, i: S.span(h["start"], h["end"], h["name"], 1.0, "secret", F.lit(None).cast("string"), order=i))


def json_forms(pairs: DataFrame) -> DataFrame:
    """(value, handle) with a row more for each value that is written otherwise inside a JSON string."""
    escaped = pairs.withColumn("value", F.regexp_extract(F.to_json(F.array("value")), r'(?s)^\["(.*)"\]$', 1))
    return pairs.union(escaped.select(pairs.columns)).distinct()


def redacted(texts: DataFrame, text: str, pairs: DataFrame, json_body: bool = False) -> DataFrame:
    """texts with each value of pairs (value, handle) replaced by its handle; of values that overlap, the longest stays whole, of equal ones
    the first. In a JSON body, values are also looked for as they are written inside its strings."""
    rows = json_forms(pairs.select("value", "handle")) if json_body else pairs.select("value", "handle")
    found = literal_hits(texts, text, rows.select(F.col("handle").alias("name"), "value", F.lit(True).alias("case_sensitive")), "__hits")
    own = F.transform(F.col("__hits"), lambda h: F.struct((h["start"] - h["end"]).alias("l"), h["start"].alias("start"), h["end"].alias("end"), h["name"].alias("entity")))
    spans = F.transform(own, lambda h: S.span(h["start"], h["end"], h["entity"], 1.0, "secret", F.lit("")))
    return found.withColumn(text, S.splice(F.col(text), S.resolve(spans), lambda x: x["entity"])).drop("__hits")


def first_hit(texts: DataFrame, text: str, literals: DataFrame, name: str = "hit") -> DataFrame:
    """texts with the name of the secret that stands first in the text, of those at one place the least; else null."""
    first = F.array_min(F.transform("__hits", lambda h: F.struct(h["start"].alias("s"), h["name"].alias("n"))))
    return literal_hits(texts, text, literals, "__hits").withColumn(name, first["n"]).drop("__hits")


def base64_needles(value: str) -> list[str]:
    """What every base64 text of bytes with the value in them holds: one stretch for each of three alignments, uncertain edges cut."""
    raw, found = value.encode(), []
    for shift in range(3):
        coded = base64.b64encode(b"\0" * shift + raw).decode().rstrip("=")
        first = (0, 2, 3)[shift]
        whole = (len(raw) + shift) * 8 // 6
        found.append(coded[first:whole])
    return found


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def classified(name: Column, value: Column) -> tuple[Column, Column]:
    """Why a value is or isn't fit to be registered as a secret, and with which operator."""
    bits, n = T.entropy(value), F.length(value)
    skip = F.when(value == "", "empty").when(F.lower(F.trim(value)).isin(*BOOLEANS), "boolean_like").when(F.trim(value).rlike("^[0-9]+$"), "integer_like").when((n < SHORTEST) & value.rlike("^[A-Za-z]+$"), "enum_like")
    named, random = reduce(lambda a, b: a | b, [F.lower(name).contains(w) for w in SECRET_WORDS]), (n >= SHORTEST) & (bits >= RANDOM)
    reason = F.coalesce(skip, F.when(named & random, "both").when(named, "name_match").when(random, "entropy").when(n < SHORTEST, "too_short").otherwise("low_entropy"))
    return reason, F.when(skip.isNull() & (named | random), F.when(bits >= VERY_RANDOM, "hash").otherwise("redact"))


def parsed_ref(ref: Column) -> tuple[Column, Column, Column]:
    """scheme, path and field of scheme:path#field; nulls where a part is absent."""
    pattern = "^([a-z]+):([^#]+)(?:#(.+))?$"
    return tuple(F.nullif(F.regexp_extract(ref, pattern, i), F.lit("")) for i in (1, 2, 3))


def field_of(form: Column, field: Column, body: Column) -> Column:
    """The secret in a provider's output: its first line, a 'key: value' line, a JSON path, a dotenv key, or the text without its last line feed."""
    line = lambda flags, sep: F.nullif(F.call_function("regexp_extract", body, F.concat(F.lit(f"({flags})^"), field, F.lit(sep)), F.lit(1)), F.lit(""))
    return (
        F.when(form == "first_line", F.split_part(body, F.lit("\n"), F.lit(1))).when(form == "key_value", line("?im", ":[ \t]*(.*)$"))
        .when(form == "json", F.call_function("get_json_object", body, F.concat(F.lit("$."), field))).when(form == "dotenv", line("?m", "=(.*)$"))
        .otherwise(F.regexp_replace(body, "\n+$", ""))
    )


def resolve(ref: str) -> str | None:
    """The value behind env:NAME or dotenv:path#NAME, on the driver; other schemes need their tools and aren't available."""
    scheme, _, rest = ref.partition(":")
    if scheme == "env":
        return os.environ.get(rest)
    if scheme == "dotenv":
        path, _, name = rest.partition("#")
        with open(path, encoding="utf-8") as file:
            pairs = [line.rstrip("\n").removeprefix("export ").partition("=") for line in file if "=" in line and not line.lstrip().startswith("#")]
        return next((v.strip().strip("\"'") for k, _, v in pairs if k.strip() == name), None)
    raise ValueError(f"no provider for {scheme}")


def replaced(text: Column, pairs: dict[str, str]) -> Column:
    for value in sorted(pairs, key=lambda v: (-len(v), v)):
        text = F.replace(text, F.lit(value), F.lit(pairs[value]))
    return text


def scrubbed(text: Column, needles: tuple[str, ...], mark: str) -> tuple[Column, Column]:
    """The text with every needle replaced in turn, and how many places that were."""
    hits = F.lit(0).cast("long")
    for needle in needles:
        hits = hits + ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")
        text = F.replace(text, F.lit(needle), F.lit(mark))
    return text, hits


def without_userinfo(url: Column) -> Column:
    return F.regexp_replace(url, "(://)[^/@]*@", "$1***@")


def session_of(path: Column) -> Column:
    """The decoded name in /s/<name>/...; null for another path, one that climbs up, or a wrong encoding."""
    raw = F.regexp_extract(path, "^/s/([^/]+)/", 1)
    bad = path.rlike("(^|/)[.][.](/|$)") | raw.rlike("%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|$)")
    return F.when(~bad, F.nullif(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), F.lit("")))

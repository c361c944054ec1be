"""Restoring tokens: a scan of the text, a lookup join, and a policy by context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let
from ..plans.policy import CATEGORIES

#: The grammar of tokens (fixed): no more than 63 characters.
TOKEN = r"\[[A-Z0-9_]+_[0-9a-f]{12}\]"
MARKER = ("⟪", "⟫")


def tokens_in(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) <= 63)


def label_of(token: Column) -> Column:
    """The entity a token names; null for another text."""
    found = F.regexp_extract(token, r"^\[([A-Z0-9_]+)_[0-9a-f]{12}\]$", 1)
    return F.when(found != "", found)


def restore_policy(entity: Column) -> Column:
    """How a tool's input may get the value back: embedded in a text, as a whole value only, or not at all (any other label)."""
    return F.when(entity.isin("URL", "DOMAIN", "IP_ADDRESS"), "embedded").when(entity.isin("MAC_ADDRESS", *CATEGORIES["personal"]), "whole_value").otherwise("gated")


def whole_value(before: Column, after: Column, raw_json: bool) -> Column:
    """How the token between before and after is a whole value: 'bare' (only white space around it), on raw JSON also 'quoted' (an
    unescaped quote on its left, a quote on its right, and no key); else null."""
    bare = F.trim(F.regexp_replace(F.concat(before, after), r"\s+", "")) == ""
    if not raw_json:
        return F.when(bare, "bare")
    slashes = F.length(F.regexp_extract(before, r'(\\*)"$', 1))
    quoted = before.endswith('"') & (slashes % 2 == 0) & after.startswith('"') & ~after.rlike(r'^"[ \t\r\n]*:')
    return F.when(bare, "bare").when(quoted, "quoted")


def pieces(text: Column) -> Column:
    """The text as array<struct<text,token>>: what stands before each token, and the token; the last piece has none."""
    gaps, found = F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return let(F.struct(gaps.alias("g"), found.alias("f")), lambda b: F.transform(F.sequence(F.lit(0), F.size(b["g"]) - 1), lambda i: F.struct(b["g"][i].alias("text"), F.get(b["f"], i).alias("token"))))


def json_escaped(value: Column) -> Column:
    """The value as it is written inside a JSON string."""
    return F.regexp_extract(F.to_json(F.array(value)), r'(?s)^\["(.*)"\]$', 1)


def restored(text: Column, values: Column) -> Column:
    """The text with each token that values (map<token,value>) knows replaced by its value; other tokens stay."""
    shown = F.transform(pieces(text), lambda p: F.concat(p["text"], F.coalesce(F.element_at(values, p["token"]), p["token"], F.lit(""))))
    return F.when(values.isNull(), text).otherwise(F.array_join(shown, ""))


#: Stand for an escaped backslash and an escaped quote while raw JSON is cut at its quotes: characters that no text may hold.
_BACKSLASH, _QUOTE = "\uFDD0", "\uFDD1"


def restored_raw_json(text: Column, values: Column) -> Column:
    """Raw JSON text with the tokens of values (map<token,value>, values as they stand in a JSON string) replaced where the policy lets
    them: request targets anywhere, others only as a whole string that is no key, or where the token is all there is. A text with one of
    the two characters that mark escapes gets request targets alone."""
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    anywhere = F.map_filter(values, lambda token, _: restore_policy(label_of(token)) == "embedded")

    def shown(b: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            """Parts between quotes: every second one is in a string."""
            after = F.get(b["parts"], i + 1)
            lone = (i % 2 == 1) & after.isNotNull() & ~after.rlike(r"^\s*:") & F.map_contains_key(b["values"], p)
            return F.when(lone, F.element_at(b["values"], p)).otherwise(restored(p, b["anywhere"]))

        whole = F.array_join(F.transform(b["parts"], part), '"')
        return F.replace(F.replace(whole, F.lit(_BACKSLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))

    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = let(F.struct(F.split(marked, '"', -1).alias("parts"), values.alias("values"), anywhere.alias("anywhere")), shown)
    return (
        F.when(values.isNull(), text).when(F.map_contains_key(values, bare), F.replace(text, bare, F.element_at(values, bare)))
        .when(text.rlike(f"[{_BACKSLASH}{_QUOTE}]"), restored(text, anywhere)).otherwise(inner)
    )


def unmasked_raw_json(texts: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """A tool's input as raw JSON text, restored by policy; see restored_raw_json."""
    return unmasked(texts, column, values, allowed=restore_policy(label_of(F.col("token"))) != "gated", escape=True, restore=restored_raw_json)


def unmasked_leaves(texts: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """A decoded leaf of a tool's input: a quote in it is text, so only a token that is all of the leaf is a whole value."""
    policy = restore_policy(label_of(F.col("token")))
    return unmasked(texts, column, values, allowed=(policy == "embedded") | ((policy == "whole_value") & (F.trim(F.regexp_replace("_whole", r"^\s+|\s+$", "")) == F.col("token"))))


def unmasked(texts: DataFrame, column: str, values: DataFrame, marker: tuple[str, str] | None = None, allowed: Column | None = None, escape: bool = False, restore=restored) -> DataFrame:
    """texts with column's tokens replaced by the value of values (token, value), one row a token; unknown tokens stay as they are.

    What a text becomes depends on the text alone, so values are gathered for each distinct text, under its digest: rows that repeat
    a text, or a key, or have no key, are restored alike, and nothing of one text can reach another. Only texts with a token move.
    allowed: a condition on the columns token and _whole (the text) under which a token may be replaced. marker: what is put around
    a value. escape: values are written into a JSON body. restore(text, map<token,value>) -> text. Null and empty texts stay; other columns are kept, whatever their names.
    """
    own = texts[column]
    digest = F.sha2(F.col("_whole"), 256).alias("_digest")
    has = F.coalesce(own.rlike(TOKEN), F.lit(False))
    asked = texts.filter(has).select(own.alias("_whole")).select("_whole", digest, F.explode(F.array_distinct(tokens_in(F.col("_whole")))).alias("token"))
    asked = (asked.filter(allowed) if allowed is not None else asked).select("_digest", "token").distinct()
    value = F.col("value") if not escape else json_escaped(F.col("value"))
    value = value if marker is None else F.concat(F.lit(marker[0]), value, F.lit(marker[1]))
    known = asked.join(values.groupBy("token").agg(F.min("value").alias("value")).select("token", value.alias("value")), "token")
    gathered = known.groupBy("_digest").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_values"))
    rows = texts.filter(has).select(F.struct("*").alias("_row"), own.alias("_whole"))
    rows = rows.withColumn("_key", F.sha2("_whole", 256)).join(gathered, F.col("_key") == F.col("_digest"), "left")
    back = rows.select(F.col("_row").withField(f"`{column}`", restore(F.col("_whole"), F.col("_values"))).alias("_row")).select("_row.*")
    return texts.filter(~has).union(back)

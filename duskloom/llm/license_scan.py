"""Licence scans by ordered signature rules, in DataFrame functions alone.

A text is cut into its words once. The keywords among them select the rules whose regular expressions run, over the words with
a blank on either side of each; a text without any keyword runs none. A detection is suppressed when one of the
same or a higher priority that starts no later contains its interval.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_rules
from .common import ascii_lower

#: What lies between words (text with A-Z lower-cased).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases with the labels that always hold.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_BASE_PATTERN = " (?:" + "|".join(phrase.replace(" ", "  ") for phrase, _ in BASE) + ") "
_BASE_SCORE = 0.5
_SPAN = "struct<s:int,ne:int,t:int,l:string>"
_RULES = "array<struct<k:string,r:array<struct<p:string,t:int,l:string>>>>"


def words_of(text: Column) -> Column:
    """The words of the text, A-Z lower-cased; an empty string may stand first or last."""
    return F.split(ascii_lower(text), SEPARATORS)


def spaced(words: Column) -> Column:
    """' w1  w2 ' for words; '' without any."""
    bare = F.trim(F.array_join(words, "  "))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def n_words_in(spaced: Column) -> Column:
    """Words in a stretch of spaced words: half its blanks."""
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def _by_keyword() -> Column:
    groups: dict[str, list[dict]] = {}
    for rule in license_rules.rules():
        groups.setdefault(rule.keyword, []).append({"p": license_rules.spaced(rule.pattern), "t": rule.priority, "l": rule.label})
    return F.from_json(F.lit(json.dumps([{"k": k, "r": v} for k, v in groups.items()])), _RULES)


def _detections(spaced: Column, rule: Column) -> Column:
    """The rule's detections: first word, minus the word after the last, priority, label."""
    found, gaps = F.regexp_extract_all(spaced, rule["p"], F.lit(0)), F.split(spaced, rule["p"], -1)

    def step(s: Column, i: Column) -> Column:
        start = s["at"] + n_words_in(gaps[i])
        end = start + n_words_in(found[i])
        span = F.struct(start.alias("s"), (-end).alias("ne"), rule["t"].alias("t"), rule["l"].alias("l"))
        return F.struct(end.alias("at"), F.array_append(s["out"], span).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda s: s["out"])


def detections(spaced: Column, keys: Column) -> Column:
    """All detections of the rules with one of these keywords in text order, longer before shorter, then by priority, as array<struct<s,ne,t,l>>."""
    groups = F.filter(_by_keyword(), lambda g: F.array_contains(keys, g["k"]))
    tried = F.filter(F.flatten(F.transform(groups, lambda g: g["r"])), lambda r: F.rlike(spaced, r["p"]))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tried, lambda r: _detections(spaced, r)))))


def kept_detections(found: Column) -> Column:
    """Those that no detection before them of the same or a higher priority contains. Linear in their number."""
    tiers = sorted(license_rules.CONFIDENCE)

    def step(s: Column, d: Column) -> Column:
        covered = reduce(lambda a, b: a | b, [(F.lit(t) <= d["t"]) & (s[f"e{t}"] >= -d["ne"]) for t in tiers])
        ends = [F.when((d["t"] == t) & (s[f"e{t}"] < -d["ne"]), -d["ne"]).otherwise(s[f"e{t}"]).alias(f"e{t}") for t in tiers]
        return F.struct(*ends, F.when(covered, s["out"]).otherwise(F.array_append(s["out"], d)).alias("out"))

    start = F.struct(*[F.lit(-1).alias(f"e{t}") for t in tiers], F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(found, start, step, lambda s: s["out"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, base_found (array<string>), found: the kept detections
    as array<struct<start,end,priority,label>> in words from 0, end exclusive.

    One row per row of docs (doc_id, text). Null and empty texts have no words and no detections; rows that repeat are
    scanned alike; a detection that several rules of one label and priority give counts once. Other columns aren't read.
    """
    keywords = F.lit(sorted({r.keyword for r in license_rules.rules()} | {"license"}))
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  a lambda works out anew for every element what it takes from outside
    edges = lambda w: (F.get(w, F.lit(0)) == "").cast("int") + ((F.element_at(w, -1) == "") & (F.size(w) > 1)).cast("int")

    def looked_at(words: Column) -> Column:
        keys = F.array_intersect(words, keywords)
        return once(F.struct(words.alias("w"), keys.alias("keys")), lambda b: F.struct((F.size(b["w"]) - edges(b["w"])).cast("long").alias("n"), b["keys"].alias("keys"), F.when(F.size(b["keys"]) > 0, spaced(b["w"])).otherwise(F.lit("")).alias("s")))

    def scanned(b: Column) -> Column:
        base = F.when(F.array_contains(b["keys"], "license"), F.regexp_extract_all(b["s"], F.lit(_BASE_PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
        kept = F.when(F.size(b["keys"]) > 0, kept_detections(detections(b["s"], b["keys"]))).otherwise(F.array().cast(f"array<{_SPAN}>"))
        return F.struct(b["n"].alias("n_words"), b["s"].alias("w"), base.alias("base"), kept.alias("kept"))

    gaps = F.split("w", _BASE_PATTERN, -1)
    out = docs.select("doc_id", once(once(words_of(F.col("text")), looked_at), scanned).alias("x")).select("doc_id", "x.*")
    some = F.size("base") > 0
    last = F.col("n_words") - n_words_in(F.element_at(gaps, -1)) - n_words_in(F.element_at("base", -1))
    labels = F.array_sort(F.array_compact(F.array(*[F.when(F.array_contains("base", f" {phrase.replace(' ', '  ')} "), label) for phrase, label in BASE])))
    found = F.transform("kept", lambda d: F.struct(d["s"].alias("start"), (-d["ne"]).alias("end"), d["t"].alias("priority"), d["l"].alias("label")))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.when(some, n_words_in(gaps[0])).cast("long").alias("first_word"), F.when(some, last).cast("long").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"), labels.alias("base_found"), found.alias("found"),
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found.

    labels: base labels and those of the kept detections, distinct, sorted and joined by commas. score: the confidence of
    the surest kept detection, 0.5 for base phrases alone, 0 for none.
    """
    rows = scan_licenses(docs)
    own = F.transform("found", lambda d: d["label"])
    sure = F.array_max(F.transform("found", lambda d: F.coalesce(*[F.when(d["priority"] == t, F.lit(c)) for t, c in license_rules.CONFIDENCE.items()])))
    score = F.greatest(F.coalesce(sure, F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(_BASE_SCORE)).otherwise(0.0))
    labels = F.array_join(F.array_sort(F.array_union("base_found", own)), ",")
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"), F.size("found").cast("long").alias("n_found"))


def _oracle() -> str:
    values = ",\n    ".join(f"(' {r.keyword} ', '{license_rules.spaced(r.pattern)}', {r.priority}, '{r.label}')" for r in license_rules.rules())
    n = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    base = ", ".join(f"CASE WHEN list_contains(base, ' {phrase.replace(' ', '  ')} ') THEN '{label}' END" for phrase, label in BASE)
    sure = " ".join(f"WHEN {t} THEN {c}" for t, c in license_rules.CONFIDENCE.items())
    return f"""
WITH rules(k, p, t, l) AS (VALUES
    {values}
),
bare AS (
  SELECT doc_id, row_number() OVER () AS row_no, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}', '  ', 'g'), ' ') AS b
  FROM documents
),
words AS (SELECT doc_id, row_no, CASE WHEN b = '' THEN '' ELSE ' ' || b || ' ' END AS w FROM bare),
based AS (
  SELECT *, {n.format("w")} AS n_words, regexp_extract_all(w, '{_BASE_PATTERN}') AS base, string_split_regex(w, '{_BASE_PATTERN}') AS gaps FROM words
),
hits AS (
  SELECT row_no, t, l, regexp_extract_all(w, p) AS m, string_split_regex(w, p) AS g
  FROM words JOIN rules ON contains(w, k) AND regexp_matches(w, p)
),
placed AS (
  SELECT DISTINCT t, l, row_no,
    list_sum(list_transform(g[1:i], lambda x: {n.format("x")})) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {n.format("x")})), 0) AS s,
    list_sum(list_transform(g[1:i], lambda x: {n.format("x")})) + list_sum(list_transform(m[1:i], lambda x: {n.format("x")})) AS e
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits)
),
kept AS (
  SELECT * FROM placed d WHERE NOT EXISTS (
    SELECT 1 FROM placed o WHERE o.row_no = d.row_no AND o.t <= d.t AND o.s <= d.s AND o.e >= d.e AND (o.s, -o.e, o.t, o.l) < (d.s, -d.e, d.t, d.l))
),
own AS (SELECT row_no, list(DISTINCT l) AS labels, count(*) AS n_found, max(CASE t {sure} END)::DOUBLE AS sure FROM kept GROUP BY row_no)
SELECT doc_id, n_words, len(base) AS n_base,
  CASE WHEN len(base) > 0 THEN {n.format("gaps[1]")} END AS first_word,
  CASE WHEN len(base) > 0 THEN n_words - {n.format("gaps[-1]")} - {n.format("base[-1]")} END AS last_word,
  array_to_string(list_sort(list_filter([{base}], lambda x: x IS NOT NULL)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_filter([{base}], lambda x: x IS NOT NULL), coalesce(labels, [])))), ',') AS labels,
  greatest(coalesce(sure, 0), CASE WHEN len(base) > 0 THEN {_BASE_SCORE} ELSE 0 END)::DOUBLE AS score,
  coalesce(n_found, 0) AS n_found
FROM based LEFT JOIN own USING (row_no)
"""


ORACLE = _oracle()

"""Arbitrary JSON as leaves and back, in Arrow batches: depth and keys are only known from the data."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys whose values are part of a wire's contract and are never rewritten.
CONTRACT_KEYS: dict[str, tuple[str, ...]] = {
    "messages": ("model", "tool_choice", "thinking", "output_config", "format", "json_schema", "schema", "input_schema", "cache_control", "id", "tool_use_id", "signature", "data", "media_type", "type"),
    "chat": ("model", "tools", "tool_choice", "response_format", "json_schema", "schema", "input_schema", "parameters", "guided_regex", "guided_grammar", "guided_choice"),
    "responses": ("model", "tools", "tool_choice", "response_format", "text", "format", "json_schema", "schema", "input_schema", "parameters", "id", "item_id", "call_id", "file_id", "filename", "file_data", "image_file", "input_image", "encrypted_content", "signature"),
}
PROTOCOL_KEYS = ("type", "keep", "trigger", "clear_at_least", "clear_tool_inputs", "exclude_tools")

DEEPEST = 256


_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+|\s+', re.S)


class Leaf(NamedTuple):
    """A string value: its place among the tokens, path, nearest key, text, whether a contract key stands above it, and whether it is the data of
    a base64 source."""

    at: int
    path: str
    key: str | None
    text: str
    kept: bool
    binary: bool


def _leaves(tokens: list[str], skipped: frozenset[str]) -> Iterator[Leaf]:
    """String values in order. Every occurrence of a key that an object repeats has its own."""
    stack: list[list] = []  # kind, key or place, whether a key comes next, whether kept, whether in context management, whether base64
    binary = {}
    for at, token in enumerate(tokens):
        if token in "{[":
            if len(stack) >= DEEPEST:
                raise ValueError(f"JSON is nested deeper than {DEEPEST}")
            top = stack[-1] if stack else [None, None, False, False, False, at]
            key = top[1] if top[0] == "{" else None
            managed = top[4] or key == "context_management"
            stack.append([token, None if token == "{" else 0, token == "{", top[3] or key in skipped or (managed and key in PROTOCOL_KEYS), managed, at])
        elif token in "}]":
            stack.pop()
        elif token == ",":
            if stack[-1][0] == "{":
                stack[-1][2] = True
            else:
                stack[-1][1] += 1
        elif token[0] == '"':
            if stack and stack[-1][2]:
                stack[-1][1:3] = [json.loads(token), False]
                continue
            path = "$" + "".join(f".{x[1]}" if x[0] == "{" else f"[{x[1]}]" for x in stack)
            key = next((x[1] for x in reversed(stack) if x[0] == "{"), None)
            own = stack[-1] if stack else [None, None, False, False, False, -1]
            direct = own[1] if own[0] == "{" else None
            kept = own[3] or direct in skipped or (own[4] and direct in PROTOCOL_KEYS)
            text = json.loads(token)
            if direct == "type" and text == "base64":
                binary[own[5]] = True
            yield Leaf(at, path, key, text, kept, direct == "data" and own[5] in binary)


def _parsed(body: str | None, skipped: frozenset[str]) -> tuple[list[str], list[Leaf]] | None:
    """Tokens and string values of a JSON text; null for null, for what isn't JSON, and for what is nested deeper than DEEPEST."""
    try:
        if body is None:
            return None
        json.loads(body)
        tokens = _TOKENS.findall(body)
        return tokens, list(_leaves(tokens, skipped))
    except (ValueError, RecursionError):
        return None


LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("key", T.StringType()), T.StructField("text", T.StringType())]))


def problem(body: Column) -> Column:
    """Why a body has no leaves: 'not_json', 'too_deep', or null."""

    def one(text: str | None) -> str | None:
        if text is None or _parsed(text, frozenset()) is not None:
            return None
        try:
            json.loads(text)
        except RecursionError:
            return "too_deep"
        except ValueError:
            return "not_json"
        return "too_deep"

    @F.pandas_udf(T.StringType())
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(one)

    return run(body)


def _strings(body: Column, skipped: tuple[str, ...], wanted: Callable[[Leaf], bool]) -> Column:
    keys = frozenset(skipped)

    def one(text: str | None) -> list[dict] | None:
        parsed = _parsed(text, keys)
        return None if parsed is None else [{"path": x.path, "key": x.key, "text": x.text} for x in parsed[1] if wanted(x)]

    @F.pandas_udf(LEAVES)
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(one)

    return run(body)


def leaves(body: Column, skipped: tuple[str, ...] = CONTRACT_KEYS["messages"]) -> Column:
    """array<struct<path,key,text>> of every string leaf of a JSON text outside the skipped keys, in order; null for null, for what isn't
    JSON, and for what is nested deeper than DEEPEST (problem says which)."""
    return _strings(body, skipped, lambda x: not x.kept)


def carved_out(body: Column, skipped: tuple[str, ...] = CONTRACT_KEYS["messages"]) -> Column:
    """The string leaves that are never rewritten, but for base64 data: a registered secret in one of them has the request refused."""
    return _strings(body, skipped, lambda x: x.kept and not x.binary)


def keys_and_texts(body: Column) -> Column:
    """Every object key and string leaf, for scans that must not be dodged by a key; null as in leaves."""

    def one(text: str | None) -> list[str] | None:
        parsed = _parsed(text, frozenset())
        return None if parsed is None else [json.loads(t) for t in parsed[0] if t[0] == '"']

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(one)

    return run(body)


def _digest(kind: str, text: str) -> str:
    return hashlib.sha256(f"{kind}:{text}".encode("utf-8", "surrogatepass")).hexdigest()


def spliced(body: str, texts: dict[str, str], skipped: tuple[str, ...] = (), kind_of: Callable[[str], str] = lambda path: "") -> str | None:
    """The JSON text with string values replaced: texts gives new ones by the digest of a value's kind and text. All else, blanks and numbers too,
    stays as it was written. Null for what isn't JSON."""
    parsed = _parsed(body, frozenset(skipped))
    if parsed is None:
        return None
    tokens, found = parsed
    for x in found:
        if not x.kept and (new := texts.get(_digest(kind_of(x.path), x.text))) is not None:
            tokens[x.at] = json.dumps(new, ensure_ascii=False)
    return "".join(tokens)


def canonical(body: Column) -> Column:
    """The JSON text without blanks between its parts, else the text as it is."""

    def one(text: str | None) -> str | None:
        try:
            json.loads(text or "null")
        except ValueError:
            return text
        return None if text is None else "".join(t for t in _TOKENS.findall(text) if not t.isspace())

    @F.pandas_udf(T.StringType())
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(one)

    return run(body)


def with_leaves_changed(rows: DataFrame, body: str, change: Callable[[DataFrame], DataFrame], skipped: tuple[str, ...] = CONTRACT_KEYS["messages"], kind_of: Callable[[str], str] = lambda path: "") -> DataFrame:
    """rows with the string leaves of body outside the skipped keys replaced by what change makes of them.

    change: distinct (kind, text) -> (kind, text, changed), any DataFrame work; kind_of gives a leaf's kind by its path, null leaves it alone. What a
    leaf becomes depends on its kind and text alone, so new texts are gathered for each distinct body under its digest: rows without
    a key or with the same one, paths that read alike, and keys that repeat in an object are all kept apart. A body that is no JSON,
    or nested too deep, can't be changed and becomes null (problem says why), never passed on as it is. Null stays null; other columns are kept.
    """
    own, kinds, keys = rows[body], kind_of, tuple(skipped)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])))
    def found(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: [{"kind": kinds(x.path), "text": x.text} for x in (_parsed(b, frozenset(keys)) or ([], []))[1] if not x.kept and kinds(x.path) is not None])

    @F.pandas_udf(T.StringType())
    def put(bodies: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else spliced(b, dict(m) if m else {}, keys, lambda path: "-" if kinds(path) is None else kinds(path)) for b, m in zip(bodies, maps, strict=True)], dtype=object)

    digest = F.sha2(own, 256)
    pairs = rows.filter(own.isNotNull()).select(digest.alias("_body"), F.explode(found(own)).alias("l")).select("_body", "l.kind", "l.text").distinct()
    changed = change(pairs.select("kind", "text").distinct()).filter(~F.col("text").eqNullSafe(F.col("changed")))
    name = F.sha2(F.concat(F.col("kind"), F.lit(":"), F.col("text")), 256)
    known = pairs.select("_body", name.alias("_leaf")).join(changed.select(name.alias("_leaf"), "changed"), "_leaf")
    maps = known.groupBy("_body").agg(F.map_from_entries(F.collect_list(F.struct("_leaf", "changed"))).alias("_texts"))
    kept = rows.select(F.struct("*").alias("_row"), own.alias("_own"), digest.alias("_digest"))
    joined = kept.join(maps, F.col("_digest") == F.col("_body"), "left")
    return joined.select(F.col("_row").withField(f"`{body}`", put("_own", "_texts")).alias("_row")).select("_row.*")

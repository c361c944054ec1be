"""Pieces of DuckDB SQL that the queries' oracles are made of."""

from __future__ import annotations

from ..functions.patterns import GOES_ON


def spans_sql(source: str, key: str, text: str, pattern: str, groups: bool = True) -> str:
    """SELECT key, start, stop, value, before: a row for each match of pattern in text."""
    p = pattern.replace("'", "''")
    value = f"regexp_extract_all(t, '{p}', 2)" if groups else f"regexp_extract_all(t, '{p}')"
    before = f"length(regexp_extract_all(t, '{p}', 1)[i])" if groups else "0"
    base = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT {key}, ({base} + {before})::INT AS start, ({base} + {before} + length(v[i]))::INT AS stop, v[i] AS value, t
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT {key}, {text} AS t, regexp_extract_all({text}, '{p}') AS m, string_split_regex({text}, '{p}') AS g, {value.replace("(t,", f"({text},")} AS v
    FROM {source} WHERE regexp_matches({text}, '{p}')))"""


def luhn_sql(digits: str) -> str:
    """Whether a string of digits passes the Luhn check and isn't one digit repeated."""
    d = f"substr(reverse({digits}), k, 1)::INT"
    return f"(list_sum(list_transform(range(1, length({digits}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)) % 10 = 0 AND NOT regexp_matches({digits}, '^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$'))"


def entropy_sql(text: str) -> str:
    share = f"((length({text}) - length(replace({text}, c, ''))) / length({text}))"
    return f"CASE WHEN length({text}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({text}, '')), lambda c: -{share} * log2({share}))) END"


def token_sql(salt: str, entity: str, value: str) -> str:
    return f"('[' || {entity} || '_' || sha256('{salt}' || {entity} || ':' || {value})[1:12] || ']')"


def plausible_sql(v: str) -> str:
    vowels = f"(CASE WHEN length(regexp_replace({v}, '[^A-Za-z]', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace({v}, '[^AEIOUaeiou]', '', 'g')) / length(regexp_replace({v}, '[^A-Za-z]', '', 'g')) END)"
    run = f"coalesce(list_max(list_transform(regexp_extract_all({v}, '[a-z]+'), lambda x: length(x))), 0)"
    return f"(NOT regexp_matches({v}, '^[0-9A-Fa-f]+$') AND {entropy_sql(v)} >= 4.0 AND regexp_matches({v}, '[A-Za-z]') AND regexp_matches({v}, '[0-9]') AND NOT ({vowels} >= 0.30 AND {run} >= 6))"


def digits_sql(value: str = "value") -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


def weights_sql(digits: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"substr({digits}, {i + 1}, 1)::INT * {w}" for i, w in enumerate(weights)) + ")"


_MOVED = "array_to_string(list_transform(string_split(substr(value, 5) || substr(value, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '')"

#: entity -> the check of a value with its shape. One string in 2^32 passes that of CRYPTO by chance: none is taken to.
CHECKS = {
    "CREDIT_CARD": f"length({digits_sql()}) BETWEEN 13 AND 19 AND {luhn_sql(digits_sql())}",
    "PHONE_NUMBER": f"length({digits_sql()}) BETWEEN 10 AND 13",
    "IP_ADDRESS": "CASE WHEN contains(value, '.') THEN len(list_filter(string_split(value, '.'), lambda o: try_cast(o AS INT) > 255)) = 0 ELSE (NOT contains(value, '::') AND len(list_filter(string_split_regex(value, ':+'), lambda g: g <> '')) = 8) OR ((length(value) - length(replace(value, '::', ''))) // 2 = 1 AND len(list_filter(string_split_regex(value, ':+'), lambda g: g <> '')) <= 7 AND (regexp_matches(value, '[0-9]') OR len(list_filter(string_split_regex(value, ':+'), lambda g: g <> '')) >= 3)) END",
    "DOMAIN": "lower(string_split(value, '.')[-1]) IN ('com', 'org', 'net', 'io', 'dev', 'edu', 'gov', 'info', 'co', 'de', 'fr', 'es', 'uk', 'eu', 'rs', 'md', 'py', 'sh', 'ai', 'app')",
    "US_SSN": "substr(value, 1, 3) NOT IN ('000', '666') AND substr(value, 1, 1) <> '9' AND substr(value, 5, 2) <> '00' AND substr(value, 8) <> '0000' AND value NOT IN ('078-05-1120', '219-09-9999', '123-45-6789')",
    "IBAN_CODE": f"length(value) BETWEEN 15 AND 34 AND {_MOVED}::HUGEINT % 97 = 1",
    "ABA_ROUTING_NUMBER": f"{weights_sql('value', [3, 7, 1] * 3)} % 10 = 0 AND regexp_matches(value, '^(0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)')",
    "MEDICAL_LICENSE": f"{weights_sql('substr(value, 3, 6)', [1, 2, 1, 2, 1, 2])} % 10 = substr(value, 9, 1)::INT",
    "US_NPI": luhn_sql("('80840' || value)"),
    "UK_NHS": f"(11 - {weights_sql(digits_sql(), [10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11) % 11 = substr({digits_sql()}, 10, 1)::INT",
    "UK_NINO": "substr(value, 1, 2) NOT IN ('BG', 'GB', 'KN', 'NK', 'NT', 'TN', 'ZZ')",
    "CRYPTO": "false",
}


def whole_sql(entity: str) -> str:
    """That a value isn't a part of something longer, by the two characters behind it."""
    pattern = GOES_ON.get(entity)
    return f"NOT regexp_matches(substr(t, stop + 1, 2), '{pattern}')" if pattern else "true"


def near_sql(words: tuple[str, ...]) -> str:
    """Whether one of the last five words before start is among words."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_has_any(list_filter(string_split_regex(lower(substr(t, 1, start)), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')[-5:], [{listed}])"


def recognized_sql(source: str, key: str, entity: str, pattern: str, score: float, context: tuple[str, ...] = (), check: str | None = None, order: int = 0) -> str:
    """key, entity, start, stop, value, score, ord, t of a pattern's valid values."""
    raised = f"CASE WHEN {near_sql(context)} THEN least({score}::DOUBLE + 0.35::DOUBLE, 1.0::DOUBLE) ELSE {score}::DOUBLE END" if context else f"{score}::DOUBLE"
    return f"SELECT {key}, '{entity}' AS entity, start, stop, value, {raised} AS score, {order} AS ord, t FROM ({spans_sql(source, key, 'text', pattern)}) WHERE {check or CHECKS.get(entity, 'true')} AND {whole_sql(entity)}"


def resolved_sql(spans: str, key: str) -> str:
    """key, entity, start, stop, value of the spans (key, entity, start, stop, value, score, ord) that stay when overlaps are resolved."""
    return f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, stop - start DESC, ord, start) AS k FROM ({spans})),
  taken AS (
    SELECT {key}, 1::BIGINT AS k, [{{'start': start, 'stop': stop, 'entity': entity, 'value': value}}] AS kept FROM ranked WHERE k = 1
    UNION ALL
    SELECT t.{key}, r.k, CASE WHEN len(list_filter(t.kept, lambda x: x.start < r.stop AND r.start < x.stop)) = 0 THEN list_append(t.kept, {{'start': r.start, 'stop': r.stop, 'entity': r.entity, 'value': r.value}}) ELSE t.kept END
    FROM taken t JOIN ranked r ON r.{key} = t.{key} AND r.k = t.k + 1
  ), last AS (SELECT {key}, arg_max(kept, k) AS kept FROM taken GROUP BY {key})
  SELECT {key}, x.entity AS entity, x.start AS start, x.stop AS stop, x.value AS value FROM (SELECT {key}, unnest(kept) AS x FROM last)"""

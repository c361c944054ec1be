"""DuckDB SQL of the label-driven recognizers, over whole texts on both sides of a value."""

from __future__ import annotations

from ..functions import context as X
from .sqltext import luhn_sql, spans_sql


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _in(values) -> str:
    return "(" + ", ".join(f"'{_q(v)}'" for v in values) + ")"


def beside_sql(source: str, key: str, pattern: str) -> str:
    """The matches of a pattern with what stands before them (link, head, last words) and behind them (post)."""
    return f"""SELECT *, ' ' || array_to_string(regexp_extract_all(lower(head), '[0-9a-z_]+')[-5:], ' ') || ' ' AS words, translate(link, ' ' || chr(9), '') AS marks
  FROM (SELECT *, substr(pre, 1, length(pre) - length(link)) AS head FROM (
    SELECT *, regexp_extract(pre, '[^0-9A-Za-z_]*$') AS link FROM (SELECT *, substr(t, 1, start) AS pre, substr(t, stop + 1) AS post FROM ({spans_sql(source, key, "text", _q(pattern))}))))"""


def _before(label: X.Label) -> str:
    same = f"(length(link) <= {X.LINK} AND translate(marks, '{label.marks}', '') = '')"
    if label.below:
        same = f"({same} OR (marks IN (':' || chr(10), ':' || chr(13) || chr(10)) AND length(string_split(link, chr(10))[-1]) <= {X.INDENT}))"
    found = f"(regexp_matches(words, '{X.ended_by(label.words)}') AND {same})"
    if label.verb:
        verb = X.ended_by(tuple(f"{w} is" for w in label.words))
        found = f"({found} OR (regexp_matches(words, '{verb}') AND regexp_matches(head, '[0-9A-Za-z_.][ \\t]+[iI][sS]$') AND marks IN ('', ':', '=')))"
    return found


def _parted(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^0-9a-z_]+', ' ', 'g'))"


def _after(label: X.Label) -> str:
    said = f"({_parted('ltrim(translate(post, chr(9), chr(32)))')} || ' ')"
    inner = "regexp_extract(post, '^[ \\t]{0,2}[(]([^()\n]*)[)]', 1)"
    return f"({_parted(inner)} IN {_in(label.after)} OR (regexp_matches(post, '^[ \\t]+[iI][sS][ \\t]') AND regexp_matches({said}, '^is (my )?({'|'.join(label.said)}) ')))"


def named_sql(labels: tuple[X.Label, ...]) -> str:
    return "(" + " OR ".join([*map(_before, labels), *[_after(label) for label in labels if label.after]]) + ")"


def _number(text: str, low: int, high: int) -> str:
    return f"coalesce(length({text}) <= 2 AND try_cast({text} AS INT) BETWEEN {low} AND {high}, false)"


_FIELDS = "string_split_regex(value, '\\s?[/.-]\\s?')"
_MONTH_NAMED = f"lower(regexp_extract(value, '^[A-Za-z]+')) IN {_in([*X.MONTHS, *(m[:3] for m in X.MONTHS), 'sept'])}"
_F = [f"{_FIELDS}[{i}]" for i in (1, 2, 3)]
_BIRTH = f"""((len({_FIELDS}) = 3 AND ((length({_F[0]}) = 4 AND {_number(_F[1], 1, 12)} AND {_number(_F[2], 1, 31)})
  OR ((({_number(_F[0], 1, 12)} AND {_number(_F[1], 1, 31)}) OR (length({_F[0]}) <= 2 AND {_number(_F[1], 1, 12)})) AND length({_F[2]}) BETWEEN 2 AND 4)))
  OR (regexp_matches(value, '^(19|20)[0-9]{{6}}$') AND {_number('value[5:6]', 1, 12)} AND {_number('value[7:8]', 1, 31)}) OR ({_MONTH_NAMED} AND regexp_matches(value, '[0-9][a-z]{{0,2}},?\\s+[0-9]{{4}}$')))"""
_EXPIRY = f"((len({_FIELDS}) = 2 AND {_number(_F[0], 1, 12)} AND length({_F[1]}) IN (2, 4) AND NOT contains(value, '.')) OR ({_MONTH_NAMED} AND regexp_matches(value, '^[A-Za-z]+[\\s-]([0-9]{{2}}|[0-9]{{4}})$')))"
_ENDED = f"NOT regexp_matches(post, '{_q(X._GOES_ON)}')"


def _rows(source: str, key: str, entity: str, pattern: str, where: str, order: int) -> str:
    return f"SELECT {key}, '{entity}' AS entity, start, stop, value, {X.SCORE}::DOUBLE AS score, {order} AS ord, t FROM ({beside_sql(source, key, pattern)}) WHERE {where}"


def birth_sql(source: str, key: str, order: int = 0) -> str:
    return _rows(source, key, "DATE_OF_BIRTH", X.DATES_PLAIN, f"{_BIRTH} AND {_ENDED} AND {named_sql(X.BIRTH)}", order)


def code_sql(source: str, key: str, order: int = 0) -> str:
    return _rows(source, key, "CVV", X.CODES_PLAIN, f"NOT regexp_matches(post, '^[0-9A-Za-z_]') AND {named_sql(X.CODE)}", order)


def cards_sql(text: str) -> str:
    """The list of card numbers in a text."""
    runs = f"list_filter(regexp_extract_all({text}, '[0-9]+(?:[ -][0-9]+)*'), lambda r: length(r) >= 13)"
    groups = "string_split_regex(r, '[ -]')"
    ahead = f"list_transform(range(1, len({groups}) + 1), lambda i: substr(array_to_string({groups}[i:i + 18], ''), 1, 19))"
    some = f"flatten(list_transform({ahead}, lambda d: list_transform(range(13, length(d) + 1), lambda n: substr(d, 1, n))))"
    return f"list_distinct(flatten(list_transform({runs}, lambda r: list_filter({some}, lambda d: {luhn_sql('d')}))))"


_AROUND = f"substr(t, greatest(start - {X.WINDOW + X.LABEL}, 0) + 1, stop + {X.WINDOW} - greatest(start - {X.WINDOW + X.LABEL}, 0))"
_WORDS = f"(' ' || trim(regexp_replace(lower({_AROUND}), '[^0-9a-z]+', ' ', 'g')) || ' ')"
_NEAR = "(" + " OR ".join(f"contains(w, ' {t} ')" for t in X.CARD_TERMS) + " OR len(cards) > 0)"
_SURE = "(" + " OR ".join(f"contains(w, ' {t} ')" for t in X.PAYMENT_TERMS) + " OR len(cards) > 0)"


def expiry_sql(source: str, key: str, order: int = 0) -> str:
    """The expiry dates in a table's texts: key, entity, start, stop, value, score, ord, t."""
    found = " UNION ALL ".join(_rows(source, key, name, X.DATES_PLAIN, f"{_EXPIRY} AND {_ENDED} AND {named_sql(labels)}", order) for name, labels in (("gated", X.EXPIRES), ("free", X.VALID)))
    return f"""SELECT {key}, CASE WHEN {_SURE} THEN 'CREDIT_CARD_EXPIRATION' ELSE 'EXPIRATION_DATE' END AS entity, start, stop, value, score, ord, t
  FROM (SELECT *, {_WORDS} AS w, {cards_sql(_AROUND)} AS cards FROM ({found})) WHERE entity = 'free' OR {_NEAR}"""


def credential_sql(source: str, key: str, order: int = 0) -> str:
    """Values of named parameters, and user:password before a host, in texts as they stand."""
    run = "regexp_extract(substr(t, 1, start), '([0-9A-Za-z_-]+)[\"'']?[ \\t]*$', 1)"
    tails = f"list_transform(range(1, len(string_split(lower({run}), '-')) + 1), lambda n: array_to_string(string_split(lower({run}), '-')[-n:], '-'))"
    named = f"len(list_filter({tails}, lambda x: x IN {_in(X.names_spelt())} OR regexp_extract(x, '^[0-9a-z]+_([a-z]+)$', 1) IN {_in(X.CREDENTIAL_ENDINGS)})) > 0"
    parts = ", ".join(f"regexp_extract(substr(t, stop + 1), '{_q(X._VALUE)}', {i}) AS {n}" for i, n in enumerate(("g1", "g2", "g3", "g4"), 1))
    return f"""SELECT {key}, 'URL_CREDENTIAL' AS entity, start, stop, value, {X.SCORE}::DOUBLE AS score, {order} AS ord, t FROM (
  SELECT *, coalesce(max(stop) OVER (PARTITION BY {key} ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS reach FROM (
    SELECT {key}, t, (edge + length(g1) + CASE WHEN schemed THEN length(g2) + length(g3) ELSE 0 END)::INT AS start, CASE WHEN schemed THEN g4 ELSE g2 END AS value,
      (edge + length(g1) + CASE WHEN schemed THEN length(g2) + length(g3) + length(g4) ELSE length(g2) END)::INT AS stop
    FROM (SELECT *, lower(g2) IN {_in(X.SCHEMES)} AND length(g4) >= 2 AS schemed FROM (SELECT {key}, t, stop AS edge, {parts} FROM ({spans_sql(source, key, "text", "()([=:])")}) WHERE {named}))
  ) WHERE length(value) >= 2) WHERE start >= reach
UNION ALL SELECT {key}, 'URL_CREDENTIAL', start, stop, value, {X.SCORE}::DOUBLE, {order}, t FROM ({spans_sql(source, key, "text", X.USERINFO)}) WHERE regexp_matches(value, '^[^:]*:..')"""

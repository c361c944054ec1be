"""Spans in text as arrays of structs: found, gated, resolved and spliced without leaving the JVM.

Offsets are half-open and count code points.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: start, end, entity, score, source (secret, custom, regex or ml), value, literal, ord (the order of insertion).
SPAN = "struct<start:int,end:int,entity:string,score:double,source:string,value:string,literal:boolean,ord:int>"
SPANS = f"array<{SPAN}>"

#: Tier by source: the lower wins.
TIERS = {"secret": 0, "custom": 1, "regex": 2, "ml": 2}


class Search(NamedTuple):
    """A pattern to look for. With groups, group 1 is what stands before the value and group 2 the value; what follows is group 3.
    The pattern must not match an empty string."""

    pattern: str
    entity: str
    score: float = 1.0
    source: str = "regex"
    groups: bool = True
    literal: bool = False
    order: int = 0
    guard: str | tuple[str, ...] = ""  # a cheap pattern, or literals of which one stands in every text with a match


def let(value: Column, body) -> Column:
    """body(value) with value worked out once. What a lambda takes from outside it is worked out anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, entity: Column | str, score: Column | float, source: Column | str, value: Column, literal: Column | bool = False, order: Column | int = 0) -> Column:
    parts = {"entity": entity, "score": score, "source": source, "value": value, "literal": literal, "ord": order}
    rest = [(p if isinstance(p, Column) else F.lit(float(p) if name == "score" else p)).alias(name) for name, p in parts.items()]
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), *rest)


def singly(pattern: str) -> str:
    """A pattern whose classes name each Latin-1 character, for ranges of them and \\s. The JVM keeps singles as one table. Ranges it joins in pairs, by objects of
    one hidden class that are called by two interfaces in turn: from three parts on, each call rewrites a field of that class, which all threads of a process
    share, so that eight threads take eight times as long as one for the same text. Classes in classes stay as they are."""
    return re.sub(r"(\\.)|\[(\^?)((?:\\.|[^\]\\])+)\]", lambda m: m[1] or f"[{m[2]}{_singles(m[3])}]", pattern, flags=re.S)


def _singles(inner: str) -> str:
    if "&&" in inner or re.search(r"(?<!\\)\[", inner):
        return inner
    named = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
    one, rest = set(), []
    for p in re.finditer(r"(\\[pP]\{\w+\}|\\[wWdDSbB])|(\\s)|(\\?.)(?:-(\\?.))?", inner, re.S):
        first, last = (c and (named.get(c[1], c[1]) if len(c) > 1 else c) for c in p.group(3, 4))
        if p[1] or (last or first or "") > "\xff":
            rest.append(p[0])
        else:
            one |= set(" \t\n\x0b\f\r") if p[2] else {chr(c) for c in range(ord(first), ord(last or first) + 1)}
    return "".join(f"\\{c}" if c in "\\]^-&" else c for c in sorted(one)) + "".join(rest)


#: Words of running prose: lower-case letters, at most the first a capital, between white space.
PROSE = singly("(?:[ \n][A-Z]?[a-z\u00DF-\u00F6\u00F8-\u00FF]{1,14}[,.;!?]?(?=[ \n]))++")


def literal(value: str) -> str:
    """A string as a literal of Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def applied(expression: str, **values: Column) -> Column:
    """An SQL expression over b.name for each named value, each worked out once. Long expressions are parsed much faster than built."""
    return F.get(F.call_function("transform", F.array(F.struct(*[v.alias(k) for k, v in values.items()])), F.expr(f"b -> {expression}")), F.lit(0))


def _guarded(s: Search) -> str:
    if not s.guard:
        return "true"
    return f"b.hot RLIKE {literal(singly(s.guard))}" if isinstance(s.guard, str) else "(" + " OR ".join(f"contains(b.hot, {literal(g)})" for g in s.guard) + ")"


#: Marks that stand before a match, before its value and behind it while a text is cut: characters that no text may hold. Where one does,
#: it is looked at as the replacement character.
_FIRST, _VALUE, _REST = "\uFDD0", "\uFDD1", "\uFDD2"
_MARKS = _FIRST + _VALUE + _REST


def _groups(pattern: str) -> int:
    """How many groups a pattern of the JVM takes: its opening brackets outside classes and escapes, without those that ask for something else."""
    return len(re.findall(r"\((?!\?)", re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "x", pattern)))


def _matches(s: Search) -> str:
    """The text cut before each match of a search, as a struct with what the search says of it; null if the guard fails. One scan."""
    marked = f"{_FIRST}$1{_VALUE}$2{_REST}{'$3' * (_groups(s.pattern) > 2)}" if s.groups else f"{_FIRST}{_VALUE}$0{_REST}"
    parts = {"cut": f"split(regexp_replace(b.text, {literal(singly(s.pattern))}, '{marked}'), '{_FIRST}', -1)", "entity": literal(s.entity), "score": f"{float(s.score)}D", "source": literal(s.source), "literal": str(s.literal).lower(), "ord": str(s.order)}
    return f"CASE WHEN {_guarded(s)} THEN named_struct({', '.join(f"'{k}', {v}" for k, v in parts.items())}) END"


#: Elements that a running sum folds at once: appending copies an array, so longer ones are folded block by block.
_BLOCK = 256


def _fold(a: str, start: str, step: str) -> str:
    return f"aggregate({a}, named_struct('at', {start}, 'out', cast(array() AS array<int>)), (s, x) -> named_struct('at', {step}, 'out', array_append(s.out, s.at)), s -> s.out)"


def _running(a: str, whole: str, start: str, step: str, join: str) -> str:
    """For each element of the array named a what the elements before it come to: whole(b) of a block, join(x, o) of a place in a block and the blocks before."""
    blocks = f"transform(sequence(0, size({a}) - 1, {_BLOCK}), i -> slice({a}, i + 1, {_BLOCK}))"
    inner = f"flatten(zip_with(v.k, transform(array(transform(v.k, b -> {whole})), t -> {_fold('t', start, step)})[0], (b, o) -> transform({_fold('b', start, step)}, x -> {join})))"
    return f"CASE WHEN size({a}) <= {_BLOCK} THEN {_fold(a, start, step)} ELSE transform(array(named_struct('k', {blocks})), v -> {inner})[0] END"


def running_sums_sql(a: str) -> str:
    """The sum of all elements before each, for an array of integers that has a name in SQL; work grows with the length and a share of it."""
    return _running(a, "aggregate(b, 0, (x, y) -> x + y)", "0", "s.at + x", "x + o")


def running_most_sql(a: str) -> str:
    """The largest of all elements before each, -1 for the first."""
    return _running(a, "array_max(b)", "-1", "greatest(s.at, x)", "greatest(x, o)")


def running_sums(values: Column) -> Column:
    return applied(running_sums_sql("b.a"), a=values.cast("array<int>"))


#: The spans of one search's cut text, placed by running sums of the parts' lengths without their two marks.
_SPANS = f"""m -> transform(array(named_struct('p', slice(m.cut, 2, size(m.cut)), 'l', transform(slice(m.cut, 2, size(m.cut)), c -> length(c) - 2))), c ->
zip_with(c.p, transform(array(c.l), l -> {running_sums_sql("l")})[0], (part, at) -> named_struct(
  'start', length(m.cut[0]) + at + instr(part, '{_VALUE}') - 1, 'end', length(m.cut[0]) + at + instr(part, '{_REST}') - 2, 'entity', m.entity, 'score', m.score, 'source', m.source,
  'value', substring(part, instr(part, '{_VALUE}') + 1, instr(part, '{_REST}') - instr(part, '{_VALUE}') - 1), 'literal', m.literal, 'ord', m.ord)))[0]"""


def find_all(text: Column, searches: list[Search], only_if: list[tuple[str, list[Search]]] = []) -> Column:  # noqa: B006
    """The spans of every search, in order; those of only_if's lists only where the text has the list's pattern.

    Guards, and the patterns of only_if, are tried on the text without its running prose, so they must not depend on it.
    """
    own = lambda some: f"array({', '.join(map(_matches, some))})"
    lists = [own(searches)] * bool(searches) + [f"CASE WHEN b.hot RLIKE {literal(singly(pattern))} THEN {own(some)} ELSE array() END" for pattern, some in only_if]
    needs = any(s.guard for s in searches) or only_if
    hot = F.regexp_replace(text, PROSE, "") if needs else F.lit("")
    found = f"cast(flatten(transform(array_compact(concat({', '.join(lists)})), {_SPANS})) AS {SPANS})"
    odd = reduce(lambda a, b: a | b, map(text.contains, _MARKS))
    spans = F.coalesce(applied(found, text=F.when(odd, F.translate(text, _MARKS, "\uFFFD" * 3)).otherwise(text), hot=hot), no_spans())
    if only_if and not searches:  # a text with none of the patterns needs not be freed from its prose
        spans = F.when(reduce(lambda a, b: a | b, [text.rlike(singly(pattern)) for pattern, _ in only_if]), spans).otherwise(no_spans())
    return F.transform(spans, lambda s: s.withField("value", F.when(s["value"].contains("\uFFFD"), F.substring(text, s["start"] + 1, s["end"] - s["start"])).otherwise(s["value"])))


def find_behind(text: Column, first: str, ahead: int, find) -> Column:
    """find of a text's tail from some characters ahead of the first match of a pattern, with the places of the whole text; no spans without a match. No value
    that is looked for may begin further ahead of that match."""
    rest = lambda t: F.length(t) - F.length(F.regexp_extract(t, f"(?s)(?:{first}).*", 0)) - ahead
    tail = lambda b: F.struct(b["at"].alias("at"), F.substring(b["text"], b["at"] + 1, F.length(b["text"])).alias("text"))
    moved = lambda b: F.transform(find(b["text"]), lambda s: s.withField("start", s["start"] + b["at"]).withField("end", s["end"] + b["at"]))
    return let(F.struct(text.alias("text"), F.greatest(rest(text), F.lit(0)).alias("at")), lambda b: let(tail(b), moved))


def find(text: Column, pattern: str, entity: str, score: float, source: str = "regex", groups: bool = True, literal: bool = False, order: int = 0) -> Column:
    """Every match of one pattern as a span; see Search."""
    return find_all(text, [Search(pattern, entity, score, source, groups, literal, order)])


def find_literal(text: Column, value: str, entity: str, source: str, case_sensitive: bool = True, literal: bool = False, order: int = 0) -> Column:
    """Every occurrence of a literal as a span of score 1."""
    quoted = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in value)
    return find(text, quoted if case_sensitive else f"(?i){quoted}", entity, 1.0, source, groups=False, literal=literal, order=order)


#: Characters of a block of a long text. A place in a string is found by counting from its start, so long texts are cut once.
_PIECE = 1024


def held(text: Column, needed: Column) -> Column:
    """A text beside its blocks, for before, after and between; the blocks are cut only where they are needed."""
    blocks = F.when(needed & (F.length(text) > 4 * _PIECE), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))
    return F.struct(text.alias("text"), blocks.alias("blocks"))


def between(b: Column, start: Column, n: Column) -> Column:
    """n characters from a place of a held text."""
    first = F.floor(start / _PIECE).cast("int")
    some = F.array_join(F.slice(b["blocks"], first + 1, F.floor((start + n) / _PIECE).cast("int") - first + 1), "")
    return F.when(b["blocks"].isNull(), F.substring(b["text"], start + 1, n)).otherwise(F.substring(some, start - first * _PIECE + 1, n))


def before(b: Column, start: Column, n: int) -> Column:
    """The last n characters before a place of a held text."""
    first = F.greatest(start - n, F.lit(0))
    return between(b, first, start - first)


def after(b: Column, end: Column, n: int) -> Column:
    """The first n characters from a place of a held text."""
    return between(b, end, F.lit(n))


def beside(text: Column, spans: Column, body) -> Column:
    """body(b) of b.found, the spans, worked out once, and b.own, the text held for them where there are any."""
    return let(spans, lambda k: let(F.struct(held(text, F.size(k) > 0).alias("own"), k.alias("found")), body))


def where(spans: Column, keep) -> Column:
    return F.filter(spans, keep)


def rescored(spans: Column, score) -> Column:
    return F.transform(spans, lambda s: s.withField("score", score(s)))


def trimmed_quotes(spans: Column, entities: tuple[str, ...] = ("URL", "DOMAIN")) -> Column:
    """Spans of these entities without the same quote at both ends; three characters at least must be there."""

    def trim(s: Column) -> Column:
        first, last = F.substring(s["value"], 1, 1), F.substring(s["value"], -1, 1)
        quoted = s["entity"].isin(*entities) & (F.length(s["value"]) >= 3) & first.isin("'", '"', "`") & (first == last)
        inner = s.withField("start", s["start"] + 1).withField("end", s["end"] - 1).withField("value", F.substring(s["value"], F.lit(2), F.length(s["value"]) - 2))
        return F.when(quoted, inner).otherwise(s)

    return F.transform(spans, trim)


def not_allowed(spans: Column, allowed: Column, exempt: tuple[str, ...]) -> Column:
    """Spans that lie in no allowed one (start, end). Registered secrets and the exempt entities stay in any case."""
    inside = lambda s: F.exists(allowed, lambda a: (a["start"] <= s["start"]) & (s["end"] <= a["end"]))
    return F.filter(spans, lambda s: (s["source"] == "secret") | s["entity"].isin(*exempt) | ~inside(s))


def _greedy(spans: Column) -> Column:
    """Of spans that touch each other, those taken greedily by tier, then higher score, then length, then order of insertion."""
    tier = lambda s: reduce(lambda w, k: w.when(s["source"] == k, TIERS[k]), list(TIERS)[1:], F.when(s["source"] == list(TIERS)[0], TIERS[list(TIERS)[0]])).otherwise(9)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(tier(s).alias("t"), (-s["score"]).alias("n"), (s["start"] - s["end"]).alias("l"), s["ord"].alias("o"), s["start"].alias("b"), s.alias("s"))))
    free = lambda kept, s: ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    return F.aggregate(ordered, no_spans(), lambda out, k: F.when(free(out, k["s"]), F.array_append(out, k["s"])).otherwise(out))


def resolve(spans: Column) -> Column:
    """Non-overlapping spans in text order. A sweep over the sorted spans cuts them where none that began before reaches; only spans of one
    such cluster are held against each other."""

    def clustered(c: Column) -> Column:
        n = F.size(c["s"])
        until = lambda k: F.when(k + 1 < F.size(c["first"]), F.get(c["first"], k + 1)).otherwise(n)
        clusters = F.transform(c["first"], lambda f, k: F.slice(c["s"], f + 1, until(k) - f))
        settled = F.flatten(F.transform(clusters, lambda x: F.when(F.size(x) > 1, F.array_sort(_greedy(x))).otherwise(x)))
        return F.when(F.size(c["first"]) == n, c["s"]).otherwise(settled)

    def swept(c: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(c["s"]) - 1), lambda i: F.get(c["s"], i)["start"] >= F.get(c["reach"], i))
        return let(F.struct(c["s"].alias("s"), first.alias("first")), clustered)

    reach = lambda s: applied(running_most_sql("b.a"), a=F.transform(s, lambda x: x["end"]))
    several = lambda b: let(F.array_sort(b), lambda s: let(F.struct(s.alias("s"), reach(s).alias("reach")), swept))
    return let(spans, lambda b: F.when(F.size(b) < 2, b).otherwise(several(b)))


def splice(text: Column, spans: Column, rendered) -> Column:
    """The text with each of its sorted, non-overlapping spans replaced by rendered(span)."""

    def joined(b: Column) -> Column:
        parts = F.transform(b["spans"], lambda s, i: F.concat(between(b["own"], F.get(b["ends"], i), s["start"] - F.get(b["ends"], i)), rendered(s)))
        return F.concat(F.array_join(parts, ""), F.substring(b["own"]["text"], F.element_at(b["ends"], -1) + 1, F.length(b["own"]["text"])))

    def spliced(k: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(k, lambda s: s["end"]))
        return F.when(F.size(k) == 0, text).otherwise(let(F.struct(held(text, F.size(k) > 8).alias("own"), k.alias("spans"), ends.alias("ends")), joined))

    return let(spans, spliced)

"""Detection over tables of text: recognizers, gates and overlap resolution as one projection, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import context as X
from ..functions import patterns as P
from ..functions import spans as S
from ..plans.policy import CATEGORIES, CONTEXT_BOOST, CustomRule, Policy

#: Words before a match that can raise its score.
CONTEXT_WORDS = 5

#: Last labels of names that are files, not hosts.
FILE_LABELS = ("cc", "go", "la", "md", "ml", "pl", "py", "rb", "rs", "sh", "so")


class Labelled(NamedTuple):
    """Recognizers of values by the label beside them."""

    entities: tuple[str, ...]
    find: Callable[[Column], Column]
    guards: tuple[str | tuple[str, ...], ...]  # cheap patterns that every text with a match has, or literals of which it has one
    score: float = X.SCORE


BIRTH = Labelled(("DATE_OF_BIRTH",), X.birth_dates, ("[0-9]{2}", "(?i)birth|d[^0-9a-z]?o[^0-9a-z]?b|born"))
EXPIRY = Labelled(("CREDIT_CARD_EXPIRATION", "EXPIRATION_DATE"), X.expiries, ("[0-9]{2}", "(?i)exp|thru|through"))
CODE = Labelled(("CVV",), X.security_codes, ("[0-9]{3}", "(?i)cvv|cvc|cav2|security|card"))
CREDENTIAL = Labelled(("URL_CREDENTIAL",), X.credentials, (("=", ":", "%"),))

#: Recognizers that run on every text, in order of insertion.
STANDARD = (
    P.PREFIXED_KEY, P.AWS_ACCESS_KEY, P.AWS_SECRET_KEY, P.AZURE_KEY, P.GCP_API_KEY, P.JWT, P.PRIVATE_KEY, P.API_KEY, P.EMAIL, P.URL, P.DOMAIN,
    P.PHONE, P.CARD, P.IPV4, P.MAC, P.IPV6, P.IBAN, P.SSN, P.ITIN, P.NINO, P.ABA, P.BANK, P.DEA, P.NPI, P.MBI, P.US_PASSPORT, P.UK_PASSPORT, P.US_DRIVER_LICENSE, P.UK_DRIVING_LICENCE,
    P.PASSPORT, P.DRIVER_LICENSE, P.NATIONAL_ID, P.CRYPTO, BIRTH, EXPIRY, CODE, CREDENTIAL,
)

#: With NHS numbers, whose check digit one telephone number in eleven passes.
ALL = (*STANDARD, P.NHS)

#: Those that need no six digits in a row of groups: the rest run only on texts that have them.
_WORDY = (P.PREFIXED_KEY, P.AWS_ACCESS_KEY, P.AWS_SECRET_KEY, P.AZURE_KEY, P.GCP_API_KEY, P.JWT, P.PRIVATE_KEY, P.API_KEY, P.EMAIL, P.URL, P.DOMAIN, P.MAC, P.IPV4, P.IPV6, P.MBI, P.IBAN, P.CRYPTO)
SIX_DIGITS = "[0-9](?:[ ().-]{0,2}[0-9]){5}"
#: Of the rest those that need a digit, and those that need one of two marks.
_DIGIT, _MARKED = (P.IPV4, P.MBI, P.IBAN, P.CRYPTO), (P.MAC, P.IPV6)
#: Those that need a digit, or six, begin no more than so many characters before their first digit.
AHEAD = 16

#: Characters before a match in which its context is looked for first.
NEAR = 200


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def words_before(own: Column, start: Column) -> Column:
    """The last CONTEXT_WORDS words before a place of a held text, the last first. NEAR characters are enough when more words than that stand in them;
    else the whole text before the place is read."""
    near = words(S.before(own, start, NEAR))
    enough = (start <= NEAR) | (F.size(near) > CONTEXT_WORDS)
    found = F.when(enough, near).otherwise(words(F.substring(own["text"], F.lit(1), start)))
    return F.slice(F.reverse(found), 1, CONTEXT_WORDS)


def boosted(text: Column, spans: Column, recognizers: tuple[P.Recognizer, ...]) -> Column:
    """Scores raised by CONTEXT_BOOST where one of the words before a span is a context word of its entity."""
    contexts = {r.entity: r.context for r in recognizers if r.context}
    if not contexts:
        return spans
    listed = lambda s: F.coalesce(*[F.when(s["entity"] == e, F.lit(list(c))) for e, c in contexts.items()], F.array().cast("array<string>"))

    def raised(b: Column) -> Column:
        near = lambda s: F.arrays_overlap(words_before(b["own"], s["start"]), listed(s))
        return S.rescored(b["found"], lambda s: F.when(s["entity"].isin(*contexts) & near(s), F.least(s["score"] + CONTEXT_BOOST, F.lit(1.0))).otherwise(s["score"]))

    return S.beside(text, spans, raised)


def searched(text: Column, *recognizers: P.Recognizer) -> Column:
    """What the recognizers of shapes find, unchecked, each with its place in the list as the order of insertion."""
    def of(keep) -> list[S.Search]:
        return [r.search(i) for i, r in enumerate(recognizers) if isinstance(r, P.Recognizer) and keep(r)]

    groups = [("[:-]", of(_MARKED.__contains__)), ("[0-9]", of(_DIGIT.__contains__)), (SIX_DIGITS, of(lambda r: r not in _WORDY))]
    wordy, groups = of(lambda r: r in _WORDY and r not in (*_MARKED, *_DIGIT)), [(pattern, some) for pattern, some in groups if some]
    if groups and not wordy and not of(_MARKED.__contains__):  # all begin about a digit: what stands before the first one isn't searched
        return S.find_behind(text, "[0-9]", AHEAD, lambda tail: S.find_all(tail, [], groups))
    return S.find_all(text, wordy, groups)


def confirmed(text: Column, found: Column, *recognizers: P.Recognizer) -> Column:
    """The valid ones of spans that were searched, with their scores in context."""
    shaped = tuple(r for r in recognizers if isinstance(r, P.Recognizer))
    return boosted(text, P.checked(text, found, {r.entity for r in shaped}), shaped)


def of_label(text: Column, r: Labelled, order: int) -> Column:
    """What a recognizer by labels finds in the texts that have its guards."""
    has = lambda g: text.rlike(S.singly(g)) if isinstance(g, str) else reduce(lambda a, b: a | b, map(text.contains, g))
    return F.when(reduce(lambda a, b: a & b, map(has, r.guards)), F.transform(r.find(text), lambda s: s.withField("ord", F.lit(order)))).otherwise(S.no_spans())


def recognized(text: Column, *recognizers: P.Recognizer | Labelled) -> Column:
    """The recognizers' valid values with their scores in context, each with its recognizer's place as the order of insertion."""
    parts = [confirmed(text, searched(text, *recognizers), *recognizers)] if any(isinstance(r, P.Recognizer) for r in recognizers) else []
    parts += [of_label(text, r, i) for i, r in enumerate(recognizers) if isinstance(r, Labelled)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def with_recognized(rows: DataFrame, recognizers: tuple[P.Recognizer | Labelled, ...], text: str = "text", name: str = "found") -> DataFrame:
    """rows with what recognized finds, as the column name, in steps: a query's analysis takes a round for every function inside another, so
    many recognizers are a column each before they are put together. Two digits in a row are looked for once for all labels that need them."""
    own, parts = F.col(text), []
    dated = [r for r in recognizers if r in (BIRTH, EXPIRY, CODE)]
    if dated:
        rows = rows.withColumn("__dated", F.when(own.rlike("[0-9]{2}"), own))
    if any(isinstance(r, P.Recognizer) for r in recognizers):
        rows = rows.withColumn("__searched", searched(own, *recognizers)).withColumn("__shaped", confirmed(own, F.col("__searched"), *recognizers)).drop("__searched")
        parts.append("__shaped")
    for i, r in enumerate(recognizers):
        if isinstance(r, Labelled):
            parts.append(f"__label_{i}")
            rows = rows.withColumn(parts[-1], of_label(F.col("__dated") if r in dated else own, r, i))
    return rows.withColumn(name, F.concat(*[F.coalesce(p, S.no_spans()) for p in parts])).drop("__dated", *parts)


def reserved_ipv4(value: Column) -> Column:
    """Loopback, private, link-local or unspecified, after a /prefix is cut off."""
    o = F.transform(F.split(F.substring_index(value, "/", 1), r"\."), lambda x: x.try_cast("int"))
    first, second = F.get(o, F.lit(0)), F.get(o, F.lit(1))
    local = first.isin(127, 10) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168)) | ((first == 169) & (second == 254)) | F.forall(o, lambda x: x == 0)
    return F.coalesce((F.size(o) == 4) & local, F.lit(False))


def reserved_ipv6(value: Column) -> Column:
    """Loopback, unspecified, link-local fe80::/10 or documentation 2001:db8::/32, after %zone and /prefix are cut off."""
    bare = F.lower(F.substring_index(F.substring_index(value, "/", 1), "%", 1))
    return bare.rlike("^(0{1,4}:){7}0{0,3}1$|^::1$|^::$|^(0{1,4}:){7}0{1,4}$|^fe[89ab][0-9a-f]:|^2001:0?db8:")


#: Attribute or key directly before a URL that names a namespace, with its '=' or ':' and an opening quote. The key is a whole one:
#: no character of a key stands before it.
_KEY_CHARS = "0-9A-Za-z_$.:-"
_NAMESPACE_KEY = rf"(^|[^{_KEY_CHARS}])(xmlns(:[0-9A-Za-z_.-]+)?|\$schema|\$id|\$ref|targetNamespace|([0-9A-Za-z_.-]+:)?schemaLocation)[\"']?[ \t]*[=:][ \t]*[\"']?$"
_CUT_KEY = rf"^[{_KEY_CHARS}]*[\"']?[ \t]*[=:]?[ \t]*[\"']?$"


def namespace_url(own: Column, start: Column) -> Column:
    """Whether a namespace's key stands before a place of a held text. Where NEAR characters hold no more than a part of the key, all
    before is read."""
    near = S.before(own, start, NEAR)
    cut = (start > NEAR) & near.rlike(S.singly(_CUT_KEY))
    return F.when(cut, F.substring(own["text"], F.lit(1), start)).otherwise(near).rlike(S.singly(_NAMESPACE_KEY))


def filename_domain(value: Column) -> Column:
    """Whether a domain is a file's name by its last label: no '/' or ':' in it, not from 'www.'."""
    return ~value.contains("/") & ~value.contains(":") & ~F.lower(value).startswith("www.") & F.lower(F.element_at(F.split(value, r"\."), -1)).isin(*FILE_LABELS)


def near_now(value: Column, today: date) -> Column:
    """Whether YYYY-MM-DD or YYYY/MM/DD, just ten characters, is a date within a day of today."""
    shape = value.rlike("^[0-9]{4}([-/])[0-9]{2}[-/][0-9]{2}$") & (F.substring(value, 5, 1) == F.substring(value, 8, 1))
    day = F.try_to_date(F.when(shape, F.replace(value, F.lit("/"), F.lit("-"))), "yyyy-MM-dd")
    return F.coalesce(F.abs(F.datediff(day, F.lit(today))) <= 1, F.lit(False))


def allowed_value(value: Column, policy: Policy, today: date | None = None) -> Column:
    """Whether the value is on the allow list: as it is, letter case aside, or by a pattern; or a date about now."""
    listed = value.isin(*policy.allow) if policy.allow else F.lit(False)
    if policy.allow_any_case:
        listed = listed | F.lower(value).isin(*[a.lower() for a in policy.allow_any_case])
    for pattern in policy.allow_patterns:
        listed = listed | value.rlike(pattern)
    return listed | near_now(value, today) if today else listed


def custom_spans(text: Column, rules: tuple[CustomRule, ...], surface: Column | None = None) -> Column:
    """Matches of custom rules by priority, score 1; a rule with surfaces applies on these alone."""
    parts = []
    for order, rule in enumerate(sorted(rules, key=lambda r: r.priority)):
        flag = "" if rule.case_sensitive else "(?i)"
        if rule.is_regex:
            found = S.where(S.find(text, f"{flag}{rule.pattern}", rule.entity, 1.0, "custom", groups=False, literal=rule.token is not None, order=order), lambda s: s["end"] > s["start"])
        else:
            found = S.find_literal(text, rule.pattern, rule.entity, "custom", rule.case_sensitive, rule.token is not None, order)
        if rule.surfaces and surface is not None:
            found = F.when(surface.isin(*rule.surfaces), found).otherwise(S.no_spans())
        parts.append(found)
    return F.concat(*parts) if parts else S.no_spans()


def gated(text: Column, spans: Column, policy: Policy) -> Column:
    """The gates: score floor, phone without context, category, reserved address, namespace URL, file name; then quotes are trimmed."""

    def kept(b: Column) -> Column:
        def one(s: Column) -> Column:
            reserved = (s["entity"] == "IP_ADDRESS") & (reserved_ipv4(s["value"]) | reserved_ipv6(s["value"]))
            unlikely = ((s["entity"] == "PHONE_NUMBER") & (s["score"] <= 0.4)) | ((s["entity"] == "DOMAIN") & filename_domain(s["value"]))
            return (s["score"] >= policy.floor) & s["entity"].isin(*policy.entities()) & ~unlikely & ~reserved & ~((s["entity"] == "URL") & namespace_url(b["own"], s["start"]))

        return F.filter(b["found"], one)

    return S.trimmed_quotes(S.let(spans, lambda k: S.let(F.struct(S.held(text, F.exists(k, lambda s: s["entity"] == "URL")).alias("own"), k.alias("found")), kept)))


def _used(policy: Policy, recognizers: tuple[P.Recognizer | Labelled, ...]) -> list[P.Recognizer | Labelled]:
    """Recognizers of entities that a policy has, whose values can reach its floor."""
    enabled, lowest = set(policy.entities()), policy.floor - CONTEXT_BOOST
    return [r for r in recognizers if enabled & set(r.entities if isinstance(r, Labelled) else (r.entity,)) and r.score >= lowest]


def settled(first: Column, gate: Column, policy: Policy, today: date | None = None) -> Column:
    """Secrets and custom spans beside gated ones: allow spans suppress, overlaps are resolved."""
    if not (policy.allow or policy.allow_any_case or policy.allow_patterns) and today is None:
        return S.resolve(F.concat(first, gate))
    both = F.struct(first.alias("first"), gate.alias("gate"), S.where(gate, lambda s: allowed_value(s["value"], policy, today)).alias("allowed"))
    return S.resolve(S.let(both, lambda b: S.not_allowed(F.concat(b["first"], b["gate"]), b["allowed"], CATEGORIES["secrets"])))


def detected(text: Column, policy: Policy, recognizers: tuple[P.Recognizer | Labelled, ...] = STANDARD, secrets: Column | None = None, surface: Column | None = None, today: date | None = None) -> Column:
    """All spans of a text under a policy: registered secrets, custom rules, gated recognizers; allow spans suppress, overlaps are resolved.
    For a few recognizers; with_detected takes any number."""
    used = _used(policy, recognizers)
    found = recognized(text, *used) if used else S.no_spans()
    first = F.concat(secrets if secrets is not None else S.no_spans(), custom_spans(text, policy.custom, surface))
    return settled(first, gated(text, found, policy), policy, today)


def with_detected(rows: DataFrame, policy: Policy, recognizers: tuple[P.Recognizer | Labelled, ...] = STANDARD, text: str = "text", name: str = "spans", secrets: Column | None = None, surface: Column | None = None, today: date | None = None) -> DataFrame:
    """rows with all spans of a text column under a policy; as detected, in steps."""
    used = _used(policy, recognizers)
    own = F.col(text)
    rows = with_recognized(rows, tuple(used), text, "__found") if used else rows.withColumn("__found", S.no_spans())
    first = F.concat(secrets if secrets is not None else S.no_spans(), custom_spans(own, policy.custom, surface))
    rows = rows.withColumn("__gated", gated(own, F.col("__found"), policy)).drop("__found").withColumn("__first", first)
    return rows.withColumn(name, settled(F.col("__first"), F.col("__gated"), policy, today)).drop("__gated", "__first")

"""Recognizers of values that only a label beside them makes sensitive: dates of birth, card expiry and security codes, credentials.

A value is first found by its shape alone and checked field by field. The text beside it is then taken apart: the last words before it, and
the link of blanks and marks between them and the value; or the first words behind it. Tables say which words are labels and which links
may stand between. A credential is a value behind '=' or ':' whose name is in a table.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans as S
from . import text as T

SCORE = 0.85
#: Characters beside a value in which its label is looked for first; where they hold too few words, all of the text on that side is read.
NEAR = 200
#: Characters around an expiry date and its label, which has LABEL at most, in which a card may be mentioned.
WINDOW, LABEL = 40, 24

# Labels as words. Marks inside a label count as blanks.
BIRTH_LABELS = ("date of birth", "birth date", "birthdate", "dob", "d o b", "born", "born on")
BIRTH_MARKS = ("date of birth", "dob", "d o b")
EXPIRY_LABELS = ("exp", "expiry", "expiration", "expire", "expires", "exp date", "expiry date", "expiration date", "expire date", "expires date")
VALIDITY_LABELS = ("valid thru", "valid through", "good thru", "valid thru date", "valid through date", "good thru date")
CODE_LABELS = ("cvv", "cvv2", "cvc2", "cav2")
CODE_PHRASES = ("security code", "card verification", "card verification value", "card verification code", "card verification number", "card identification number")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Characters of a link on one line, blanks and marks, and of the indent of a value on the next line, at most.
LINK, INDENT = 6, 8

# Terms that say that a card is meant, and those that leave no doubt.
CARD_TERMS = ("card", "credit", "debit", "visa", "mastercard", "amex", "discover", "jcb", "diners", "maestro")
PAYMENT_TERMS = ("credit card", "debit card", "mastercard", "amex", "american express", "maestro", "jcb", "diners", "discover card", "visa card")

# Names of parameters that hold credentials. A blank stands for '_', '-' or nothing.
CREDENTIAL_NAMES = (
    "access key", "access key id", "access token", "api key", "assertion", "auth", "authorization", "bearer", "client secret", "credential", "csrf", "id token", "jwt", "oauth token", "otp", "pass", "passphrase",
    "passwd", "password", "pat", "private key", "pwd", "refresh token", "saml", "sas", "secret", "secret access key", "session", "session id", "shared access signature", "sid", "sig", "signature", "ssh key",
    "token", "webhook secret", "x-amz-security-token", "x-amz-signature", "x-goog-signature", "xsrf",
)
#: Words that make a credential's name behind any identifier and '_'.
CREDENTIAL_ENDINGS = ("apikey", "auth", "key", "passwd", "password", "pwd", "secret", "sig", "signature", "token")
#: Words between a name and its value that say how the value is used.
SCHEMES = ("basic", "bearer", "digest", "negotiate", "ntlm")


def names_spelt() -> list[str]:
    """Credential names with '_', '-' or nothing for each of their blanks."""
    return sorted({"".join(c + link for c, link in zip(words, [*links, ""], strict=True)) for words in (n.split(" ") for n in CREDENTIAL_NAMES) for links in product(("", "_", "-"), repeat=len(words) - 1)})


_EDGE = "(^|[^0-9A-Za-z_])"
_MONTH = f"(?:{'|'.join(m[:3] for m in MONTHS)})[a-z]{{0,6}}"
#: Runs of two to four fields of digits, eight digits, a month's name with day and year, or with a year.
DATES_PLAIN = f"(?i){_EDGE}([0-9]{{1,4}}(?:\\s?[/.-]\\s?[0-9]{{1,4}}){{1,3}}|[0-9]{{8}}|{_MONTH}[.]?\\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\\s+[0-9]{{4}}|{_MONTH}[\\s-][0-9]{{2,4}})"
CODES_PLAIN = f"{_EDGE}([0-9]{{3,4}})"
#: The same as the JVM reads them fast.
DATES, CODES = S.singly(DATES_PLAIN), S.singly(CODES_PLAIN)
#: What ends a value; blanks and a quote before it, itself, and a second word behind blanks.
_ENDS = "&#\\s\"'<>)}\\]"
_VALUE = f"^([ \\t]*[\"']?)([^{_ENDS}]+)(?:([ \\t]+)([^{_ENDS}]+))?"
USERINFO = "(://)([^/@\\s]+)(@)"


class Label(NamedTuple):
    """Labels before a value, the marks of a link, whether 'is' may be in it, whether the value may stand on the next line; labels that may follow
    a value in parentheses, or after 'is my'."""

    words: tuple[str, ...]
    marks: str
    verb: bool = False
    below: bool = False
    after: tuple[str, ...] = ()
    said: tuple[str, ...] = ()


BIRTH = (Label(BIRTH_LABELS, ":=#.-", True, True, BIRTH_MARKS, BIRTH_MARKS),)
EXPIRES = (Label(EXPIRY_LABELS, ":=#.-", True),)
VALID = (Label(VALIDITY_LABELS, ":=#.-", True),)
CODE = (Label(CODE_LABELS, ":=#", True, True, CODE_LABELS, (*CODE_LABELS, "security code")), Label(CODE_PHRASES, ":=#", False, True))


def ended_by(words: tuple[str, ...]) -> str:
    """A pattern of ' w1 w2 ' that ends in one of the labels."""
    return f" (?:{'|'.join(words)}) $"


def _left(b: Column, start: Column) -> Column:
    """struct<link,head,words> of the text before a place: the blanks and marks it ends in, what stands before them, and that one's last words."""
    near = S.before(b, start, NEAR)
    text = F.when((start <= NEAR) | (F.regexp_count(near, F.lit(S.singly("[0-9A-Za-z_]+"))) > 6), near).otherwise(F.substring(b["text"], F.lit(1), start))

    def parted(t: Column) -> Column:
        link = F.regexp_extract(t, S.singly("[^0-9A-Za-z_]*\\z"), 0)
        head = F.substring(t, F.lit(1), F.length(t) - F.length(link))
        words = F.regexp_extract_all(F.lower(head), F.lit(S.singly("[0-9a-z_]+")), F.lit(0))
        last = F.array_join(F.slice(words, F.greatest(F.size(words) - 4, F.lit(1)), 5), " ")
        return F.struct(link.alias("link"), head.alias("head"), F.concat(F.lit(" "), last, F.lit(" ")).alias("words"))

    return S.let(text, parted)


def _right(b: Column, end: Column) -> Column:
    """The text behind a place: NEAR characters, or all where these are blanks alone."""
    near = S.after(b, end, NEAR)
    return F.when(near.rlike("^[ \\t]{%d}" % NEAR), F.substring(b["text"], end + 1, F.length(b["text"]))).otherwise(near)


def _labelled_before(left: Column, label: Label) -> Column:
    link = left["link"]
    marks = F.translate(link, " \t", "")
    plain = (F.length(link) <= LINK) & (F.translate(marks, label.marks, "") == "")
    if label.below:
        plain = plain | (marks.isin(":\n", ":\r\n") & (F.length(F.substring_index(link, "\n", -1)) <= INDENT))
    named = left["words"].rlike(ended_by(label.words)) & plain
    if label.verb:
        verb = left["head"].rlike(S.singly("[0-9A-Za-z_.][ \\t]+[iI][sS]\\z")) & left["words"].rlike(ended_by(tuple(f"{w} is" for w in label.words)))
        named = named | (verb & marks.isin("", ":", "="))
    return named


def _labelled_after(right: Column, label: Label) -> Column:
    inner = F.regexp_extract(right, "^[ \\t]{0,2}[(]([^()\n]*)[)]", 1)
    parted = lambda t: F.trim(F.regexp_replace(F.lower(t), S.singly("[^0-9a-z_]+"), " "))
    said = F.concat(parted(F.substring(F.ltrim(F.translate(right, "\t", " ")), 1, NEAR)), F.lit(" "))
    return parted(inner).isin(*label.after) | (right.rlike("^[ \\t]+[iI][sS][ \\t]") & said.rlike(f"^is (?:my )?(?:{'|'.join(label.said)}) "))


def labelled(text: Column, found: Column, *groups: tuple[Label, ...]) -> Column:
    """array<struct<s,k>>: the spans of found in a text that have a label beside them, and which group of labels is the first to have it."""

    def held(b: Column) -> Column:
        def parted(s: Column) -> Column:
            return F.struct(s.alias("s"), _left(b["own"], s["start"]).alias("left"), _right(b["own"], s["end"]).alias("right"))

        def grouped(x: Column) -> Column:
            k = F.coalesce(*[F.when(_any([_labelled_before(x["left"], label) for label in labels] + [_labelled_after(x["right"], label) for label in labels if label.after]), i) for i, labels in enumerate(groups)])
            return F.struct(x["s"].alias("s"), k.alias("k"))

        return F.filter(F.transform(F.transform(b["found"], parted), grouped), lambda y: y["k"].isNotNull())

    return S.beside(text, found, held)


def _spans(named: Column) -> Column:
    return F.transform(named, lambda x: x["s"])


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def padded_words(text: Column) -> Column:
    """' w1 w2 ' of the lower-cased runs of ASCII letters and digits."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), S.singly("[^0-9a-z]+"), " ")), F.lit(" "))


def has_term(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether one of the terms stands in the text as whole words in a row."""
    own, found = padded_words(text), F.lit(False)
    for term in terms:
        found = found | own.contains(f" {term} ")
    return found


def card_numbers(text: Column) -> Column:
    """Digits of the card numbers in a text: 13 to 19 of them from the start of a group of a run of groups, that pass the Luhn check. A group
    has a digit at least, so nineteen groups hold all that a number from their start can have."""
    runs = F.regexp_extract_all(text, F.lit("[0-9]+(?:[ -][0-9]+)*"), F.lit(0))

    def of_run(run: Column) -> Column:
        def from_groups(g: Column) -> Column:
            ahead = F.transform(g, lambda _, i: F.substring(F.array_join(F.slice(g, i + 1, 19), ""), 1, 19))
            some = F.flatten(F.transform(F.filter(ahead, lambda d: F.length(d) >= 13), lambda d: F.transform(F.sequence(F.lit(13), F.length(d)), lambda n: F.substring(d, F.lit(1), n))))
            return F.filter(some, T.luhn)

        return S.let(F.split(run, "[ -]"), from_groups)

    return F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= 13), of_run)))


def _fields(value: Column) -> Column:
    return F.split(value, "\\s?[/.-]\\s?")


def _number(text: Column, low: int, high: int) -> Column:
    return (F.length(text) <= 2) & F.coalesce(text.try_cast("int").between(low, high), F.lit(False))


def _month_named(value: Column) -> Column:
    """Whether a value begins with a month's name or its first letters."""
    return F.lower(F.regexp_extract(value, "^[A-Za-z]+", 0)).isin(*MONTHS, *(m[:3] for m in MONTHS), "sept")


def _birth_date(value: Column) -> Column:
    """Year, month, day; month, day, year; day, month, year; a named month, day and year; eight digits."""

    def fields(f: Column) -> Column:
        a, b, c = (F.get(f, i) for i in range(3))
        year = F.length(c).between(2, 4)
        month_first, day_first = _number(a, 1, 12) & _number(b, 1, 31), (F.length(a) <= 2) & _number(b, 1, 12)
        return (F.size(f) == 3) & (((F.length(a) == 4) & _number(b, 1, 12) & _number(c, 1, 31)) | ((month_first | day_first) & year))

    compact = value.rlike("^(?:19|20)[0-9]{6}$") & _number(F.substring(value, 5, 2), 1, 12) & _number(F.substring(value, 7, 2), 1, 31)
    return S.let(_fields(value), fields) | compact | (_month_named(value) & value.rlike("[0-9][a-z]{0,2},?\\s+[0-9]{4}$"))


def _expiry(value: Column) -> Column:
    """Month and year of two or four digits, with '/' or '-' between; a named month and year."""
    fields = lambda f: (F.size(f) == 2) & _number(F.get(f, 0), 1, 12) & F.length(F.get(f, 1)).isin(2, 4) & ~value.contains(".")
    return S.let(_fields(value), fields) | (_month_named(value) & value.rlike("^[A-Za-z]+[\\s-](?:[0-9]{2}|[0-9]{4})$"))


#: What may not follow a date: more of a word or number, and a further field; a time may.
_GOES_ON = "^(?:[A-SU-Za-su-z0-9_]|[Tt](?:$|[^0-9]|[0-9]{1,2}(?:$|[^0-9:]|:$|:[^0-9]))|[ \\t]*[/.-][ \\t]*[0-9])"


def _dates(text: Column, entity: str, good) -> Column:
    found = S.find(text, DATES, entity, SCORE)

    def clean(b: Column) -> Column:
        return F.filter(b["found"], lambda s: good(s["value"]) & ~S.after(b["own"], s["end"], NEAR).rlike(S.singly(_GOES_ON)))

    return S.beside(text, found, clean)


def birth_dates(text: Column) -> Column:
    return _spans(labelled(text, _dates(text, "DATE_OF_BIRTH", _birth_date), BIRTH))


def expiries(text: Column) -> Column:
    """Expiry dates: after 'exp' only near a card; the label says a credit card's only with a card number or a term beyond doubt near."""

    def around(b: Column, s: Column) -> Column:
        first = F.greatest(s["start"] - (WINDOW + LABEL), F.lit(0))
        return S.between(b, first, s["end"] + WINDOW - first)

    def judged(b: Column) -> Column:
        near = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), around(b["own"], x["s"]).alias("near"))
        told = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), has_term(x["near"], CARD_TERMS).alias("card"), (has_term(x["near"], PAYMENT_TERMS) | (F.size(card_numbers(x["near"])) > 0)).alias("sure"))
        kept = F.filter(F.transform(F.transform(b["found"], near), told), lambda x: (x["k"] == 0) | x["card"] | x["sure"])
        return F.transform(kept, lambda x: x["s"].withField("entity", F.when(x["sure"], "CREDIT_CARD_EXPIRATION").otherwise(x["s"]["entity"])))

    found = labelled(text, _dates(text, "EXPIRATION_DATE", _expiry), VALID, EXPIRES)
    return S.beside(text, found, judged)


def security_codes(text: Column) -> Column:
    found = S.find(text, CODES, "CVV", SCORE)
    clean = lambda b: F.filter(b["found"], lambda s: ~S.after(b["own"], s["end"], 1).rlike(S.singly("[0-9A-Za-z_]")))
    return _spans(labelled(text, S.beside(text, found, clean), CODE))


#: Percent escapes of ASCII, how often they may be nested, and the kind of a decoded text's parts.
ESCAPE = S.singly("%[0-7][0-9A-Fa-f]")
DECODINGS = 4
_PARTS = "array<array<struct<at:int,orig:int,raw:boolean>>>"


def _credential_name(left: Column) -> Column:
    """Whether a text ends in a credential's name, with or without a closing quote and blanks behind it: a whole one, or behind '-'."""
    run = F.regexp_extract(left, S.singly("([0-9A-Za-z_-]+)[\"']?[ \\t]*\\z"), 1)

    def judged(words: Column) -> Column:
        tails = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.size(words) - n + 1, n), "-"))
        return F.exists(tails, lambda t: t.isin(*names_spelt()) | (F.regexp_extract(t, "^[0-9a-z]+_([a-z]+)$", 1).isin(*CREDENTIAL_ENDINGS)))

    return S.let(F.split(F.lower(run), "-"), judged)


def _as_it_stands(text: Column) -> Column:
    """Values of named parameters, the word of a scheme before them left out, and user:password before a host."""
    separators = S.find(text, "()([=:])", "URL_CREDENTIAL", SCORE)
    userinfo = S.where(F.when(text.contains("://"), S.find(text, USERINFO, "URL_CREDENTIAL", SCORE)).otherwise(S.no_spans()), lambda s: s["value"].rlike("^[^:]*:.."))

    def judged(b: Column) -> Column:
        own = b["own"]

        def named(s: Column) -> Column:
            near = S.before(own, s["start"], NEAR)
            enough = (s["start"] <= NEAR) | near.rlike(S.singly("[^0-9A-Za-z_-][0-9A-Za-z_-]+[\"']?[ \\t]*\\z")) | near.rlike(S.singly("[^0-9A-Za-z_ \\t\"'-][\"']?[ \\t]*\\z"))
            return _credential_name(F.when(enough, near).otherwise(F.substring(own["text"], F.lit(1), s["start"])))

        def valued(s: Column) -> Column:
            near = S.after(own, s["end"], NEAR)
            cut = (F.length(near) == NEAR) & (F.length(F.regexp_extract(near, S.singly(_VALUE), 0)).isin(0, NEAR))
            tail = F.when(cut, F.substring(own["text"], s["end"] + 1, F.length(own["text"]))).otherwise(near)

            def read(m: Column) -> Column:
                schemed = F.lower(m["first"]).isin(*SCHEMES) & (F.length(m["second"]) >= 2)
                start = s["end"] + F.length(m["lead"]) + F.when(schemed, F.length(m["first"]) + F.length(m["gap"])).otherwise(0)
                value = F.when(schemed, m["second"]).otherwise(m["first"])
                return s.withField("start", start).withField("end", start + F.length(value)).withField("value", value)

            return S.let(F.struct(*[F.regexp_extract(tail, S.singly(_VALUE), i).alias(n) for i, n in enumerate(("lead", "first", "gap", "second"), 1)]), read)

        values = F.filter(F.transform(F.filter(b["found"], named), valued), lambda s: F.length(s["value"]) >= 2)
        reach = lambda v: S.applied(S.running_most_sql("b.a"), a=F.transform(v, lambda s: s["end"]))
        outer = lambda v: F.zip_with(v, reach(v), lambda s, until: F.when(s["start"] >= until, s))
        return F.array_compact(S.let(values, outer))

    found = S.beside(text, separators, judged)
    return F.concat(F.when(text.rlike(S.singly(CREDENTIAL_GUARD)), found).otherwise(S.no_spans()), userinfo)


#: Letters of which some stand in every credential's name.
CREDENTIAL_GUARD = "(?i)(?:" + "|".join(("access", "api_?-?key", "assertion", "auth", "bearer", "secret", "credential", "csrf", "xsrf", "token", "jwt", "otp", "pass", "pat", "key", "pwd", "saml", "sas", "session", "sid", "sig")) + ")[0-9a-z_-]*[\"']?[ \\t]*[=:]"


def _decoded(text: Column) -> Column:
    """struct<text,parts>: the text with its ASCII escapes decoded once, and blocks of its parts: where each begins (at) and began (orig). Within
    a raw part places move together; the last part is empty and stands for the end."""

    def placed(p: Column) -> Column:
        parts = F.zip_with(F.arrays_zip(p["at"], p["orig"]), p["raw"], lambda x, raw: F.struct(x["at"].alias("at"), x["orig"].alias("orig"), raw.alias("raw")))
        block = lambda q: F.transform(F.sequence(F.lit(0), F.size(q) - 1, F.lit(256)), lambda i: F.slice(q, i + 1, 256))
        return F.struct(p["text"].alias("text"), S.let(parts, block).alias("parts"))

    def summed(d: Column) -> Column:
        lengths = lambda a: S.running_sums(F.concat(F.transform(a, F.length), F.array(F.lit(0))))
        raw = F.concat(F.transform(d["pieces"], lambda x: ~x.rlike(f"^{ESCAPE}$")), F.array(F.lit(True)))
        return S.let(F.struct(F.array_join(d["plain"], "").alias("text"), lengths(d["plain"]).alias("at"), lengths(d["pieces"]).alias("orig"), raw.alias("raw")), placed)

    pieces = F.regexp_extract_all(text, F.lit(f"{ESCAPE}|[^%]+|%"), F.lit(0))
    plain = lambda a: F.transform(a, lambda x: F.when(x.rlike(f"^{ESCAPE}$"), F.char(F.conv(F.substring(x, 2, 2), 16, 10).cast("int"))).otherwise(x))
    return S.let(pieces, lambda a: S.let(F.struct(a.alias("pieces"), plain(a).alias("plain")), summed))


def _place(levels: Column, at: Column) -> Column:
    """A place of the text of the last level as a place of the first text: its block is found first, then the part in it."""

    def up(p: Column, blocks: Column) -> Column:
        block = F.element_at(F.filter(blocks, lambda q: F.get(q, F.lit(0))["at"] <= p), -1)
        last = F.element_at(F.filter(block, lambda x: x["at"] <= p), -1)
        return S.let(last, lambda x: F.when(x["raw"], x["orig"] + p - x["at"]).otherwise(x["orig"]))

    return F.aggregate(F.reverse(levels), at, up)


def credentials(text: Column) -> Column:
    """Values of parameters with a credential's name, and user:password before a host: in the text as it stands and in each of up
    to DECODINGS decodings of its percent escapes, placed in the text as it stands."""
    kind = f"struct<text:string,levels:array<{_PARTS}>,found:{S.SPANS}>"

    def step(s: Column, level: Column) -> Column:
        def placed(b: Column) -> Column:
            def one(x: Column) -> Column:
                first, end = _place(s["levels"], x["start"]), _place(s["levels"], x["end"])
                return S.let(F.struct(first.alias("first"), end.alias("end")), lambda e: x.withField("start", e["first"]).withField("end", e["end"]).withField("value", S.between(b["own"], e["first"], e["end"] - e["first"])))

            return F.when(level == 0, b["found"]).otherwise(F.transform(b["found"], one))

        found = S.let(F.struct(S.held(text, level > 0).alias("own"), _as_it_stands(s["text"]).alias("found")), placed)

        def on(found: Column) -> Column:
            deeper = lambda d: F.struct(d["text"].alias("text"), F.array_append(s["levels"], d["parts"]).alias("levels"), found.alias("found"))
            more = F.struct(F.lit("").alias("text"), s["levels"].alias("levels"), found.alias("found"))
            return F.when(s["text"].contains("%") & s["text"].rlike(ESCAPE), S.let(_decoded(s["text"]), deeper)).otherwise(more)

        return S.let(F.concat(s["found"], found), on)

    start = F.struct(text.alias("text"), F.array().cast(f"array<{_PARTS}>").alias("levels"), S.no_spans().alias("found")).cast(kind)
    levels = F.sequence(F.lit(0), F.when(text.contains("%") & text.rlike(ESCAPE), DECODINGS).otherwise(0))
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))
    return S.let(F.array_sort(F.aggregate(levels, start, step, lambda s: s["found"])), once)

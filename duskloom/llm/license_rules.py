"""Signature rules for licence wording, in order of priority: hand-written signatures of bodies and notices, and mentions made from
a table of licences and a few ways of wording.

Patterns are written over lower-case words with one blank between them; punctuation is no word, so "CC BY-NC 4.0" reads
"cc by nc 4 0". They use no look-around, so that any regular-expression engine runs them alike.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from .license_signatures import BODIES


class Rule(NamedTuple):
    priority: int  # 1 first
    label: str
    keyword: str  # a word that every match has
    pattern: str


#: Confidence of a detection by its priority: tag; grant, body or notice; name with version; bare name.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.6}

#: label, keyword, name as a pattern, words that may end the name, versions.
#: The name alone, or with its ending, is a mention; a version makes a label of its own.
LICENCES: list[tuple[str, str, str, str, tuple[str, ...]]] = [
    ("mit", "mit", "(?:mit|expat mit)", "licen[cs]e", ()),
    ("mit-0", "mit", "mit (?:0|no attribution)", "licen[cs]e", ()),
    ("x11", "x11", "(?:mit )?x11", "licen[cs]e", ()),
    ("apache", "apache", "apache(?: software)?", "licen[cs]e", ("1.0", "1.1", "2.0")),
    ("gpl", "general", "(?:gnu )?general public", "licen[cs]e", ("1", "2", "3", "2.0", "3.0")),
    ("gpl", "gpl", "(?:gnu )?gpl", "licen[cs]e", ("1", "2", "3", "2.0", "3.0")),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public", "licen[cs]e", ("2", "2.0", "2.1", "3", "3.0")),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "licen[cs]e", ("2", "2.0", "2.1", "3", "3.0")),
    ("agpl", "affero", "(?:gnu )?affero general public", "licen[cs]e", ("1", "3", "3.0")),
    ("agpl", "agpl", "(?:gnu )?agpl", "licen[cs]e", ("1", "3", "3.0")),
    ("gfdl", "documentation", "(?:gnu )?free documentation", "licen[cs]e", ("1.1", "1.2", "1.3")),
    ("bsd", "bsd", "bsd", "licen[cs]e", ()),
    ("bsd-0-clause", "bsd", "(?:0 clause bsd|bsd 0 clause|zero clause bsd)", "licen[cs]e", ()),
    ("bsd-1-clause", "bsd", "(?:1 clause bsd|bsd 1 clause)", "licen[cs]e", ()),
    ("bsd-2-clause", "bsd", "(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd bsd)", "licen[cs]e", ()),
    ("bsd-3-clause", "bsd", "(?:3 clause bsd|bsd 3 clause|modified bsd|new bsd|revised bsd)", "licen[cs]e", ()),
    ("bsd-4-clause", "bsd", "(?:4 clause bsd|bsd 4 clause|original bsd|old bsd)", "licen[cs]e", ()),
    ("isc", "isc", "(?:isc|internet systems consortium isc)", "licen[cs]e", ()),
    ("mpl", "mozilla", "mozilla public", "licen[cs]e", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", "mpl", "licen[cs]e", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", "eclipse public", "licen[cs]e", ("1.0", "2.0")),
    ("edl", "eclipse", "eclipse distribution", "licen[cs]e", ("1.0",)),
    ("cpl", "common", "common public", "licen[cs]e", ("1.0",)),
    ("ipl", "ibm", "ibm public", "licen[cs]e", ("1.0",)),
    ("cddl", "cddl", "cddl", "licen[cs]e", ("1.0", "1.1")),
    ("cddl", "distribution", "common development and distribution", "licen[cs]e", ("1.0", "1.1")),
    ("cc-by", "cc", "cc by", "licen[cs]e", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "cc", "cc by sa", "licen[cs]e", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "cc", "cc by nd", "licen[cs]e", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "cc", "cc by nc", "licen[cs]e", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "cc", "cc by nc sa", "licen[cs]e", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", "cc", "cc by nc nd", "licen[cs]e", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by", "commons", "creative commons attribution", "(?:international |unported )?licen[cs]e", ("2.0", "3.0", "4.0")),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike", "(?:international |unported )?licen[cs]e", ("2.0", "3.0", "4.0")),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial", "(?:international |unported )?licen[cs]e", ("2.0", "3.0", "4.0")),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:s|atives)", "(?:international |unported )?licen[cs]e", ("2.0", "3.0", "4.0")),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike", "(?:international |unported )?licen[cs]e", ("2.0", "3.0", "4.0")),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv(?:s|atives)", "(?:international |unported )?licen[cs]e", ("2.0", "3.0", "4.0")),
    ("creative-commons", "commons", "creative commons", "licen[cs]e", ()),
    ("cc0", "cc0", "cc0", "(?:universal|licen[cs]e|public domain dedication)", ("1.0",)),
    ("public-domain", "domain", "public domain", "dedication", ()),
    ("unlicense", "unlicense", "(?:the )?unlicense", "licen[cs]e", ()),
    ("wtfpl", "wtfpl", "wtfpl", "licen[cs]e", ("1", "2")),
    ("zlib", "zlib", "zlib", "licen[cs]e", ()),
    ("libpng", "libpng", "(?:zlib )?libpng", "licen[cs]e", ("2.0",)),
    ("bsl-1.0", "boost", "boost software", "licen[cs]e", ()),
    ("artistic", "artistic", "(?:perl )?artistic", "licen[cs]e", ("1.0", "2.0")),
    ("psf", "python", "python(?: software foundation)?", "licen[cs]e", ("2", "2.0")),
    ("ruby", "ruby", "ruby", "licen[cs]e", ()),
    ("php", "php", "php", "licen[cs]e", ("3.0", "3.01")),
    ("postgresql", "postgresql", "postgresql", "licen[cs]e", ()),
    ("openssl", "openssl", "openssl", "licen[cs]e", ()),
    ("eupl", "eupl", "eupl", "licen[cs]e", ("1.0", "1.1", "1.2")),
    ("eupl", "european", "european union public", "licen[cs]e", ("1.0", "1.1", "1.2")),
    ("ms-pl", "microsoft", "microsoft public", "licen[cs]e", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal", "licen[cs]e", ()),
    ("ofl", "font", "(?:sil )?open font", "licen[cs]e", ("1.0", "1.1")),
    ("odbl", "database", "open database", "licen[cs]e", ("1.0",)),
    ("odc-by", "odc", "odc attribution", "licen[cs]e", ("1.0",)),
    ("pddl", "pddl", "(?:odc )?pddl", "licen[cs]e", ("1.0",)),
    ("afl", "academic", "academic free", "licen[cs]e", ("1.1", "2.0", "2.1", "3.0")),
    ("osl", "software", "open software", "licen[cs]e", ("1.0", "2.0", "2.1", "3.0")),
    ("ecl", "educational", "educational community", "licen[cs]e", ("1.0", "2.0")),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", "licen[cs]e", ()),
    ("vim", "vim", "vim", "licen[cs]e", ()),
    ("w3c", "w3c", "w3c(?: software)?(?: notice and)?", "licen[cs]e", ()),
    ("unicode", "unicode", "unicode", "licen[cs]e(?: agreement)?", ("3",)),
    ("curl", "curl", "curl", "licen[cs]e", ()),
    ("busl", "business", "business source", "licen[cs]e", ("1.0", "1.1")),
    ("sspl", "server", "server side public", "licen[cs]e", ("1",)),
    ("elastic", "elastic", "elastic", "licen[cs]e", ("1", "2.0")),
    ("commons-clause", "clause", "commons clause", "licen[cs]e condition", ("1.0",)),
    ("mulan-psl", "mulan", "mulan (?:permissive software|psl)", "licen[cs]e", ("1", "2")),
    ("cecill", "cecill", "cecill(?: free software)?", "licen[cs]e(?: agreement)?", ("1.0", "2.0", "2.1")),
    ("qpl", "public", "q public", "licen[cs]e", ("1.0",)),
    ("sleepycat", "sleepycat", "sleepycat", "licen[cs]e", ()),
    ("beerware", "beerware", "beerware", "licen[cs]e", ()),
    ("zpl", "zope", "zope public", "licen[cs]e", ("2.0", "2.1")),
    ("lppl", "latex", "latex project public", "licen[cs]e", ("1.0", "1.3", "1.3c")),
    ("json", "json", "json", "licen[cs]e", ()),
    ("icu", "icu", "icu", "licen[cs]e", ()),
    ("nasa", "nasa", "nasa open source", "(?:licen[cs]e )?agreement", ("1.3",)),
    ("apsl", "apple", "apple public source", "licen[cs]e", ("1.0", "1.1", "1.2", "2.0")),
    ("sissl", "sun", "sun industry standards source", "licen[cs]e", ("1.1", "1.2")),
    ("spl", "sun", "sun public", "licen[cs]e", ("1.0",)),
    ("nokia", "nokia", "nokia open source", "licen[cs]e", ("1.0",)),
    ("rpl", "reciprocal", "reciprocal public", "licen[cs]e", ("1.1", "1.5")),
    ("upl", "universal", "universal permissive", "licen[cs]e", ("1.0",)),
    ("blueoak", "oak", "blue oak model", "licen[cs]e", ("1.0.0",)),
    ("ftl", "freetype", "freetype(?: project)?", "licen[cs]e", ()),
    ("hpnd", "historical", "historical permission notice and disclaimer", "licen[cs]e", ()),
    ("parity", "parity", "parity public", "licen[cs]e", ("6.0.0", "7.0.0")),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|strict|shield)", "licen[cs]e", ("1.0.0",)),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail(?: m)?", "licen[cs]e", ()),
]

_GRANT = "(?:(?:re)?licen[cs]ed|released|(?:re)?distributed|available|published|provided|covered|made available) under (?:the )?(?:terms of (?:the )?)?(?:an? )?"


def _words(version: str) -> str:
    return version.replace(".", " ")


#: A word that is no operator of an expression of ids.
_NO_OPERATOR = "(?:[b-np-vx-z0-9][a-z0-9]*|a(?:[a-mo-z0-9][a-z0-9]*|n(?:[a-ce-z0-9][a-z0-9]*|d[a-z0-9]+)?)?|o(?:[a-qs-z0-9][a-z0-9]*|r[a-z0-9]+)?|w(?:[a-hj-z0-9][a-z0-9]*|i(?:[a-su-z0-9][a-z0-9]*|t(?:[a-gi-z0-9][a-z0-9]*|h[a-z0-9]+)?)?)?)"


def _tags(label: str) -> list[Rule]:
    """A tag with a licence's id, alone or first; second in an expression, in a lower priority, so that it doesn't suppress the first."""
    own, tag = _words(label).replace("-", " "), "spdx licen[cs]e identifier"
    return [Rule(1, label, own.split(" ")[0], f"{tag} {own}(?: (?:only|or later))?"), Rule(2, label, own.split(" ")[0], f"{tag}(?: {_NO_OPERATOR}){{1,6}} (?:or|and|with) {own}(?: (?:only|or later))?")]


def _rules(licence: tuple[str, str, str, str, tuple[str, ...]]) -> list[Rule]:
    label, keyword, name, ending, versions = licence
    tag = f"spdx licen[cs]e identifier {name}"
    rules = [
        Rule(1, label, keyword, tag),
        *_tags(label),
        Rule(2, label, keyword, f"{_GRANT}{name}(?: {ending})?"),
        Rule(4, label, keyword, f"{name} {ending}"),
    ]
    for version in versions:
        own = f"{label}-{version}"
        number = f"(?: {ending})?(?: (?:version|v))? v?{_words(version)}(?: {ending})?"
        rules += [
            Rule(1, own, keyword, f"{tag} {_words(version)}(?: (?:only|or later))?"),
            *_tags(own),
            Rule(2, own, keyword, f"{_GRANT}{name}{number}"),
            Rule(3, own, keyword, f"{name} {ending}(?: (?:version|v))? v?{_words(version)}"),
            Rule(3, own, keyword, f"{name}(?: (?:version|v))? v?{_words(version)} {ending}"),
        ]
    return rules


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """Every rule, the first priority first."""
    families = {label for label, *_ in BODIES} - {label for label, *_ in LICENCES}
    found = [rule for licence in LICENCES for rule in _rules(licence)] + [Rule(2, *body) for body in BODIES] + [rule for label in sorted(families) for rule in _tags(label)]
    return tuple(sorted(dict.fromkeys(found), key=lambda r: r.priority))


def spaced(pattern: str) -> str:
    """The pattern over text in which each word has a blank of its own on either side; ' ?' allows the words to be one."""
    joined = "(?:\0)?"
    return f" (?:{pattern.replace(' ?', joined).replace(' ', '  ').replace(chr(0), '  ')}) "

"""Recognizers as patterns that Java's and RE2's regular expressions read alike: no look-around, no \\b, no \\d.

Group 1 is what must stand before a value, group 2 is the value. Shapes and checksums are the published ones of each
kind of number; a validator cuts what a pattern alone lets through.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .spans import Search, after, beside, singly


class Recognizer(NamedTuple):
    entity: str
    pattern: str
    score: float
    context: tuple[str, ...] = ()
    guard: str | tuple[str, ...] = ""  # a cheap pattern, or literals of which one stands in every text with a match

    @property
    def plain(self) -> str:
        """The pattern without possessive quantifiers, which RE2 doesn't know; where one is used, it changes the cost alone."""
        return self.pattern.replace("++", "+")

    def search(self, order: int = 0) -> Search:
        return Search(self.pattern, self.entity, self.score, order=order, guard=self.guard)





_START = "(^|[^0-9A-Za-z_])"

EMAIL = Recognizer("EMAIL_ADDRESS", r"(^|[^0-9\p{L}\p{M}._%+-])([0-9\p{L}\p{M}._%+-]++@[0-9\p{L}\p{M}-]+(?:\.[0-9\p{L}\p{M}-]+)*\.\p{L}{2,24})", 1.0, guard=("@",))
PHONE = Recognizer("PHONE_NUMBER", r"(^|[^0-9A-Za-z+])(\+?(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4,})", 0.4, ("phone", "number", "telephone", "cell", "cellphone", "mobile", "call", "tel", "fax"), guard="[0-9]{3}[ .-]?[0-9]{4}")
CARD = Recognizer("CREDIT_CARD", r"(^|[^0-9A-Za-z])([0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7})", 0.85, guard="[0-9]{4}")
IPV4 = Recognizer("IP_ADDRESS", r"(^|[^0-9A-Za-z.])([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", 0.85, guard="[0-9][.][0-9]")
IPV6 = Recognizer("IP_ADDRESS", r"(^|[^0-9A-Za-z:])([0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){1,7}(?:::)?)", 0.6, guard="[0-9A-Fa-f]:[0-9A-Fa-f:]")
MAC = Recognizer("MAC_ADDRESS", r"(^|[^0-9A-Za-z:-])([0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5})", 0.85, guard="[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]")
URL = Recognizer("URL", r"(^|[^0-9A-Za-z])((?:https?|ftp)://[^ \t\r\n<>]+)", 0.6, guard=("://",))
DOMAIN = Recognizer("DOMAIN", r"(^|[^0-9A-Za-z@._/-])((?:[0-9A-Za-z-]++\.)+[0-9A-Za-z-]+)", 0.5, guard="[.][A-Za-z]{2}")
IBAN = Recognizer("IBAN_CODE", _START + r"([A-Z]{2}[0-9]{2}[0-9A-Z]{11,30})", 0.85, ("iban", "bank", "account"), guard="[A-Z]{2}[0-9]{2}[0-9A-Z]{11}")
SSN = Recognizer("US_SSN", r"(^|[^0-9A-Za-z-])([0-9]{3}-[0-9]{2}-[0-9]{4})", 0.5, ("social", "security", "ssn", "ssns", "ssid"), guard="[0-9]{3}-[0-9]{2}-[0-9]")
ITIN = Recognizer("US_ITIN", r"(^|[^0-9A-Za-z-])(9[0-9]{2}-[5-9][0-9]-[0-9]{4})", 0.5, ("individual", "taxpayer", "itin", "tax", "payer", "taxid", "tin"), guard="9[0-9]{2}-[5-9]")
ABA = Recognizer("ABA_ROUTING_NUMBER", r"(^|[^0-9A-Za-z])([0-9]{9})", 0.05, ("aba", "routing", "bankrouting", "abarouting"), guard="[0-9]{9}")
BANK = Recognizer("US_BANK_NUMBER", r"(^|[^0-9A-Za-z])([0-9]{8,17})", 0.05, ("check", "account", "acct", "bank", "save", "debit"), guard="[0-9]{8}")
DEA = Recognizer("MEDICAL_LICENSE", _START + r"([ABCDEFGHJKLMPRSTUXabcdefghjklmprstux][A-Za-z9][0-9]{7})", 0.4, ("medical", "certificate", "dea"), guard="[0-9]{7}")
NPI = Recognizer("US_NPI", r"(^|[^0-9A-Za-z])([12][0-9]{9})", 0.1, ("npi", "provider"), guard="[12][0-9]{9}")
MBI = Recognizer("US_MBI", _START + r"([1-9][AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y][0-9]-?[AC-HJKMNP-RT-Y][0-9AC-HJKMNP-RT-Y][0-9]-?[AC-HJKMNP-RT-Y]{2}[0-9]{2})", 0.5, ("medicare", "mbi", "beneficiary"), guard="[1-9][A-Z][0-9A-Z][0-9]")
NHS = Recognizer("UK_NHS", r"(^|[^0-9A-Za-z])([0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4})", 0.5, ("national", "health", "service", "nhs"), guard="[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4}")
NINO = Recognizer("UK_NINO", _START + r"([A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D])", 0.5, ("national", "insurance", "ni", "nino"), guard="[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2}")
US_PASSPORT = Recognizer("US_PASSPORT", _START + r"([A-Z][0-9]{8})", 0.1, ("passport", "travel", "document"), guard="[A-Z][0-9]{8}")
UK_PASSPORT = Recognizer("UK_PASSPORT", _START + r"([A-Z]{2}[0-9]{7})", 0.1, ("passport", "travel", "document"), guard="[A-Z]{2}[0-9]{7}")
US_DRIVER_LICENSE = Recognizer("US_DRIVER_LICENSE", _START + r"([A-Z][0-9]{6,12})", 0.3, ("driver", "license", "permit", "lic", "identification", "dl"), guard="[A-Z][0-9]{6}")
UK_DRIVING_LICENCE = Recognizer("UK_DRIVING_LICENCE", _START + r"([A-Z]{5}[0-9]{6}[A-Z]{2}[0-9][A-Z]{2})", 0.5, ("driving", "licence"), guard="[A-Z]{5}[0-9]{6}")
API_KEY = Recognizer("API_KEY", _START + r"([0-9A-Za-z_-]{32,128})", 0.55, guard="[0-9A-Za-z_-]{32}")
PREFIXED_KEY = Recognizer("API_KEY", _START + r"((?:ghp|gho|ghs|ghu)_[0-9A-Za-z]{36}|sk_live_[0-9A-Za-z]{16,64}|xox[abprs]-[0-9A-Za-z-]{10,80}|glpat-[0-9A-Za-z_-]{20})", 0.95, guard=("ghp_", "gho_", "ghs_", "ghu_", "sk_live_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "glpat-"))
AWS_ACCESS_KEY = Recognizer("AWS_ACCESS_KEY", _START + r"((?:AKIA|ASIA)[0-9A-Z]{16})", 0.95, guard=("AKIA", "ASIA"))
GCP_API_KEY = Recognizer("GCP_API_KEY", _START + r"(AIza[0-9A-Za-z_-]{35})", 0.95, guard=("AIza",))
JWT = Recognizer("JWT", _START + r"(eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})", 0.95, guard=("eyJ",))
PRIVATE_KEY = Recognizer("PRIVATE_KEY", r"()(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[0-9A-Za-z+/= \r\n]+-----END (?:[A-Z]+ )*PRIVATE KEY-----)", 1.0, guard=("PRIVATE KEY-----",))
CRYPTO = Recognizer("CRYPTO", _START + r"([13][1-9A-HJ-NP-Za-km-z]{25,34})", 0.5, ("wallet", "btc", "bitcoin", "crypto"), guard="[13][1-9A-HJ-NP-Za-km-z]{25}")

AWS_SECRET_KEY = Recognizer("AWS_SECRET_KEY", r"((?:aws_secret_access_key|aws_session_token|AWS_SECRET_ACCESS_KEY|AWS_SESSION_TOKEN)[\"']?[ \t]*[=:][ \t]*[\"']?)([0-9A-Za-z+/=]{16,})", 0.95, guard=("aws_se", "AWS_SE"))
AZURE_KEY = Recognizer("AZURE_KEY", r"((?:AccountKey|SharedAccessKey)=)([0-9A-Za-z+/]{40,}={0,2})", 0.95, guard=("AccountKey=", "SharedAccessKey="))
PASSPORT = Recognizer("PASSPORT", _START + r"([A-Z0-9]{1,2}[0-9]{6,8})", 0.06, ("passport",), guard="[0-9]{6}")
DRIVER_LICENSE = Recognizer("DRIVER_LICENSE", _START + r"([0-9]{7,12})", 0.06, ("driver", "drivers", "licence", "license"), guard="[0-9]{7}")
NATIONAL_ID = Recognizer("NATIONAL_ID", _START + r"([0-9A-Z]{0,2}[0-9]{7,12}[A-Z]?)", 0.06, ("nationalid", "identity", "dni", "nif", "nric", "aadhaar"), guard="[0-9]{7}")

#: Last labels of names that count as hosts.
TOP_LABELS = ("com", "org", "net", "io", "dev", "edu", "gov", "info", "co", "de", "fr", "es", "uk", "eu", "rs", "md", "py", "sh", "ai", "app")

#: entity -> a pattern that must not match the two characters behind a value: it would be a part of something longer.
_WORD_ON = "^[0-9A-Za-z_]"
GOES_ON: dict[str, str] = {
    **dict.fromkeys(("US_SSN", "US_ITIN", "IBAN_CODE", "ABA_ROUTING_NUMBER", "US_BANK_NUMBER", "MEDICAL_LICENSE", "US_NPI", "US_MBI", "UK_NHS", "UK_NINO", "US_PASSPORT", "UK_PASSPORT", "US_DRIVER_LICENSE", "UK_DRIVING_LICENCE",
      "PASSPORT", "DRIVER_LICENSE", "NATIONAL_ID", "CRYPTO", "CREDIT_CARD"), f"{_WORD_ON}|^-[0-9]"),
    "DOMAIN": "^[_@(]", "IP_ADDRESS": "^[0-9A-Za-z_]|^[.][0-9]|^:[0-9A-Fa-f:]", "MAC_ADDRESS": "^[0-9A-Za-z_]|^[:-][0-9A-Fa-f]",
}

#: Numbers known from documentation, never real.
SAMPLE_SSNS = ("078-05-1120", "219-09-9999", "123-45-6789")


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)


def _groups(value: Column) -> Column:
    """Eight groups, or fewer about one '::', of which two alone must have a digit between them."""
    gaps = (F.length(value) - F.length(F.replace(value, F.lit("::"), F.lit("")))) / 2
    n = F.size(F.filter(F.split(value, ":+"), lambda g: g != ""))
    return ((gaps == 0) & (n == 8)) | ((gaps == 1) & (n <= 7) & (value.rlike("[0-9]") | (n >= 3)))


def _ssn(value: Column) -> Column:
    area, group, serial = F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)
    return ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000") & ~value.isin(*SAMPLE_SSNS)


def _nhs(value: Column) -> Column:
    digits = T.digits_of(value)
    check = F.pmod(11 - F.pmod(T.weighted_sum(digits, [10, 9, 8, 7, 6, 5, 4, 3, 2]), F.lit(11)), F.lit(11))
    return check == F.substring(digits, 10, 1).cast("int")


#: entity -> whether a value that has its shape passes its own check.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "CREDIT_CARD": lambda v: F.length(T.digits_of(v)).between(13, 19) & T.luhn(T.digits_of(v)),
    "PHONE_NUMBER": lambda v: F.length(T.digits_of(v)).between(10, 13),
    "IP_ADDRESS": lambda v: F.when(v.contains("."), _octets(v)).otherwise(_groups(v)),
    "DOMAIN": lambda v: F.lower(F.element_at(F.split(v, r"\."), -1)).isin(*TOP_LABELS),
    "US_SSN": _ssn,
    "IBAN_CODE": lambda v: F.length(v).between(15, 34) & (T.mod97(v) == 1),
    "ABA_ROUTING_NUMBER": lambda v: (T.weighted_sum(v, [3, 7, 1] * 3) % 10 == 0) & v.rlike("^(0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)"),
    "MEDICAL_LICENSE": lambda v: T.weighted_sum(F.substring(v, 3, 6), [1, 2, 1, 2, 1, 2]) % 10 == F.substring(v, 9, 1).cast("int"),
    "US_NPI": lambda v: T.luhn(F.concat(F.lit("80840"), v)),
    "UK_NHS": _nhs,
    "UK_NINO": lambda v: ~F.substring(v, 1, 2).isin("BG", "GB", "KN", "NK", "NT", "TN", "ZZ"),
    "CRYPTO": T.base58_check,
}


def checked(text: Column, spans: Column, entities: set[str]) -> Column:
    """The spans of a text whose values pass the check of their entity and aren't a part of something longer; generic keys must look
    generated, those with a known prefix need not."""
    ends = {e: p for e, p in GOES_ON.items() if e in entities}

    def keep(own: Column):
        def one(s: Column) -> Column:
            valid = F.coalesce(*[F.when(s["entity"] == e, check(s["value"])) for e, check in CHECKS.items() if e in entities], F.when((s["entity"] == "API_KEY") & (s["score"] == API_KEY.score), T.plausible_secret(s["value"])), F.lit(True))
            if not ends:
                return valid
            behind = after(own, s["end"], 2)
            return valid & ~F.coalesce(*[F.when(s["entity"].isin(*[e for e in ends if ends[e] == p]), behind.rlike(singly(p))) for p in sorted(set(ends.values()))], F.lit(False))

        return one

    return beside(text, spans, lambda b: F.filter(b["found"], keep(b["own"])))

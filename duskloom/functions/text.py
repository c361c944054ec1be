"""Scalar text functions: everything stays a JVM expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import singly


def chars(text: Column) -> Column:
    """The characters of a text; none for an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character, of the whole text; 0 for an empty one. Each distinct character is counted by one pass."""
    n = F.length(text)
    each = F.transform(F.array_distinct(chars(text)), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p)))


def vowel_ratio(text: Column) -> Column:
    """Share of ASCII vowels among ASCII letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit(singly("[A-Za-z]")))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.regexp_count(text, F.lit("[AEIOUaeiou]")) / letters)


def longest_lower_run(text: Column) -> Column:
    """Letters in the longest run of a-z."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0)), F.length)), F.lit(0))


#: Limits of a plausible generated secret (fixed values).
ENTROPY_FLOOR, VOWEL_CEILING, LOWER_RUN = 4.0, 0.30, 6


def plausible_secret(text: Column) -> Column:
    """Whether a generic key candidate looks generated: not all hex, random enough, of letters and digits, and not like words."""
    wordy = (vowel_ratio(text) >= VOWEL_CEILING) & (longest_lower_run(text) >= LOWER_RUN)
    return ~text.rlike(singly("^[0-9A-Fa-f]+$")) & (entropy(text) >= ENTROPY_FLOOR) & text.rlike("[A-Za-z]") & text.rlike("[0-9]") & ~wordy


def slug(name: Column) -> Column:
    """Upper-case token label of a name: other characters than ASCII letters and digits become '_', 32 at most, never empty."""
    made = F.upper(F.substring(F.regexp_replace(name, singly("[^0-9A-Za-z]"), "_"), 1, 32))
    return F.when(made == "", "_").otherwise(made)


def short_hash(*parts: Column | str, digits: int = 12) -> Column:
    """The first hex digits of the SHA-256 of parts in a row."""
    return F.substring(F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), 256), 1, digits)


def token(salt: Column | str, entity: Column | str, value: Column) -> Column:
    """The reversible placeholder: [ENTITY_ and 12 hex digits of a salted hash ]."""
    label = F.upper(F.lit(entity) if isinstance(entity, str) else entity)
    return F.concat(F.lit("["), label, F.lit("_"), short_hash(salt, label, ":", value), F.lit("]"))


def hash_mark(entity: Column | str, value: Column, salt: Column | str = "") -> Column:
    """The irreversible rendering: the colon keeps it outside the grammar of tokens."""
    label = F.upper(F.lit(entity) if isinstance(entity, str) else entity)
    return F.concat(F.lit("["), label, F.lit(":"), short_hash(salt, label, ":", value), F.lit("]"))


def keep_last(value: Column, n: int = 4, char: str = "*") -> Column:
    """All but the last n characters replaced by char."""
    hidden = F.greatest(F.length(value) - n, F.lit(0))
    return F.concat(F.repeat(F.lit(char), hidden), F.substring(value, hidden + 1, F.length(value)))


def strip_ansi(text: Column) -> Column:
    """Without CSI escape sequences; an escape that starts none goes alone."""
    return F.regexp_replace(text, "\x1b(\\[[^@-~]*[@-~]?)?", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check and isn't one digit repeated."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False)) & ~digits.rlike("^(0+|1+|2+|3+|4+|5+|6+|7+|8+|9+)$")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def weighted_sum(digits: Column, weights: list[int]) -> Column:
    """Sum of the digits by position times their weights."""
    return sum((F.substring(digits, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def mod97(text: Column) -> Column:
    """Remainder by 97 of an IBAN's digits after its first four characters moved to the end and letters became numbers."""
    moved = F.concat(F.substring(text, 5, 100), F.substring(text, 1, 4))
    number = F.transform(chars(moved), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")))
    return F.aggregate(chars(F.array_join(number, "")), F.lit(0), lambda r, c: (r * 10 + c.cast("int")) % 97)


BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58_check(text: Column) -> Column:
    """Whether a string of base-58 digits is 25 bytes of which the last four begin the doubled SHA-256 of the others."""

    def times(state: Column, digit: Column) -> Column:
        """Bytes, the lowest first, times 58 and the digit added; what the last leaves over is kept apart."""
        start = F.struct(digit.alias("carry"), F.array().cast("array<int>").alias("out"))

        def step(s: Column, b: Column) -> Column:
            n = b * 58 + s["carry"]
            return F.struct(F.shiftright(n, 8).alias("carry"), F.array_append(s["out"], n.bitwiseAND(F.lit(255))).alias("out"))

        return F.aggregate(state["bytes"], start, step, lambda s: F.struct(s["out"].alias("bytes"), (state["over"] | (s["carry"] > 0)).alias("over")))

    start = F.struct(F.array_repeat(F.lit(0), 25).alias("bytes"), F.lit(False).alias("over"))
    digits = F.transform(chars(text), lambda c: F.instr(F.lit(BASE58), c) - 1)
    spelt = lambda s: F.array_join(F.transform(F.reverse(s["bytes"]), lambda b: F.lpad(F.hex(b), 2, "0")), "")
    whole = F.aggregate(digits, start, times, lambda s: F.when(~s["over"], spelt(s)).otherwise(F.lit("")))
    twice = F.sha2(F.unhex(F.sha2(F.unhex(F.substring(whole, 1, 42)), 256)), 256)
    return F.coalesce((F.length(whole) == 50) & F.forall(digits, lambda d: d >= 0) & (F.lower(F.substring(whole, 43, 8)) == F.substring(twice, 1, 8)), F.lit(False))

"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is the list of a language's most frequent letter n-grams. A document's own list is compared with each profile
by the out-of-place distance: how many ranks each n-gram is away from its rank in the profile, or the profile's length
where it isn't in it. The nearest profile gives the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod, drawn, map_batches

#: N-grams have 1 to 3 letters, a blank before and after each word counting as one; a blank alone isn't an n-gram.
#: N-grams in a profile and in a document's list.
PROFILE = 300

#: Labelled documents of a language that a profile is learned from, about: those with the least hashes.
DOCS_A_LANGUAGE = 2000
#: Languages with a profile: those with the most labelled documents. A dirty column may name any number.
LANGUAGES = 1000

UNKNOWN = "und"

_BLANK = 32
_PLACE = 21  # bits of a letter in a packed n-gram: left-aligned, so that numbers order as strings do


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def spell(gram: int) -> str:
    """The letters of a packed n-gram."""
    return "".join(chr(c) for i in (2, 1, 0) if (c := gram >> _PLACE * i & 0x1FFFFF))


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of the lower-cased runs of letters, in order, and how often each occurs."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[_BLANK], np.where(letter, codes, _BLANK), [_BLANK]])
    codes = codes[np.concatenate([[True], (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)])]  # one blank between words
    solid = codes != _BLANK
    one = codes[solid] << 2 * _PLACE
    two = codes[:-1] << 2 * _PLACE | codes[1:] << _PLACE
    three = (codes[:-2] << 2 * _PLACE | codes[1:-1] << _PLACE | codes[2:])[solid[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties in their own order."""
    if len(grams) > size:
        often = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[often], counts[often]
    return grams[np.lexsort((grams, -counts))[:size]]


class Profiles:
    """Packed n-grams by language, the most frequent first."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names, self._size = sorted(profiles), size
        self._grams = np.unique(np.array([g for grams in profiles.values() for g in grams] + [-1], np.int64))
        self._rank = np.full((len(self.names), len(self._grams)), -1)
        for row, name in enumerate(self.names):
            self._rank[row, np.searchsorted(self._grams, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def of(self, text: str | None) -> tuple[str, float]:
        """The language and 1 less the distance as a share of the largest possible; ties go to the first name."""
        own = top_grams(*gram_counts(text), self._size)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        place = np.minimum(np.searchsorted(self._grams, own), len(self._grams) - 1)
        ranks = np.where(self._grams[place] == own, self._rank[:, place], -1)
        distance = np.where(ranks < 0, self._size, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(distance))
        return self.names[best], float(1 - distance[best] / (self._size * len(own)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each batch by language and n-gram."""
    for batch in batches:
        own: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own.setdefault(lang, []).append(gram_counts(text))
        for lang, parts in own.items():
            grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)
            yield pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()), "gram": pa.array(grams), "n": pa.array(counts)})


def learn_profiles(labelled: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE, size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from rows (doc_id, text, lang). About docs_a_language rows of a language, chosen by a hash of doc_id and text, are read whole.

    Rows with a null lang are left out, and those of languages beyond the LANGUAGES most frequent. The driver gets size n-grams a language.
    """
    rows = labelled.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return {}
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], docs_a_language / r["count"])])
    share = F.coalesce(F.element_at(shares, F.col("lang")), F.lit(0.0))
    chosen = rows.filter(drawn(share, F.col("doc_id").cast("string"), "text", salt="profile")).select("lang", F.col("text").cast("string"))
    counts = chosen.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).collect()
    found: dict[str, list[int]] = {r["lang"]: [] for r in sizes}
    for row in sorted(top, key=lambda r: r["rank"]):
        found[row["lang"]].append(row["gram"])
    return {lang: grams for lang, grams in found.items() if grams}


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """docs with two more columns, lang_pred and score, from the whole text alone; docs must not have them yet.

    A null text, one without letters, or no profile at all gives 'und' with score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double"])
    state: list[Profiles] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Profiles(sent.value, size))
        found = [state[0].of(t) for t in batch.column("text").to_pylist()]
        more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score"])

    return map_batches(docs, work, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter((crc_mod(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row per row of docs (doc_id, text, lang).

    Profiles come from rows with a lang whose crc32(doc_id) mod 4 isn't 2; a null doc_id isn't learned from and is not
    held out. Empty tables give no rows.
    """
    profiles = learn_profiles(training_rows(docs))
    own = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict_languages(own, profiles).select("doc_id", "held_out", "lang_pred", "score")


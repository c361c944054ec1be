"""Target-distribution importance resampling by hashed n-grams (Xie et al., 2023).

Documents whose n-grams are likelier under a target text than in the collection get a higher weight; a Gumbel draw seeded by doc_id turns
weights into a sample without replacement: the highest scores are drawn.

N-grams are hashed by a ring of running CRC states: one scan over a document's words keeps the CRC-32 of each of the last n starts,
extends every one by a blank and the next word, and emits all of them as buckets. No n-gram is ever built as a string.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, saved, tabled

#: Words of the longest n-gram, buckets, the share drawn in hundredths, words that a document to be drawn has, and the draw's seed.
WORDS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Scores of a bin in which the last drawn score is looked for first.
BIN = 512


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; null has none."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWERED))


def feature_buckets(words: list[bytes], n: int, buckets: int) -> np.ndarray:
    """The buckets of all runs of 1 to n words, by one scan that keeps the CRC states of the last n starts."""
    if n == 1:
        states = [crc32(word) for word in words]
    else:
        ring: list[int] = []
        states = []
        for word in words:
            more = b" " + word
            ring = [crc32(more, state) for state in ring[1 - n :]]
            ring.append(crc32(word))
            states += ring
    return np.array(states, np.int64) % buckets


def _counted(n: int, buckets: int):
    """A task's features a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(feature_buckets(words_of(text.as_py()), n, buckets), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.record_batch({"bucket": pa.array(some, pa.int32()), "n": pa.array(counts[some])})

    return run


def bucket_counts(texts: DataFrame, text: str = "text", n: int = WORDS, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of all texts by bucket: each task sends at most buckets rows, and the driver gets no more."""
    counted = texts.select(F.col(text).cast("string")).mapInArrow(_counted(n, buckets), "bucket int, n long")
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    all_source, all_target = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * all_source / ((source.get(b, 0) + 1.0) * all_target))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, n: int = WORDS, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a document's features, 0 without any."""
    sent = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows = []
            for value in batch.column(1):
                words = words_of(value.as_py())
                found = feature_buckets(words, n, len(own))
                rows.append((len(words), len(found), int(own[found].sum()) // len(found) if len(found) else 0))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 8 hex digits of the SHA-256 of seed:doc_id; a null doc_id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _last_drawn(scores: DataFrame, size: int) -> int:
    """The size-th highest score: counts of bins of scores, then of the scores of one bin. Weights and draws lie within some 60,000 of zero
    whatever the input, so the driver gets a few hundred counts of each kind."""

    def cut(counts: dict[int, int], left: int) -> tuple[int, int]:
        for value in sorted(counts, reverse=True):
            if counts[value] >= left:
                return value, left
            left -= counts[value]
        raise AssertionError("fewer scores than are drawn")

    bins = scores.groupBy(F.floor(F.col("score") / BIN).alias("b")).count().collect()
    place, left = cut({r["b"]: r["count"] for r in bins}, size)
    inner = scores.filter(F.floor(F.col("score") / BIN) == place).groupBy("score").count().collect()
    return cut({r["score"]: r["count"] for r in inner}, left)[0]


def ranked(rows: DataFrame, size: int) -> DataFrame:
    """rows (doc_id, score, ...) with the column rank, 1 to size in the order of falling scores, ties by smaller doc_id (null last).

    Rows are sorted across tasks by ranges and numbered within each; a rank is that number and the count of all ranges before.
    """
    spark = rows.sparkSession
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            more = [pa.array([task] * batch.num_rows, pa.int64()), pa.array(range(at + 1, at + 1 + batch.num_rows), pa.int64())]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "__range", "__at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts, _ = tabled(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{fields}, __range long, __at long"))
    before, seen = {}, 0
    for r in sorted(parts.groupBy("__range").count().collect(), key=lambda r: r["__range"]):  # one row a range
        before[r["__range"]] = seen
        seen += r["count"]
    offsets = spark.createDataFrame(list(before.items()), "__range long, __before long")
    found = parts.join(F.broadcast(offsets), "__range").withColumn("rank", F.col("__at") + F.col("__before")).drop("__range", "__at", "__before")
    return found.withColumn("rank", F.when(F.col("rank") <= size, F.col("rank")))


def importance_resample(docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row per row of docs (doc_id, text) against the texts of target (text).

    Of the documents with at least least_words words, percent in a hundred (rounded down) are drawn: the highest scores, ties to the smaller
    doc_id, a null doc_id last; rank is null for the others. Null and empty texts have no features and weight 0; rows that repeat a
    doc_id count each for itself; an empty target gives the collection's own rare buckets no advantage but the smoothing's; an
    empty collection gives no rows. Other columns aren't read.
    """
    gains = bucket_gains(bucket_counts(docs, n=n, buckets=buckets), bucket_counts(target, n=n, buckets=buckets), buckets)
    rows = saved(weighed(docs, gains, n).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = rows.filter(F.col("n_words") >= least_words)
    size = percent * able.count() // 100
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    none = F.lit(None).cast("long").alias("rank")
    if not size:
        return rows.withColumn("rank", none).select(columns)
    above = (F.col("n_words") >= least_words) & (F.col("score") >= _last_drawn(able, size))
    return ranked(rows.filter(above), size).select(columns).union(rows.filter(~above).withColumn("rank", none).select(columns))


#: CRC-32 of each distinct word by its bytes and a table of 256 numbers, made by the polynomial.
ORACLE = """
WITH RECURSIVE steps AS (
  SELECT i AS code, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT code, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
),
poly AS (SELECT list(c ORDER BY code) AS p FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
dw AS (SELECT k, unnest(words) AS word FROM d), bw AS (SELECT unnest(words) AS word FROM b),
spelt AS (SELECT word, list_transform(range(1, length(hex(encode(word))) // 2 + 1), lambda i: ('0x' || hex(encode(word))[2 * i - 1:2 * i])::BIGINT) AS bytes, p FROM (SELECT word FROM dw UNION SELECT word FROM bw), poly),
hashed AS (SELECT word, xor(list_reduce(bytes, lambda c, x: xor(p[xor(c & 255, x) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM spelt),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
),
w AS (SELECT k, count(*) AS n, sum(gain) AS g FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY k),
x AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM d LEFT JOIN w USING (k)
),
y AS (SELECT *, weight + noise AS score, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST) END AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(10 * (SELECT count(*) FROM x WHERE n_features >= 20) / 100) THEN place END AS rank FROM y
"""

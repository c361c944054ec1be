"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters find digests that may hold a large share of the rows; exact counts verify them. The few that are
verified are broadcast and settled map-side, so that no group of copies meets in one task. All other digests are
grouped by an ordinary shuffle of (doc_id, digest) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved, without

#: Misra-Gries counters a task holds; a digest is heavy from 2 / COUNTERS of all rows, so at most COUNTERS / 2 are.
COUNTERS = 512


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(ascii_lower(text), 256))


def shrink(counts: dict[bytes, int], size: int) -> int:
    """Misra-Gries: take the size+1-th largest count off every counter and drop those that reach zero; what was taken."""
    if len(counts) <= size:
        return 0
    cut = sorted(counts.values(), reverse=True)[size]
    for key in [k for k, n in counts.items() if n <= cut]:
        del counts[key]
    for key in counts:
        counts[key] -= cut
    return cut


def misra_gries(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}
    for batch in batches:
        for item in pc.value_counts(batch.column("digest")).to_pylist():
            counts[item["values"]] = counts.get(item["values"], 0) + item["counts"]
        shrink(counts, size)
    yield pa.record_batch({"digest": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})


def heavy_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep_id, group_size) of every digest with at least 2 / counters of the rows: at most counters / 2 rows.

    A digest with a count f keeps at least f - rows / counters in its counters over all tasks together, so none is missed; the
    exact counts then drop those that only looked frequent.
    """
    rows = digests.count()
    least = 2 * rows / counters
    merged = digests.select("digest").mapInArrow(lambda batches: misra_gries(batches, counters), "digest binary, n long")
    likely = merged.groupBy("digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= least - rows / counters).select("digest")
    exact = digests.join(F.broadcast(likely), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return saved(exact.filter(F.col("group_size") >= F.greatest(F.lit(least), F.lit(2))))


def exact_groups(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, digest) -> (doc_id, digest, keep_id, group_size), one row for each given row."""
    heavy = F.broadcast(heavy_digests(digests, counters))
    settled = digests.join(heavy, "digest")
    rest = digests.join(heavy, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    return settled.select(columns).union(rest.join(groups, "digest").select(columns))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest doc_id of equal texts stays.
    Nulls in doc_id are the smallest; rows that repeat a doc_id and a text count in group_size and share one answer.
    Empty tables give no rows; other columns of docs aren't read.
    """
    digests = saved(docs.select("doc_id", digest_of(F.col("text")).alias("digest")))
    found = exact_groups(digests, counters)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(docs: DataFrame, counters: int = COUNTERS, most: int | None = None) -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns kept; of rows that repeat a doc_id and a text, one stays.

    Rows of heavy digests are held against the broadcast winners where they are read: none but a winner moves. Of the other digests, the
    keys of dropped rows are gathered by shuffle; up to most (BROADCAST_KEYS) of them are broadcast, more are joined by key.
    Null texts count as empty, a null doc_id is the smallest; empty tables give no rows.
    """
    mine = ["__exact_id", "__exact_digest"]
    digests = saved(docs.select("doc_id", digest_of(F.col("text")).alias("digest")))
    heavy = heavy_digests(digests, counters)
    won = F.broadcast(heavy.select(F.col("digest").alias("__won_digest"), F.col("keep_id").alias("__won_id")))
    keyed = docs.withColumns({"__exact_id": F.col("doc_id"), "__exact_digest": digest_of(F.col("text"))})
    winners = keyed.join(won, F.col("__exact_digest") == F.col("__won_digest")).filter(F.col("__exact_id").eqNullSafe(F.col("__won_id"))).drop("__won_digest", "__won_id").dropDuplicates(["__exact_digest"])
    light = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    several = light.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1")
    several = saved(light.join(several, "digest"))
    lost = several.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(mine[0]), F.col("digest").alias(mine[1]))
    left = without(keyed.join(won, F.col("__exact_digest") == F.col("__won_digest"), "left_anti"), lost, mine, most)
    again = several.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    again = saved(again.select(F.col("doc_id").alias("__again_id"), F.col("digest").alias("__again_digest")))
    if not again.isEmpty():
        once = without(left, again.toDF(*mine), mine, most)
        twice = left.join(again, F.col("__exact_id").eqNullSafe(F.col("__again_id")) & (F.col("__exact_digest") == F.col("__again_digest")), "left_semi")
        left = once.union(twice.dropDuplicates(mine))
    return winners.union(left).drop(*mine)


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""

"""The review ledger: token rows, top-k by recency, rollups, refusals, lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How revealing each lane is, the higher the more (for the highest seen).
LANES = {"harness_meta": 1, "harness_frame": 2, "tool_io": 3, "assistant": 4, "userctx": 5, "user_input": 6}

TOP_TOKENS, RECENT, CONVERSATIONS, PENDING, APPROVAL_S = 5000, 500, 1024, 32, 300
OFF_DEFAULT_S, OFF_MOST_S = 1800, 86_400


def token_ledger(seen: DataFrame) -> DataFrame:
    """seen (token, at_us, lane, value, peekable) -> a row for each token: count, first_seen, last_seen, highest lane, value where it may be peeked at."""
    rank = F.coalesce(*[F.when(F.col("lane") == lane, n) for lane, n in LANES.items()], F.lit(0))
    rows = seen.groupBy("token").agg(F.count("*").alias("n"), F.min("at_us").alias("first_seen"), F.max("at_us").alias("last_seen"), F.max(F.struct(rank.alias("r"), F.col("lane").alias("l"))).alias("top"), F.max(F.when(F.col("peekable"), F.col("value"))).alias("value"))
    return rows.select("token", "n", "first_seen", "last_seen", F.col("top.l").alias("lane"), F.coalesce("value", F.lit("")).alias("value"))


def newest(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in the order given: a top-k heap in each task, then one small merge."""
    return rows.orderBy(*order).limit(n)


def token_class(kind: Column, entity: Column) -> Column:
    """sad for card security codes, broker and local for such secrets, else auto_pii."""
    return F.when(entity == "CVV", "sad").when(kind == "broker", "broker").when(kind == "local", "local").otherwise("auto_pii")


def conversations(records: DataFrame) -> DataFrame:
    """records (conv_id, turn, human_turn, at, pending) -> turn_count, last_updated, pending by conversation."""
    return records.groupBy("conv_id").agg(F.max(F.coalesce("human_turn", "turn")).alias("turn_count"), F.max("at").alias("last_updated"), F.count_if(F.col("pending")).alias("pending"))


def last_wins(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """A row for each key with its last value and the place of its first row."""
    return rows.groupBy(key).agg(F.max(F.struct(order, value)).alias("l"), F.min(order).alias("first")).select(key, F.col(f"l.{value}").alias(value), "first")


def masking_off(commands: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """events with off: whether the last command at or before an event (as-of, by one sort of both) still has masking off.

    commands (key, at, off, seconds or null): off switches masking off for so many seconds, half an hour where none are given and a day at most; else it is
    switched on.
    """
    both = events.select(key, "at", "event_id", F.lit(None).cast("timestamp").alias("until"), F.lit(1).alias("late")).unionByName(
        commands.select(key, "at", F.lit(None).cast("long").alias("event_id"), F.when(F.col("off"), F.timestamp_add("SECOND", F.least(F.coalesce("seconds", F.lit(OFF_DEFAULT_S)), F.lit(OFF_MOST_S)), F.col("at"))).otherwise(F.col("at")).alias("until"), F.lit(0).alias("late")))
    w = Window.partitionBy(key).orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("until", F.last("until", ignorenulls=True).over(w)).filter("late = 1")
    return seen.select("event_id", F.coalesce(F.col("at") < F.col("until"), F.lit(False)).alias("off"))


#: Events that end a request's life (fixed).
TERMINAL = ("completed", "rejected", "aborted", "upstream_error", "backpressure_rejected", "timed_out")


def lifecycles(events: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """key, final, n: the first terminal state of a request absorbs what follows, else its last state; n counts states up to there."""
    ended = F.min(F.when(F.col(state).isin(*TERMINAL), F.col(order))).over(Window.partitionBy(key))
    live = events.withColumn("_end", ended).filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    return live.groupBy(key).agg(F.max(F.struct(order, state)).alias("l"), F.count("*").alias("n")).select(key, F.col(f"l.{state}").alias("final"), "n")


#: Microseconds of a bucket of time, and buckets of a span of them: no task holds more places in time than one of either has.
BUCKET_US, BUCKETS = 1_000_000, 3_600


def within(instants: DataFrame, at: str, n: str, span: int) -> DataFrame:
    """(at, n summed over the span of microseconds that ends with at, both ends included, as pending), for distinct instants.

    Sums up to a place are made of three: over all spans of buckets before, over the buckets before in its own, and over the instants before in its
    own bucket; a sliding sum is the difference of two. However dense the instants lie, no window holds more than a bucket's.
    """
    place, bucket = F.col("p"), F.col("bucket")
    ends = instants.select(F.col(at).alias("p"), F.col(n).alias("n"), F.col(at).alias("of"), F.lit(True).alias("high"))
    starts = instants.select((F.col(at) - span - 1).alias("p"), F.lit(0).cast("long").alias("n"), F.col(at).alias("of"), F.lit(False).alias("high"))
    points = ends.union(starts).withColumn("bucket", F.floor(place / BUCKET_US)).withColumn("part", F.floor(bucket / BUCKETS))
    inner = points.withColumn("here", F.sum("n").over(Window.partitionBy("bucket").orderBy("p").rangeBetween(Window.unboundedPreceding, 0)))
    totals = points.groupBy("part", "bucket").agg(F.sum("n").alias("n"))
    buckets = totals.withColumn("earlier", F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).withColumn("long_ago", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    summed = inner.join(buckets.select("bucket", "part", "earlier").join(parts.select("part", "long_ago"), "part").drop("part"), "bucket")
    total = F.col("here") + F.col("earlier") + F.col("long_ago")
    return summed.groupBy(F.col("of").alias(at)).agg((F.max(F.when(F.col("high"), total)) - F.max(F.when(~F.col("high"), total))).alias("pending"))

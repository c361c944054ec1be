"""Transcripts as trees: dropping nodes and relinking their children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoint import dropped, tabled


def relinked(nodes: DataFrame) -> DataFrame:
    """nodes (uuid, parent, removed) -> the kept ones with parent moved up to the nearest kept ancestor, else null.

    Paths through removed nodes are halved in each round, so that n of them take log2(n) rounds, each written as a table and deleted after the next. A cycle
    of removed nodes leads nowhere and gives null.
    """
    up, path = tabled(nodes.filter("removed").select(F.col("uuid").alias("g"), F.col("parent").alias("to")))
    for _ in range(up.count().bit_length() + 1):
        above = up.select(F.col("g").alias("h"), F.col("to").alias("further"))
        last = path
        moved, path = tabled(up.join(above, F.col("to") == F.col("h"), "left").select("g", F.when(F.col("h").isNotNull(), F.col("further")).otherwise(F.col("to")).alias("to"), F.col("h").isNotNull().alias("moved")))
        dropped(nodes.sparkSession, last)
        up = moved.select("g", "to")
        if moved.filter("moved").isEmpty():
            break
    gone = nodes.filter("removed").select(F.col("uuid").alias("x"))
    ends = up.join(gone, F.col("to") == F.col("x"), "left").select("g", F.when(F.col("x").isNull(), F.col("to")).alias("to"))
    kept = nodes.filter("NOT removed")
    return kept.join(ends, F.col("parent") == F.col("g"), "left").select("uuid", F.when(F.col("g").isNotNull(), F.col("to")).otherwise(F.col("parent")).alias("parent"))


def drop_thinking(records: DataFrame, session: str = "session") -> DataFrame:
    """records (session, idx, kind, redacted) without standalone thinking at or after the session's first redaction."""
    first = F.min(F.when(F.col("redacted"), F.col("idx"))).over(Window.partitionBy(session))
    marked = records.withColumn("_first", first)
    return marked.filter(F.col("_first").isNull() | (F.col("idx") < F.col("_first")) | (F.col("kind") != "thinking")).drop("_first")

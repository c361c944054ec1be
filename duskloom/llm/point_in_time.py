"""Point-in-time feature join: the version of a source that was known and not yet expired at an asked time.

Versions live from their start (event or arrival, whichever is later) to their expiry. Time is cut into chunks and a version is copied
into every chunk that its life overlaps, so a source's chunk can be joined alone. A chunk of many versions is dealt in
parts, each with all the times asked in it. Parts are gathered in cells of bounded size, and in each cell DuckDB runs a sort-based join
over the two inequalities start <= t < expiry, then arg_max by priority. The parts' winners are reduced by one more aggregation.

Asked times are made distinct first: a version meets at most as many of them as its life has seconds, however many
rows ask, so work grows with the rows and not with the product of a source's two sides.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

#: Seconds of a chunk.
WIDTH = 1000

#: Versions of a part, and rows of a cell, about.
PART_ROWS, CELL_ROWS = 8_192, 32_768

#: Shares in which a chunk's versions meet its count, so that no chunk is one task's.
SHARES = 16

#: Age in seconds from which a version is stale.
STALE = 120

_JOIN = """
WITH groups AS MATERIALIZED (SELECT *, row_number() OVER () AS g FROM (SELECT DISTINCT source, chunk, part FROM asks)),
a AS MATERIALIZED (SELECT row, g * ({width} + 1) + t - chunk * {width} AS at FROM asks JOIN groups USING (source, chunk, part)),
v AS MATERIALIZED (
  SELECT row, g * ({width} + 1) + greatest(start - chunk * {width}, 0) AS first, g * ({width} + 1) + least(expiry - chunk * {width}, {width}) AS beyond,
    row_number() OVER (ORDER BY event, arrival, id) AS priority
  FROM versions JOIN groups USING (source, chunk, part)
)
SELECT a.row AS asked, arg_max(v.row, v.priority) AS won FROM a JOIN v ON a.at >= v.first AND a.at < v.beyond GROUP BY a.row
"""


def _numbered(rows: pa.Table, columns: list[str]) -> pa.Table:
    return rows.select(columns).append_column("row", pa.array(range(rows.num_rows), pa.int64()))


def _cell_winners(width: int):
    """A cell's versions and asks -> the best version of its part for each ask that has one."""

    def run(versions: pa.Table, asks: pa.Table) -> pa.Table:
        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as db:
            db.register("versions", _numbered(versions, ["source", "chunk", "part", "event", "arrival", "id", "start", "expiry"]))
            db.register("asks", _numbered(asks, ["source", "chunk", "part", "t"]))
            found = db.execute(_JOIN.format(width=width)).fetchnumpy()
        asked, won = (pa.array(found[name], pa.int64()) for name in ("asked", "won"))
        best = versions.select(["event", "arrival", "id", "value"]).take(won)
        return pa.table([asks["source"].take(asked), asks["t"].take(asked), *best.columns], ["source", "t", *best.column_names])

    return run


def versions_at(asks: DataFrame, versions: DataFrame, width: int = WIDTH, part_rows: int = PART_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(source, t, event, arrival, id, value): the winner of each distinct (source, t) of asks that has one.

    asks: source string, t long. versions: source string, event, arrival, expiry and id long, value of any type. A version is usable
    at t when its source is equal, event <= t and arrival <= t < expiry. The latest event wins, then the latest arrival, then the
    largest id, then the largest value. Rows with a null among source, t, event, arrival, expiry or id match nothing; a
    version that expires before it starts is never usable; empty tables give no rows; other columns aren't read.
    """
    kind = versions.schema["value"].dataType
    own = versions.select("source", "event", "arrival", "expiry", F.struct("id", "value").alias("x")).dropna(subset=["source", "event", "arrival", "expiry"]).filter(F.col("x.id").isNotNull())
    own = own.withColumn("start", F.greatest("event", "arrival")).filter("start < expiry")
    once = own.groupBy("source", "event", "arrival", "expiry", "start").agg(F.max("x").alias("x")).select("source", "event", "arrival", "expiry", "start", "x.id", "x.value")
    chunks = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("expiry") - 1) / width))
    share = F.pmod(F.xxhash64("event", "arrival", "expiry"), F.lit(SHARES))
    copies = saved(once.withColumns({"chunk": F.explode(chunks), "share": share}))
    asked = saved(asks.select("source", "t").dropna().distinct().withColumn("chunk", F.floor(F.col("t") / width)))

    counts = saved(copies.groupBy("source", "chunk").agg(F.count("*").alias("n")).join(asked.groupBy("source", "chunk").agg(F.count("*").alias("m")), ["source", "chunk"]))
    counts = counts.withColumn("parts", F.ceil(F.col("n") / part_rows))
    rows = counts.agg(F.sum(F.col("n") + F.col("m") * F.col("parts"))).first()[0] or 0
    cells = -(-rows // cell_rows) or 1

    cell = F.pmod(F.xxhash64("source", "chunk", "part"), F.lit(cells)).alias("cell")
    dealt = counts.select("source", "chunk", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share"))
    left = copies.join(dealt, ["source", "chunk", "share"]).withColumn("part", F.pmod(F.xxhash64("expiry", "arrival", "event", F.lit("part")), "parts"))
    left = left.select("source", "chunk", "part", "event", "arrival", "id", "start", "expiry", "value", cell)
    right = asked.join(counts.select("source", "chunk", "parts"), ["source", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = right.select("source", "chunk", "part", "t", cell)

    schema = T.StructType([T.StructField("source", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("t", "event", "arrival", "id")), T.StructField("value", kind)])
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_cell_winners(width), schema)
    best = found.groupBy("source", "t").agg(F.max(F.struct("event", "arrival", "id", "value")).alias("x"))
    return best.select("source", "t", "x.*")


def _group(doc_id: Column, k: int) -> Column:
    """The k-th eight-digit group of the hex SHA-256 of the decimal doc_id, as a number."""
    return F.conv(F.substring(F.sha2(doc_id.cast("string"), 256), 8 * k + 1, 8), 16, 10).cast("long")


def document_versions(docs: DataFrame) -> DataFrame:
    """Each row of docs as a version of its source."""
    i = F.col("doc_id")
    event = _group(i, 0) % 50_000
    return docs.select(F.col("source").cast("string").alias("source"), event.alias("event"), (event - 60 + _group(i, 1) % 600).alias("arrival"), (event + _group(i, 2) % 900).alias("expiry"), i.cast("long").alias("id"), F.struct(F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang")).alias("value"))


def feature_join(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, t, version_id, age, status, n_chars, lang: one row per row of labels (doc_id).

    A label asks about the source of the document with its doc_id; where several rows have that doc_id, about the largest source that isn't
    null. No such document, a null source or a null doc_id (t is null then) gives status 'none'. Rows that repeat a
    label have equal answers; empty labels give no rows. Of copies of a doc_id within a source, the largest n_chars, then lang, counts.
    """
    sources = docs.groupBy("doc_id").agg(F.max(F.col("source").cast("string")).alias("source"))
    asked = labels.groupBy("doc_id", F.spark_partition_id().alias("task")).agg(F.count("*").cast("int").alias("times"))  # no array holds more than a task's rows
    rows = saved(asked.join(sources, "doc_id", "left").withColumn("t", _group(F.col("doc_id"), 3) % 50_000))
    best = versions_at(rows, document_versions(docs)).withColumnRenamed("id", "version_id")
    found = rows.join(best, ["source", "t"], "left").withColumn("age", F.col("t") - F.col("event"))
    status = F.when(F.col("version_id").isNull(), "none").when(F.col("age") > STALE, "stale").otherwise("fresh")
    fresh = lambda name: F.when(F.col("status") == "fresh", F.col(f"value.{name}")).alias(name)
    found = found.withColumn("status", status).withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return found.select("doc_id", "t", "version_id", "age", "status", fresh("n_chars"), fresh("lang"))


ORACLE = """
WITH d AS (SELECT *, sha256(doc_id::VARCHAR) AS h FROM documents),
v AS (
  SELECT doc_id, source, n_chars, lang, e, e - 60 + ('0x' || h[9:16])::BIGINT % 600 AS a, e + ('0x' || h[17:24])::BIGINT % 900 AS x
  FROM (SELECT *, ('0x' || h[1:8])::BIGINT % 50000 AS e FROM d)
),
l AS (SELECT row_number() OVER () AS k, doc_id, ('0x' || sha256(doc_id::VARCHAR)[25:32])::BIGINT % 50000 AS t FROM labels),
q AS (SELECT l.*, s.source FROM l LEFT JOIN (SELECT doc_id, max(source) AS source FROM documents GROUP BY doc_id) s USING (doc_id)),
w AS (
  SELECT q.k, arg_max({'id': v.doc_id, 'e': v.e, 'n': v.n_chars, 'lang': v.lang}, {'e': v.e, 'a': v.a, 'd': v.doc_id}) AS x
  FROM q JOIN v ON q.source = v.source AND v.e <= q.t AND v.a <= q.t AND q.t < v.x GROUP BY q.k
)
SELECT doc_id, t, x.id AS version_id, t - x.e AS age, CASE WHEN x IS NULL THEN 'none' WHEN t - x.e > 120 THEN 'stale' ELSE 'fresh' END AS status,
  CASE WHEN t - x.e <= 120 THEN x.n END AS n_chars, CASE WHEN t - x.e <= 120 THEN x.lang END AS lang
FROM q LEFT JOIN w USING (k)
"""

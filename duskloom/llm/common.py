"""What the operators of this subpackage share: reading, splits, checkpoints, row removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Keys up to this number are broadcast (their number is counted first); more are joined by shuffle.
BROADCAST_KEYS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def with_checkpoints(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the cluster's own, or, in local mode only, a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    if folder := context.getConf().get("spark.checkpoint.dir"):
        context.setCheckpointDir(folder)
    elif context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


#: Grains of a draw by hash: so many that a share is never rounded to nothing.
GRAINS = 1 << 62


def drawn(share: Column, *keys: Column | str, salt: str) -> Column:
    """Whether a row is in a sample of so large a share, by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(GRAINS)) < F.least(share, F.lit(1.0)) * GRAINS


def sampled(rows: DataFrame, bound: int, *keys: Column | str, salt: str) -> DataFrame:
    """All rows, or about bound of them, chosen by a hash of keys. Rows with equal keys are drawn together: make them distinct first."""
    n = rows.count()
    return rows if n <= bound else rows.filter(drawn(F.lit(bound / n), *keys, salt=salt))


def saved(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder: computed once, and kept when executors are lost."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


#: Rows that work() gets at once: texts become Python objects only for these.
SLICE_ROWS = 1000


def tabled(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table written to the shared checkpoint folder, and its path.

    For loops: a checkpoint passes its plan's estimated size on, which a join in every round would square; a table's size is that of its files.
    """
    spark = df.sparkSession
    with_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that tabled() wrote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """work on slices of each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield work(batch.slice(at, SLICE_ROWS))

    return df.mapInArrow(run, schema)


def without(rows: DataFrame, keys: DataFrame, on: list[str], most: int | None = None) -> DataFrame:
    """The rows whose key isn't among keys. Up to most (BROADCAST_KEYS) keys are broadcast; else both sides are shuffled by key."""
    keys = saved(keys.select(on).distinct())
    few = keys.count() <= (BROADCAST_KEYS if most is None else most)
    mine = [f"__key_{i}" for i in range(len(on))]
    keys = keys.toDF(*mine)
    same = [rows[name].eqNullSafe(keys[key]) for name, key in zip(on, mine, strict=True)]
    return rows.join(F.broadcast(keys) if few else keys, same, "left_anti")


#: A key is heavy if it has more than one in so many of all rows, so that fewer keys than this are heavy whatever the input.
HEAVY_KEYS = 512


def beside(rows: DataFrame, values: DataFrame, on: str, total: int, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """rows joined with values on a column without nulls; values: one row a key, its number of rows in n, which isn't passed on.

    total is at least the sum of n. The values of heavy keys, fewer than heavy_keys, are broadcast, so a key's rows stay where they are
    however many they are; only rows of other keys are shuffled. rows and values are both read twice: give tables.
    """
    limit = total / heavy_keys
    others = [c for c in values.columns if c not in (on, "n")]
    heavy = F.broadcast(values.filter(F.col("n") > limit).select(on, *others))
    light = values.filter(F.col("n") <= limit).select(on, *others)
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(on), on, "left_anti").join(light, on))

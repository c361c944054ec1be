"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

Each source has a repetition rate: its target share of the budget over what it holds. A document's count is a Poisson
variable with this mean, inverted from a uniform number that a seeded hash of its doc_id gives, so that any run on any
cluster draws the same. Each document is exploded by its count, and a hash order over all copies shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, saved

SEED = 42

#: Power of a source's natural share that its target weight is in proportion to: 1 keeps the mixture, 0 makes all sources equal.
TEMPERATURE = 0.5

#: Mean of one inverted draw at most: a larger rate is the sum of so many independent draws, which keeps exp(-rate) far from zero.
MEAN_A_DRAW = 16.0
#: Highest value of one draw; beyond it a Poisson variable of mean 16 has a probability under 1e-30.
MOST_A_DRAW = 96


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the SHA-256 of parts joined by ':' (48 bits of it)."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def poisson(rate: Column, *key: Column, seed: int = SEED) -> Column:
    """The Poisson count of mean rate that the seeded hash of key gives; 0 for rates of 0 or null."""
    draws = F.ceil(rate / MEAN_A_DRAW).cast("int")

    def one(n: Column) -> Column:
        u, mean = uniform(F.lit(seed), *key, n), rate / draws
        start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("below"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * mean / k
            return F.when(u < s["below"], s).otherwise(F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["below"] + p).alias("below")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_A_DRAW)), start, step, lambda s: s["k"])

    total = F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda s, n: s + one(n))
    return F.when(rate > 0, total).otherwise(0)


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0) -> DataFrame:
    """(source, n_docs, chars, target, rate): one row for each source, null being one of its own.

    target: the share of the characters that the source is to have: weights, scaled to sum 1 over the sources there are
    (a source that isn't in weights gets none), else its natural share to the power temperature. budget: characters of
    the mixture over those of the input. A source without a character has rate 0. The table has a row for each source
    and is made by one aggregation with partial sums, kept in the checkpoint folder, so that texts are read once for it.
    """
    sizes = saved(docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length(F.coalesce("text", F.lit(""))).cast("long")).alias("chars")))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("chars").cast("double"), F.lit(float(temperature))) * (F.col("chars") > 0).cast("double"))
    else:
        given = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
        sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, given).otherwise(0.0))
    total = sizes.agg(F.sum("weight").alias("weights"), F.sum("chars").alias("total")).first()
    weights_sum, chars = float(total["weights"] or 0), int(total["total"] or 0)
    target = F.col("weight") / F.lit(weights_sum or 1.0)
    rate = F.when(F.col("chars") > 0, target * F.lit(float(budget) * chars) / F.col("chars")).otherwise(0.0)
    return sizes.select("source", "n_docs", "chars", target.alias("target"), rate.alias("rate"))


def replicated(docs: DataFrame, rates: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, source, any others) exploded by Poisson counts: all columns of docs, with copy (from 1) and order_key.

    Rows whose count is 0 don't appear. A doc_id that repeats draws the same count each time. rates are matched null-safe, and
    broadcast when they are few.
    """
    rate = rates.select(F.col("source").alias("__rate_source"), F.col("rate").alias("__rate"))
    if rates.count() <= BROADCAST_KEYS:
        rate = F.broadcast(rate)
    drawn = docs.join(rate, docs["source"].eqNullSafe(F.col("__rate_source")), "left")
    count = poisson(F.col("__rate"), F.col("doc_id"), seed=seed)
    counted = drawn.withColumn("__copies", count).filter("__copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return copies.withColumn("order_key", F.sha2(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy"), 256)).drop("__rate_source", "__rate", "__copies")


def shuffled(rows: DataFrame) -> DataFrame:
    """rows dealt over tasks by order_key, a hash, and sorted by it within each: one exchange, no sampling pass."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "order_key").sortWithinPartitions("order_key")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, budget: float = 1.0, seed: int = SEED) -> DataFrame:
    """docs as a shuffled mixture with the target shares of characters, in expectation; adds copy and order_key.

    docs needs doc_id, text and source, and must not have copy or order_key. Null sources are a source of their own; null
    and empty texts count no characters. Rows that repeat are drawn like any other. Empty tables give no rows.
    """
    return shuffled(replicated(docs, source_rates(docs, weights, temperature, budget), seed))


def source_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy, order_key of the mixture at the production parameters."""
    return mix_sources(docs.select("doc_id", "text", "source")).select("doc_id", "source", "copy", "order_key")


ORACLE = f"""
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n_docs, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source
),
weighted AS (SELECT *, CASE WHEN chars > 0 THEN pow(chars, {TEMPERATURE}) ELSE 0 END AS weight FROM sizes),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(chars) FROM weighted) / chars ELSE 0 END AS rate
  FROM weighted
),
docs AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.source, r.rate, ceil(r.rate / {MEAN_A_DRAW})::INT AS draws
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source WHERE r.rate > 0
),
draws AS (SELECT r, doc_id, source, rate / draws AS mean, unnest(range(1, draws + 1)) AS draw FROM docs),
uniforms AS (
  SELECT r, doc_id, source, draw, mean,
         (('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || draw), 1, 12))::BIGINT + 0.5) / {float(1 << 48)} AS u
  FROM draws
),
steps AS (
  SELECT r, doc_id, source, draw, mean, u, 0 AS k, exp(-mean) AS p, exp(-mean) AS below FROM uniforms
  UNION ALL
  SELECT r, doc_id, source, draw, mean, u, k + 1, p * mean / (k + 1), below + p * mean / (k + 1) FROM steps WHERE u >= below AND k < {MOST_A_DRAW}
),
counts AS (SELECT r, doc_id, source, sum(k) AS n FROM (SELECT r, doc_id, source, draw, max(k) AS k FROM steps GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, source, copy::INT AS copy, sha256('{SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS order_key
FROM (SELECT doc_id, source, unnest(range(1, n::BIGINT + 1)) AS copy FROM counts WHERE n > 0)
"""

"""The reversible store: a table token -> ciphertext, insert-if-absent, with tombstones and promotions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encrypted(value: Column, key: str) -> Column:
    """AES-GCM with a random nonce before the ciphertext. key: 16, 24 or 32 characters."""
    return F.aes_encrypt(value, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))


def decrypted(ciphertext: Column, key: str) -> Column:
    return F.aes_decrypt(ciphertext, F.lit(key), F.lit("GCM"), F.lit("DEFAULT")).cast("string")


def interned(found: DataFrame, vault: DataFrame | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """New rows (token, value, kind) for the vault: one a token, its least value; tokens in the vault or with a tombstone are left out.

    Partial aggregation takes repeats away before the shuffle.
    """
    new = found.groupBy("token").agg(F.min(F.struct("value", "kind")).alias("r")).select("token", "r.value", "r.kind")
    for known in (vault, tombstones):
        if known is not None:
            new = new.join(known.select("token"), "token", "left_anti")
    return new


def revealed(tokens: DataFrame, vault: DataFrame, kinds: tuple[str, ...] = ("pii",), now: str | None = None) -> DataFrame:
    """tokens with value: null for a token that is unknown, of another kind, or expired by now."""
    alive = vault.filter(F.col("kind").isin(*kinds))
    if now is not None:
        alive = alive.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    return tokens.join(alive.select("token", "value"), "token", "left")


def audited(tokens: DataFrame, vault: DataFrame) -> DataFrame:
    """tokens with class and shown: the value of personal data and local secrets, only the name of a brokered one."""
    rows = tokens.join(vault, "token", "left")
    shown = F.when(F.col("kind").isin("pii", "local"), F.col("value")).when(F.col("kind") == "broker", F.col("secret_name"))
    return rows.select(*tokens.columns, F.coalesce("kind", F.lit("unknown")).alias("class"), shown.alias("shown"))


def without_tombstones(vault: DataFrame, tombstones: DataFrame) -> DataFrame:
    return vault.join(tombstones.select("token"), "token", "left_anti")


def promoted(requests: DataFrame, vault: DataFrame, tombstones: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """New promotions (session, token): local secrets that a session lets into tool inputs. requests may repeat, in one batch or a replay of it;
    tokens of another kind, unknown ones and those with a tombstone are left out, and so are promotions that are known."""
    new = requests.select("session", "token").dropna().distinct().join(vault.filter("kind = 'local'").select("token"), "token", "left_semi")
    if tombstones is not None:
        new = new.join(tombstones.select("token"), "token", "left_anti")
    if known is not None:
        new = new.join(known.select("session", "token"), ["session", "token"], "left_anti")
    return new.select("session", "token")


def tool_values(uses: DataFrame, vault: DataFrame, promotions: DataFrame) -> DataFrame:
    """uses (session, token) with the value that a tool's input may get: personal data by the policy of its entity elsewhere, a local secret only
    where the session promoted it, a brokered one never."""
    rows = uses.join(vault.select("token", "value", "kind"), "token", "left").join(promotions.withColumn("let", F.lit(True)), ["session", "token"], "left")
    return rows.select(*uses.columns, F.when((F.col("kind") == "pii") | ((F.col("kind") == "local") & F.col("let")), F.col("value")).alias("value"))

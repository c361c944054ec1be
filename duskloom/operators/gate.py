"""The gate of request bodies: what can be masked goes on masked, all else is refused with a reason, none goes on in the clear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import json_text as J
from . import secrets as G


def gated(rows: DataFrame, body: str, secrets: DataFrame, change: Callable[[DataFrame], DataFrame], skipped: tuple[str, ...] = J.CONTRACT_KEYS["messages"]) -> DataFrame:
    """rows with body as it may go on, refusal (null where it may) and secret, the name of one that had it refused.

    refusal: 'not_json' and 'too_deep' for bodies whose leaves can't be read; 'secret_in_contract' where one of secrets (name, value, case_sensitive)
    stands in a leaf that is never rewritten, so that masking can't take it out. Refused bodies become null and their leaves aren't looked
    at; the others' leaves are what change makes of them, as in with_leaves_changed. A null body stays null and isn't refused; rows that
    repeat are judged alike, other columns are kept, and an empty table gives no rows.
    """
    kept = F.array_join(F.transform(J.carved_out(F.col(body), skipped), lambda x: x["text"]), "\0")
    seen = G.literal_hits(rows.withColumn("_kept", kept), "_kept", secrets, "_hits")
    judged = seen.withColumn("secret", F.array_min(F.transform("_hits", lambda h: h["name"]))).withColumn("refusal", F.coalesce(J.problem(F.col(body)), F.when(F.col("secret").isNotNull(), "secret_in_contract")))
    open_ones = judged.withColumn(body, F.when(F.col("refusal").isNull(), F.col(body))).drop("_kept", "_hits")
    return J.with_leaves_changed(open_ones, body, change, skipped)

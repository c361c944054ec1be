"""The few functions that need Python: Arrow batches over small candidate sets."""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shell_words(value: str) -> list[str]:
    """Words as a shell splits them; none if a quote stays open."""
    try:
        return shlex.split(value)
    except ValueError:
        return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def shell_split(values: pd.Series) -> pd.Series:
    return values.map(lambda v: shell_words(v or ""))

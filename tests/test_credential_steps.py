"""Credentials are looked for without freeing texts from their prose, once in a plan, with the same values."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F

from duskloom.functions import context as X
from duskloom.functions import spans as S
from duskloom.plans import load

QUERIES, _ = load()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("credentials"))
    spark.createDataFrame([(1, "mail a@b.io, cvv 123", "s"), (2, "none", "s")], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["mint_tokens", "op_mask", "op_keep"])
def test_credentials_stand_once_and_without_prose(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(S.PROSE) == 1 and plan.count(S.singly(X.CREDENTIAL_GUARD)) == 1


def test_values_stay(spark):
    far = " running prose of no kind" * 300
    rows = [("password: letmein", ["letmein"]), (f"{far} token = abcdef {far}", ["abcdef"]), ("redis://user:pw@h and 5% of it", ["user:pw"]), (f"a%3Ftoken%3Dletmein-x {far}", ["letmein-x"]), ("a%253Ftoken%253Dletmein-x", ["letmein-x"]), ("redis%3A%2F%2Fuser:pw@h", ["user:pw"]), ("100% sure", []), ("", []), (None, [])]
    found = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, text string").select("id", F.transform(X.credentials(F.col("text")), lambda s: s["value"]).alias("v")).orderBy("id").collect()
    assert [sorted(r.v or []) for r in found] == [v for _, v in rows]

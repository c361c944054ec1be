"""Values that begin about a digit are looked for from the text's first digit on, and none is lost or moved."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F

from duskloom.functions import patterns as P
from duskloom.functions import spans as S
from duskloom.operators import detect as D
from duskloom.plans import load

QUERIES, _ = load()
LONG = "Aé wörds of 𝒳 running prose ﷐ here, " * 200
VALUES = ["943 476 5919", "AB123456C", "+1 (415) 555-2671", "MORGA657054SM9IJ", "BB1388568", "4111 1111 1111 1111", "536-90-4399", "A12345678", "12AB1234567", "8.8.8.8", "1EG4-TE5-MK73", "GB82WEST12345698765432", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"]
ROWS = [*VALUES, *(f"id {v} and {v}." for v in VALUES), *(LONG + v for v in VALUES), *(f"x{v}" for v in VALUES), *(f"{'A' * 30}{v}" for v in VALUES), *(f"{LONG}5 {LONG}{v}\n{v}" for v in VALUES), LONG, "", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tails"))
    spark.createDataFrame([(1, "mail a@b.io, cvv 123", "s"), (2, "none", "s")], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["uk_id_spans", "medical_id_spans", "id_document_spans"])
def test_texts_are_searched_from_their_first_digit(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?s)(?:[0-9]).*" in plan


def test_tails_hold_all_values(spark):
    """The same spans as the whole texts', for every recognizer that needs six digits."""
    digits = [r for r in D.ALL if isinstance(r, P.Recognizer) and r not in D._WORDY]
    some = [r for r in D.ALL if r in D._DIGIT]
    rows = spark.createDataFrame(list(enumerate(ROWS)), "id int, text string").repartition(1)
    whole = lambda t: S.find_all(t, [], [(D.SIX_DIGITS, [r.search(i) for i, r in enumerate(digits)])])
    found = rows.select("id", D.searched(F.col("text"), *digits).alias("tail"), whole(F.col("text")).alias("whole")).collect()
    found += rows.select("id", D.searched(F.col("text"), *some).alias("tail"), S.find_all(F.col("text"), [r.search(i) for i, r in enumerate(some)]).alias("whole")).collect()
    assert all(r.tail == r.whole for r in found) and sum(len(r.whole) for r in found) > 90

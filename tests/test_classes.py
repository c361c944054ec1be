"""Classes of characters stand in plans character by character: the JVM's classes of several ranges slow down all threads of a process."""

import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from duskloom.functions import context as X
from duskloom.functions import patterns as P
from duskloom.functions import spans as S
from duskloom.operators import detect as D
from duskloom.plans import load

QUERIES, _ = load()
NAMES = (
    "op_redact", "cvv_spans", "id_document_spans", "medical_id_spans", "document_found", "uk_id_spans", "category_gate", "dob_spans", "op_broker",
    "mint_tokens", "op_mask", "op_keep", "entity_counts", "op_hash",
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("classes"))
    spark.createDataFrame([(1, "mail a@b.io, cvv 123", "s"), (2, "none", "s")], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_no_class_of_three_parts_in_a_plan(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.findall(r"\[[^\]\n]*[0-9A-Za-z]-[0-9A-Za-z][^\]\n]*[0-9A-Za-z]-[0-9A-Za-z][^\]\n]*[0-9A-Za-z_]-?[^\]\n]*\]", re.sub(r"\\(.)", "", plan))


def test_classes_hold_the_same_characters(spark):
    patterns = [r.pattern for r in D.ALL if isinstance(r, P.Recognizer)] + [*P.GOES_ON.values(), X.DATES_PLAIN, X.CODES_PLAIN, X._VALUE, X._GOES_ON, X.CREDENTIAL_GUARD, D._NAMESPACE_KEY, D._CUT_KEY]
    classes = sorted({c for p in patterns for c in re.findall(r"\[(?:\\.|[^\]\\])+\]", p)} | {r"[a\]^-]", r"[\\\s]", "[\u00DF-\u00F6\u0370-\u0380]", "[&-]"})
    chars = spark.range(0, 0x400).select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    odd = [F.when(F.col("c").rlike(f"^{flag}{c}$") != F.col("c").rlike(f"^{flag}{S.singly(c)}$"), F.lit(c)) for c in classes for flag in ("", "(?i)")]
    assert chars.select(F.array_compact(F.array(*odd)).alias("odd")).filter(F.size("odd") > 0).collect() == []
    assert all(S.singly(S.singly(p)) == S.singly(p) for p in patterns)


def test_texts_without_six_digits_are_not_freed_from_prose(spark):
    rows = [("card 4111 1111 1111 1111 is mine",), ("one two three",), ("",), (None,), ("\uFDD0 ssn 536-90-4399 \uFDD1",)]
    found = spark.createDataFrame(rows, "text string").select(F.transform(D.recognized(F.col("text"), P.CARD, P.SSN), lambda s: F.struct(s["entity"], s["start"], s["value"])).alias("f")).collect()
    assert [[tuple(s) for s in r.f] for r in found] == [[("CREDIT_CARD", 5, "4111 1111 1111 1111")], [], [], [], [("US_SSN", 6, "536-90-4399")]]

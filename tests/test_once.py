"""Detection stands once in a plan: what a text holds is not searched again for a filter, an explosion or another use of the spans."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from duskloom.functions import context as X
from duskloom.functions.spans import PROSE
from duskloom.plans import load

QUERIES, _ = load()
#: Queries, and a pattern that each search of a text takes once; all recognizers search once for shapes and four times for credentials.
SEARCHES = {
    "token_scan": (PROSE, 5),
    "op_redact": (PROSE, 5),
    "cvv_spans": (X.CODES, 1),
    "context_boost": (PROSE, 1),
    "id_document_spans": (PROSE, 1),
    "medical_id_spans": (PROSE, 1),
    "op_local": (PROSE, 5),
    "document_found": (PROSE, 5),
    "uk_id_spans": (PROSE, 1),
    "category_gate": (PROSE, 1),
    "mint_tokens": (PROSE, 5),
    "op_mask": (PROSE, 5),
    "op_keep": (PROSE, 5),
    "entity_counts": (PROSE, 5),
    "dob_spans": (X.DATES, 1),
    "op_hash": (PROSE, 5),
    "op_broker": (PROSE, 5),
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("once"))
    spark.createDataFrame([(1, "mail a@b.io, cvv 123", "s"), (2, "none", "s")], "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", SEARCHES)
def test_texts_are_searched_once(spark, folder, name):
    pattern, most = SEARCHES[name]
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(pattern) <= most

"""The model slot, control-plane scalars and ledger streams."""

import pytest
from pyspark.sql import functions as F

from duskloom.operators import control as C
from duskloom.operators import detect as D
from duskloom.operators.model import Slot, model_spans
from duskloom.plans.policy import CustomRule, Policy
from duskloom.sources import files
from duskloom.streaming import events


def test_model_slot(spark):
    def names(texts):
        return [[(t.index("Ada"), t.index("Ada") + 3, "PERSON", 0.9)] if "Ada" in t else [] for t in texts]

    rows = spark.createDataFrame([(1, "by Ada"), (2, "none"), (3, None)], "id int, text string")
    slot = Slot()
    assert rows.select(F.size(model_spans(F.col("text"), slot)).alias("n")).first().n == 0
    first, second = slot.begin(), slot.begin()
    assert not slot.finish(first, names) and slot.state == "loading"
    assert slot.finish(second, names) and slot.state == "ready"
    got = {r.id: [(s.start, s.end, s.entity, s.value, s.source) for s in r.s] for r in rows.select("id", model_spans(F.col("text"), slot).alias("s")).collect()}
    assert got == {1: [(3, 6, "PERSON", "Ada", "ml")], 2: [], 3: []}
    broken = Slot(state="ready", model=lambda texts: [])
    with pytest.raises(Exception, match="answers"):
        rows.select(model_spans(F.col("text"), broken)).collect()
    with pytest.raises(RuntimeError, match="required"):
        model_spans(F.col("text"), Slot(required=True))


def test_control(spark, tmp_path):
    assert C.file_component("a/b c") == "a_b_c" and C.file_component("..") == "_" and len(C.file_component("x" * 500)) == 200
    assert C.base_url("https://a.io/v1/") == "https://a.io/v1"
    for wrong in ("ftp://a.io", "https://u:p@a.io", "https://a.io?x=1", "https://"):
        with pytest.raises(ValueError):
            C.base_url(wrong)
    assert C.control_token("k") != C.project_key("k")
    assert C.select({"a": "x"}, "a", None) == {} and C.select({}, "a", "x") == {"a": "x"}
    with pytest.raises(ValueError):
        C.select({str(i): "x" for i in range(1000)}, "new", "x")
    row = spark.createDataFrame([("contract", "m1", ["a"], ["a", "b"])], "basis string, model string, need array<string>, have array<string>")
    got = row.select(C.trust_grade(F.col("basis")).alias("g"), C.authorised(F.col("model"), ("m1",)).alias("a"), C.authorised(F.col("model"), ()).alias("b"), C.intake_open(F.col("need"), F.col("have")).alias("o"), C.intake_open(F.col("have"), F.col("need")).alias("c")).first()
    assert tuple(got) == (1, True, False, True, False)
    path = str(tmp_path / "edits.json")
    policy = Policy(allow=("v",), custom=(CustomRule("p", "X", surfaces=("tool_result",)),))
    C.save_policy_edits(path, policy)
    assert C.load_policy_edits(path, Policy()) == policy and C.load_policy_edits(path + "x", Policy()) == Policy()


def test_windowed_refusals(spark, tmp_path):
    rows = [(f"2026-05-29T10:{m:02d}:00Z", "p", "refused" if m % 2 else "passed", "URL", "body") for m in range(0, 40, 5)]
    frame = spark.createDataFrame(rows, files.LEDGER)
    assert sorted((r.start.minute, r.n) for r in events.windowed_refusals(frame).collect()) == [(0, 1), (10, 1), (20, 1), (30, 1)]
    files.append_ledger(frame, str(tmp_path / "in"))
    stream = events.windowed_refusals(files.ledger_stream(spark, str(tmp_path / "in")))
    feed = events.Feed()
    spark.streams.addListener(feed)
    query = stream.writeStream.format("memory").queryName("refused").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    spark.streams.removeListener(feed)
    assert spark.sql("SELECT sum(n) FROM refused").first()[0] == 4


def test_context_changes_what_is_kept(spark):
    rows = spark.createDataFrame([(1, "call my phone 415-555-2671"), (2, "order 415-555-2671")], "id int, text string")
    got = {r.id: len(r.s) for r in D.with_detected(rows, Policy(), name="s").collect()}
    assert got == {1: 1, 2: 0}

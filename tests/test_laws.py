"""Laws that hold for all inputs: restoring undoes masking, spans are disjoint, chunking doesn't matter, policies merge."""

from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskloom.functions import context as X
from duskloom.functions import patterns as P
from duskloom.functions import spans as S
from duskloom.functions import text as T
from duskloom.operators import apply as A
from duskloom.operators import detect as D
from duskloom.operators import gate
from duskloom.operators import ledger as L
from duskloom.operators import secrets as G
from duskloom.operators import unmask as U
from duskloom.operators import vault as V
from duskloom.plans.policy import CustomRule, Operator, Policy, from_settings, merged, problems, remasked, revealed, with_custom
from duskloom.sources import files, json_text
from duskloom.streaming import carry

TEXTS = ["mail ada@x.io or bob@y.org 😀 eve@z.de", "", None, "é 8.8.8.8 und 10.0.0.1", "card 4111 1111 1111 1111 ok", "a@b.io" * 2, "x@y.io,x@y.io", "no data at all", "ada@x.io\nada@x.io"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


def test_restoring_undoes_masking(texts):
    policy = Policy(profile="strict", overrides={"CREDIT_CARD": Operator("token")})
    rows = texts.withColumn("spans", D.detected(F.col("text"), policy, (P.EMAIL, P.IPV4, P.CARD)))
    masked = rows.withColumn("text", A.masked(F.col("text"), F.col("spans"), policy))
    found = rows.select(F.explode(A.manifest(F.col("spans"), policy)).alias("m")).select("m.token", "m.value", F.lit("pii").alias("kind"))
    back = U.unmasked(masked, "text", V.interned(found))
    assert {r.id: r.text for r in back.collect()} == dict(enumerate(TEXTS))
    seen = {r.id: r.text for r in masked.collect()}
    assert "ada@x.io" not in seen[0] and seen[0].count("[EMAIL_ADDRESS_") == 3 and "10.0.0.1" in seen[3] and "8.8.8.8" not in seen[3]
    assert seen[8].split("\n")[0] == seen[8].split("\n")[1]


def test_restoring_keeps_rows_apart(spark):
    """Repeated, null and empty keys, clashing names, repeated texts, and a vault that repeats a token."""
    rows = [(1, "a [T_000000000001]", "v"), (1, "b [T_000000000001]", "w"), (None, "c [T_000000000001]", None), (2, "", "x"), (3, None, "y"), (1, "a [T_000000000001]", "z"), (4, "[U_000000000009] [T_000000000001][T_000000000002]", "")]
    texts = spark.createDataFrame(rows, "id int, text string, token string")
    vault = spark.createDataFrame([("[T_000000000001]", "x@y.z"), ("[T_000000000001]", "x@y.z"), ("[T_000000000002]", 'q"\n')], "token string, value string")
    want = [(i, t and t.replace("[T_000000000001]", "x@y.z").replace("[T_000000000002]", 'q"\n'), k) for i, t, k in rows]
    assert sorted(map(str, map(tuple, U.unmasked(texts, "text", vault).collect()))) == sorted(map(str, want))
    escaped = {r.id: r.text for r in U.unmasked(texts, "text", vault, escape=True).collect()}
    assert escaped[4] == '[U_000000000009] x@y.zq\\"\\n'
    assert U.unmasked(texts.limit(0), "text", vault).count() == 0
    assert sorted(r.text or "" for r in U.unmasked(texts, "text", vault.limit(0)).collect()) == sorted(t or "" for _, t, _ in rows)


def test_context_far_before_a_value(spark):
    """Long words and long gaps before a value: the whole text before it is read where a window isn't enough."""
    rows = ["phone " + "x" * 300 + " 415-555-2671", "phone" + " " * 400 + "415-555-2671", "phone a b c d e 415-555-2671", "no " * 100 + "415-555-2671"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(D.recognized(F.col("t"), P.PHONE).alias("s")).collect()
    assert [round(r.s[0].score, 2) for r in got] == [0.75, 0.75, 0.4, 0.4]


def test_malformed_json_has_no_leaves(spark):
    rows = ['{"a": "x"}', "{", None, "", "[" * 400 + "]" * 400]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(json_text.leaves(F.col("t")).alias("l"), json_text.problem(F.col("t")).alias("p")).collect()
    assert [r.l is not None for r in got] == [True, False, False, False, False] and [r.p for r in got] == [None, "not_json", None, "not_json", "too_deep"]


def test_bodies_that_cannot_be_masked_are_refused(spark):
    """Nothing goes on in the clear: what isn't JSON, is nested too deep, or has a secret where nothing is rewritten."""
    rows = [(1, '{"id":"r1","text":"mail S3CRET"}', "x"), (2, '{"id":"a-S3CRET-b","text":"t"}', "x"), (3, '{"text":"t"', "x"), (4, "[" * 300 + '"t"' + "]" * 300, "x"), (5, None, "x"), (None, '{"id":"r1","text":"t"}', "x"),
            (6, '{"source":{"type":"base64","data":"S3CRET"}}', "x"), (7, '{"model":"pA","tools":[{"name":"ss"}]}', "x"), (7, '{"model":"PASS"}', "x"), (8, "", "x")]
    secrets = spark.createDataFrame([("k1", "S3CRET", True), ("k2", "pass", False), ("k3", "", True), ("k4", None, True)], "name string, value string, case_sensitive boolean")
    upper = lambda t: t.select("kind", "text", F.upper("text").alias("changed"))
    got = sorted(map(tuple, gate.gated(spark.createDataFrame(rows, "n long, body string, secret_of string"), "body", secrets, upper).select("n", "body", "refusal", "secret", "secret_of").collect()), key=str)
    want = [(1, '{"id":"r1","text":"MAIL S3CRET"}', None, None), (2, None, "secret_in_contract", "k1"), (3, None, "not_json", None), (4, None, "too_deep", None), (5, None, None, None), (None, '{"id":"r1","text":"T"}', None, None),
            (6, '{"source":{"type":"base64","data":"S3CRET"}}', None, None), (7, '{"model":"pA","tools":[{"name":"SS"}]}', None, None), (7, None, "secret_in_contract", "k2"), (8, None, "not_json", None)]
    assert got == sorted([(*w, "x") for w in want], key=str)
    assert gate.gated(spark.createDataFrame([], "n long, body string"), "body", secrets, upper).count() == 0


def test_masking_off_for_half_an_hour_by_default(spark):
    commands = spark.createDataFrame([("a", 0, True, None), ("b", 0, True, 10), ("c", 0, True, 10**6), ("d", 0, True, 50), ("d", 20, False, None)], "u string, s long, off boolean, seconds long").withColumn("at", F.timestamp_seconds("s"))
    places = [("a", 1799), ("a", 1800), ("b", 9), ("b", 10), ("c", 86_399), ("c", 86_400), ("d", 19), ("d", 20), ("e", 5)]
    events = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "event_id long, u string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r.event_id: r.off for r in L.masking_off(commands, events, "u").collect()}
    assert [got[i] for i in range(len(places))] == [True, False, True, False, True, False, True, False, False]


def test_characters_that_mark_cuts(spark):
    text = "\uFDD0a@b.io\uFDD1 c@d.io \uFDD2"
    got = spark.createDataFrame([(text,)], "t string").select(D.recognized(F.col("t"), P.EMAIL).alias("s")).first().s
    assert [(s.value, text[s.start : s.end]) for s in got] == [("a@b.io", "a@b.io"), ("c@d.io", "c@d.io")]


def test_manifest_places(texts):
    policy = Policy(profile="strict")
    rows = texts.filter("text <> ''").withColumn("spans", D.detected(F.col("text"), policy, (P.EMAIL, P.IPV4, P.CARD)))
    for r in rows.select("text", A.masked(F.col("text"), F.col("spans"), policy).alias("shown"), A.manifest(F.col("spans"), policy).alias("m")).collect():
        for m in r.m:
            assert r.text[m.start : m.end] == m.value and r.shown[m.masked_start : m.masked_end] == m.token


def test_spans_are_sorted_and_disjoint(texts):
    policy = Policy(profile="strict", custom=(CustomRule("x.io", "HOST"), CustomRule("[0-9]+", "NUMBER", is_regex=True)))
    for r in D.with_detected(texts.filter("text IS NOT NULL"), policy, name="s").collect():
        assert all(a.end <= b.start for a, b in zip(r.s, r.s[1:], strict=False))
        assert all(r.text[s.start : s.end] == s.value for s in r.s)


def test_salt_decides_the_token(spark):
    one = spark.range(1).select(T.token("a", "X", F.lit("v")).alias("t"), T.token("b", "X", F.lit("v")).alias("u"), T.token("a", "X", F.lit("v")).alias("w")).first()
    assert one.t == one.w != one.u and len(one.t) <= 63


def test_secrets_survive_the_allow_list(spark):
    policy = Policy(allow=("hunter2", "a@b.io"))
    secret = S.find_literal(F.col("text"), "hunter2", "DB", "secret")
    row = spark.createDataFrame([("pw hunter2 mail a@b.io at 2026-05-29",)], "text string").select(D.detected(F.col("text"), policy, (P.EMAIL,), secrets=secret, today=date(2026, 5, 29)).alias("s")).first()
    assert [s.entity for s in row.s] == ["DB"]


def test_golden_rows_of_labelled_values(spark):
    rows = {"DOB: 1990-01-02": "1990-01-02", "DOB:\n2023-11-15": "2023-11-15", "born January 2, 1990": "January 2, 1990", "DOB:\n\n\n\n123": None, "born to run, ETA 12/25": None}
    got = {r.t: [s.value for s in r.s] for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", X.birth_dates(F.col("t")).alias("s")).collect()}
    assert got == {t: [v] if v else [] for t, v in rows.items()}
    rows = {
        "card 4111111111111111 exp 03/27": "CREDIT_CARD_EXPIRATION", "expiration date 11/2028 on the visa": "EXPIRATION_DATE", "my gift card expires 03/26": "EXPIRATION_DATE", "subscription valid thru 12/25": "EXPIRATION_DATE", "4111 1111 1111 1111 exp 03/27": "CREDIT_CARD_EXPIRATION",
        "credit card on file, exp 03/27": "CREDIT_CARD_EXPIRATION", "export 03/27": None, "the cache expires 12/24": None, "certificate expires Jan 2026": None, "discard exp 03/27": None, "the discovery expires 03/27": None, "scorecard 1234 03/27": None, "0000000000000 exp 03/27": None,
    }
    got = {r.t: [s.entity for s in r.s] for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", X.expiries(F.col("t")).alias("s")).collect()}
    assert got == {t: [v] if v else [] for t, v in rows.items()}
    rows = {"CVV: 123": "123", "cvv2=4567": "4567", "123 (CVV)": "123", "security code 4821": "4821", "cvv is 123": "123", "the security code is 200 lines long": None, "cid=4096": None, '{"csc": 200}': None}
    got = {r.t: [s.value for s in r.s] for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", X.security_codes(F.col("t")).alias("s")).collect()}
    assert got == {t: [v] if v else [] for t, v in rows.items()}


@given(st.text("[]A_0f9 x", max_size=40), st.integers(1, 7))
def test_any_chunking_lets_out_the_same_text(text, size):
    held, out = "", ""
    for i in range(0, len(text), size):
        safe, held = carry.split_safe(held + text[i : i + size])
        out += safe
    assert out + held == text


def test_policy():
    assert merged({"a": {"x": 1, "y": 2}, "l": [1]}, {"a": {"y": 3}, "l": [2]}) == {"a": {"x": 1, "y": 3}, "l": [2]}
    assert problems({"threshold": 2, "overrides": {"NOPE": {"kind": "token"}}}) == ["threshold must lie between 0 and 1", "unknown entity NOPE"]
    assert problems({"overrides": {"NOPE": {"kind": "token"}}}, {"overrides": {"NOPE": {}}}) == []
    assert problems({"secrets": [{"name": "a", "value": "v"}]}) == ["secret a has its value inline"]
    policy = from_settings({"profile": "development_safe", "overrides": {"DATE_TIME": {"kind": "redact"}}})
    assert policy.floor == 0.6 and "DATE_TIME" in policy.entities() and "EMAIL_ADDRESS" not in policy.entities()
    assert Policy().operator_for("CVV").kind == "redact" and Policy().operator_for("CREDIT_CARD").kind == "mask"
    assert Policy().fingerprint() != Policy(allow=("x",)).fingerprint()
    assert Policy(overrides={"URL": Operator("hash")}).fingerprint() == Policy(overrides={"URL": Operator("redact")}).fingerprint() != Policy().fingerprint()
    shown = revealed(with_custom(Policy(), CustomRule("v", "X")), "v")
    assert shown.allow == ("v",) and shown.custom == () and remasked(shown, "v").allow == ()
    with pytest.raises(ValueError):
        from_settings({"threshold": -1})


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a.toml").write_text('profile = "strict"\n[overrides.URL]\nkind = "hash"\n')
    (tmp_path / "b.toml").write_text('profile = "minimal"\n')
    assert files.read_settings(str(tmp_path / "a.toml"), str(tmp_path / "none.toml"), str(tmp_path / "b.toml")) == {"profile": "minimal", "overrides": {"URL": {"kind": "hash"}}}
    state = str(tmp_path / "state.json")
    assert files.read_state(state) == ("absent", {})
    files.write_state(state, {"a": 1})
    files.write_state(state, {"a": 2}, backup=True)
    assert files.read_state(state) == ("loaded", {"a": 2}) and files.read_state(state + ".bak") == ("loaded", {"a": 1})
    (tmp_path / "state.json").write_text("{")
    assert files.read_state(state)[0] == "corrupt"
    events = spark.createDataFrame([("t", "p", "refused", "URL", "body", "value!")], "ts string, project string, action string, entity_class string, channel string, value string")
    files.append_ledger(events, str(tmp_path / "ledger"))
    files.append_ledger(events, str(tmp_path / "ledger"))
    assert spark.read.schema(files.LEDGER).json(str(tmp_path / "ledger")).count() == 2
    assert "value!" not in "".join(p.read_text() for p in (tmp_path / "ledger").glob("*.json"))
    (tmp_path / "t.jsonl").write_text('{"uuid":"a","type":"user"}\n\n{"uuid":"b","parentUuid":"a"}\n')
    assert [r.uuid for r in files.read_transcript(spark, str(tmp_path / "t.jsonl")).orderBy("idx").collect()] == ["a", "b"]
    monkeypatch.setenv("MY_SECRET", "v")
    (tmp_path / ".env").write_text("# c\nexport A='1'\nB=two\n")
    assert G.resolve("env:MY_SECRET") == "v" and G.resolve(f"dotenv:{tmp_path}/.env#A") == "1" and G.resolve(f"dotenv:{tmp_path}/.env#B") == "two"


def test_json_splice_keeps_the_rest():
    body = '{ "a" : 1.50, "b": ["x", {"c": "y\\"z"}], "x": "x" }'
    assert json_text.spliced(body, {}) == body and json_text.spliced("{", {}) is None
    texts = {json_text._digest("", "x"): "é", json_text._digest("", 'y"z'): 'q"'}
    assert json_text.spliced(body, texts) == '{ "a" : 1.50, "b": ["é", {"c": "q\\""}], "x": "é" }'
    assert json_text.spliced(body, texts, ("b",)) == '{ "a" : 1.50, "b": ["x", {"c": "y\\"z"}], "x": "é" }'


def test_json_bodies_that_were_hard(spark):
    """Null and repeated ids, malformed bodies, paths that read alike, repeated keys, clashing columns, an empty table."""
    rows = [
        (None, '{"t": "mail a@b.io"}', "x"), (1, '{"t": "mail a@b.io', "x"), (2, '{"t": "mail c@d.io"}', "y"), (2, '{"t": "mail e@f.io"}', "y"), (3, '{"a.b": "to a@b.io", "a": {"b": "to c@d.io"}}', "y"),
        (4, '{"k": "to a@b.io", "k": "to c@d.io"}', "y"), (5, None, "y"), (6, "", "y"), (7, "[" * 300 + "]" * 300, "y"), (8, '{"model": "m@x.io", "t": ["a@b.io", 1.50, null]}', None),
        (9, '{"context_management": {"edits": [{"type": "a@b.io", "note": "a@b.io"}]}}', "y"), (10, '"bare a@b.io"', "y"), (11, '{"t": "\\u0061@b.io"}', "y"),
    ]
    frame = spark.createDataFrame(rows, "id long, body string, _texts string").withColumn("kind", F.lit("k"))

    def upper(texts):
        return texts.withColumn("changed", F.regexp_replace("text", "[a-z]@[a-z]+[.]io", "[M]"))

    got = sorted(((r.id or 0, r.body) for r in json_text.with_leaves_changed(frame, "body", upper).collect()), key=str)
    want = [
        (0, '{"t": "mail [M]"}'), (1, None), (2, '{"t": "mail [M]"}'), (2, '{"t": "mail [M]"}'), (3, '{"a.b": "to [M]", "a": {"b": "to [M]"}}'), (4, '{"k": "to [M]", "k": "to [M]"}'), (5, None), (6, None), (7, None),
        (8, '{"model": "m@x.io", "t": ["[M]", 1.50, null]}'), (9, '{"context_management": {"edits": [{"type": "a@b.io", "note": "[M]"}]}}'), (10, '"bare [M]"'), (11, '{"t": "[M]"}'),
    ]
    assert got == sorted(want, key=str)
    assert json_text.with_leaves_changed(frame, "body", upper).columns == frame.columns
    assert json_text.with_leaves_changed(frame.limit(0), "body", upper).count() == 0

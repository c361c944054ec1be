"""Rows written by hand for what must and must not be masked, and work that grows with the length of a text or a conversation."""

import random
import time

from pyspark.sql import functions as F

from duskloom.functions import context as X
from duskloom.functions import spans as S
from duskloom.operators import apply as A
from duskloom.operators import conversation as C
from duskloom.operators import detect as D
from duskloom.operators import ledger as L
from duskloom.operators import secrets as G
from duskloom.operators import vault as V
from duskloom.plans.policy import Policy

STRICT = Policy(profile="strict")
#: Code and prose that no profile masks.
CLEAN = [
    "items.append(x)", "obj.config", "self.deepcopy(y)", "example.community", "np.core", "536-90-43991234", "x 1.2.3.4.5 y", "a::b", "logger.info(1)", "crate::config::Category", "pkg.sub.module.func", "./src/config.rs", "Cargo.toml",
    "a1b2c3d", "v0.10.0", "1.2.3", "0.0.0.0:8080", "std::collections::HashMap", "iban GB82WEST123456987654320000000000000000000000", "ssn 536-90-4399-1", "fe80::1", "at 12:30:45", "dead::beef",
]
#: Texts and the values that the strict policy masks.
FOUND = {
    "see example.com.": ["example.com"], "ssn 536-90-4399, ok": ["536-90-4399"], "from 8.8.8.8, ok": ["8.8.8.8"], "from 8.8.8.8.": ["8.8.8.8"], "host 2606:4700::1111 up": ["2606:4700::1111"], "host 2606:4700::1111: up": ["2606:4700::1111"], "www.example.org/x": ["www.example.org"],
    "DOB:" + " " * 250 + "\n1990-01-02": ["1990-01-02"], "DOB: " + "x" * 300 + " 1990-01-02": [], "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 exp 03/27": ["03/27"], "dob is 1 January 2000": [], "born on 01.02.2003 - 4 pm": [],
    "https://a.io/?token=hunter2&x=1 password: secret=xyz": ["hunter2", "secret=xyz"], "x%2525253Ftoken%2525253Dletmein4x": ["letmein4x"], "authorization: bearer " + "t" * 300: ["t" * 300],
}


def values(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)
    return {r.id: r.spans for r in D.with_detected(rows, STRICT, D.ALL).collect()}


def test_rows_by_hand(spark):
    got = values(spark, [*CLEAN, *FOUND])
    for i, text in enumerate([*CLEAN, *FOUND]):
        assert [s.value for s in got[i]] == FOUND.get(text, []), text
        assert all(text[s.start : s.end] == s.value for s in got[i])


def test_long_texts_take_time_in_proportion(spark):
    took = []
    for n in (4000, 16_000):
        mails, escapes = " ".join(f"u{i}@x{i % 7}.io" for i in range(n)), "token=%41b%20&" * n
        began = time.perf_counter()
        got = values(spark, [mails, escapes])
        took.append(time.perf_counter() - began)
        assert [s.value for s in got[0]] == mails.split(" ") and len(got[1]) == n and got[1][-1].end == len(escapes) - 1
        text = spark.createDataFrame([(mails,)], "text string")
        spans = S.find(F.col("text"), "()([a-z0-9]+@[a-z0-9.]+)", "EMAIL_ADDRESS", 1.0)
        shown = text.select(A.masked(F.col("text"), spans, STRICT).alias("t"), A.manifest(spans, STRICT).alias("m")).first()
        assert shown.t.count("[EMAIL_ADDRESS_") == n and all(shown.t[m.masked_start : m.masked_end] == m.token for m in shown.m)
    assert took[1] < 8 * took[0], took


def test_overlaps_in_many_clusters(spark):
    rng = random.Random(2)
    spans = sorted((a := rng.randrange(9000), a + rng.randrange(1, 12), rng.choice(["URL", "DOMAIN", "JWT"]), rng.choice([0.5, 0.6, 1.0]), rng.choice(["secret", "regex"]), "", False, i) for i in range(2500))
    got = spark.createDataFrame([(spans,)], f"s {S.SPANS}").select(S.resolve(F.col("s")).alias("s")).first().s
    kept = []
    for s in sorted(spans, key=lambda s: (S.TIERS[s[4]], -s[3], s[0] - s[1], s[7], s[0])):
        if all(k[1] <= s[0] or s[1] <= k[0] for k in kept):
            kept.append(s)
    assert [tuple(s) for s in got] == sorted(kept)


def test_card_numbers_over_many_groups(spark):
    rows = ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "99 4111111111111111", "4111-1111-1111-11112", "1234567890123456", "0000000000000", "4111 1111"]
    got = [sorted(r.c) for r in spark.createDataFrame([(t,) for t in rows], "t string").select(X.card_numbers(F.col("t")).alias("c")).collect()]
    assert "4111111111111111" in got[0] and "4111111111111111" in got[1] and "4111111111111111" in got[2] and got[3] == got[4] == got[5] == []


def test_ten_thousand_literals(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abAB") for _ in range(n))
    literals = [(f"n{i % 700}", word(rng.randrange(5, 9)), bool(i % 3)) for i in range(10_000)] + [("empty", "", True), ("null", None, True), ("quote", 'q"\\', None)]
    texts = [word(200) for _ in range(20)] + ["", None, 'a q"\\ İabABab', "İ" * 5 + word(60)]
    want = []
    for text in texts:
        hits = {(text.find(v, p), text.find(v, p) + len(v), n) for n, v, c in literals if v and text and (c or c is None) for p in range(len(text)) if text.startswith(v, p)}
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text or "")
        hits |= {(p, p + len(v), n) for n, v, c in literals if v and text and c is False for p in range(len(low)) if low.startswith(v.lower(), p)}
        want.append({(s, e, n) for s, e, n in hits})
    table = spark.createDataFrame(literals, "name string, value string, case_sensitive boolean")
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size in (G.LITERALS_BYTES, 150_000):  # broadcast at once, and in parts
        monkeypatch.setattr(G, "LITERALS_BYTES", size)
        got = {r.id: {(h.start, h.end, h.name) for h in r.hits} for r in G.literal_hits(frame, "text", table).collect()}
        assert [got[i] for i in range(len(texts))] == want
    pairs = spark.createDataFrame([("abc", "[1]"), ("bcd", "[2]"), ("abcde", "[3]"), ("x", "[4]")], "value string, handle string")
    shown = G.redacted(spark.createDataFrame([("abcde abcd bcdx",), (None,)], "t string"), "t", pairs).collect()
    assert [r.t for r in shown] == ["[3] [1]d [2][4]", None]


def brute_predecessors(turns):
    out = {}
    for c, t, own in turns:
        best = max(((len(own & other), u) for d, u, other in turns if d == c and u < t), default=(0, None))
        if best[0]:
            out[c, t] = best
    return out


def test_predecessors(spark):
    rng = random.Random(9)
    turns = [(c, t, {str(rng.randrange(12)) for _ in range(rng.randrange(1, 30))}) for c in "ab" for t in range(40)] + [("c", 1, {"z"}), ("c", 2, {"y"})]
    frame = spark.createDataFrame([(c, t, h) for c, t, own in turns for h in [*own, *own]], "conv string, turn long, hash string")
    got = {(r.conv, r.turn): (r.overlap, r.previous) for r in C.predecessors(frame, "conv", "turn", "hash").collect()}
    assert got == brute_predecessors(turns)


def test_predecessors_in_one_long_conversation(spark):
    """5,000 turns that all share their words and add one of their own each: the last turn is found by two hashes."""
    common = [f"w{i}" for i in range(30)]
    frame = spark.range(1, 5001).select(F.lit("c").alias("conv"), F.col("id").alias("turn"), F.explode(F.concat(F.array(*map(F.lit, common)), F.transform(F.sequence(F.greatest(F.col("id") - 5, F.lit(1)), F.col("id")), lambda i: F.concat(F.lit("own"), i.cast("string"))))).alias("hash"))
    got = {r.turn: (r.previous, r.overlap) for r in C.predecessors(frame, "conv", "turn", "hash").collect()}
    assert len(got) == 4999 and all(got[t] == (t - 1, 30 + min(t - 1, 5)) for t in range(2, 5001))


def test_sliding_counts(spark):
    rng = random.Random(1)
    for wide in (300, 5_000_000_000, 10_000_000):  # microseconds: all in one bucket, over many, about one
        at = [1_700_000_000_000_000 + rng.randrange(wide) for _ in range(400)] + [0, -5, 1_700_000_000_000_000] * 3
        frame = spark.createDataFrame([(x,) for x in at], "us long").groupBy("us").agg(F.count("*").alias("n"))
        for span in (0, 100, 300_000_000):
            got = {r.us: r.pending for r in L.within(frame, "us", "n", span).collect()}
            assert got == {x: sum(x - span <= y <= x for y in at) for x in at}


def test_promotions(spark):
    vault = spark.createDataFrame([("[A]", "a", "local"), ("[B]", "b", "pii"), ("[C]", "c", "broker"), ("[D]", "d", "local")], "token string, value string, kind string")
    asked = spark.createDataFrame([("s", "[A]"), ("s", "[A]"), ("s", "[B]"), ("t", "[C]"), ("t", "[D]"), (None, "[A]"), ("t", "[X]"), ("t", None)], "session string, token string")
    first = V.promoted(asked, vault, tombstones=vault.filter("token = '[D]'"))
    assert [tuple(r) for r in first.collect()] == [("s", "[A]")] and V.promoted(asked, vault, vault.filter("token = '[D]'"), known=first).count() == 0
    uses = spark.createDataFrame([(s, t) for s in "st" for t in ("[A]", "[B]", "[C]", "[X]")], "session string, token string")
    assert {(r.session, r.token): r.value for r in V.tool_values(uses, vault, first).collect() if r.value} == {("s", "[A]"): "a", ("s", "[B]"): "b", ("t", "[B]"): "b"}


def test_allow_entries_of_three_kinds(spark):
    policy = Policy(allow=("A@b.io",), allow_any_case=("C@d.IO",), allow_patterns=("^e[0-9]+@",))
    rows = spark.createDataFrame([("A@b.io a@b.io c@D.io e12@x.io ex@x.io",)], "text string")
    got = rows.select(D.detected(F.col("text"), policy, (D.P.EMAIL,)).alias("s")).first().s
    assert [s.value for s in got] == ["a@b.io", "ex@x.io"]

"""Conversations found by what their requests repeat, against the rule applied one request after the other."""

import hashlib
import random

from duskloom.operators import conversation as C

SCHEMA = "id long, at long, blocks array<string>"


def one_by_one(rows, known=()):
    standing, out = dict(known), {}
    for key, _, seq in sorted((r for r in rows if r[2] and None not in r[2]), key=lambda r: (r[1], r[0])):
        fits = [(-len(s), c) for c, s in standing.items() if s and seq[: len(s)] == s]
        base = f"auto-{seq[0]}"
        name = min(fits)[1] if fits else base if base not in standing else f"{base}-{hashlib.sha256('|'.join(seq).encode()).hexdigest()[:8]}"
        standing[name] = seq
        out[key] = name
    return out


def found(spark, rows, known=()):
    table = spark.createDataFrame(list(known), "conversation string, blocks array<string>") if known else None
    return {r.id: r.conversation for r in C.content_conversations(spark.createDataFrame(rows, SCHEMA), "id", "at", "blocks", table).collect()}


def test_rows_by_hand(spark):
    suffix = lambda *b: hashlib.sha256("|".join(b).encode()).hexdigest()[:8]
    rows = [(1, 1, ["a"]), (2, 2, ["a", "b"]), (3, 3, ["a", "z"]), (4, 4, ["a", "b", "c"]), (5, 5, ["a"]), (6, 6, ["a", "z", "y"]), (7, 7, ["a"]), (8, 8, []), (9, 9, None), (10, 10, ["a", None]), (11, 0, ["q", "r"])]
    want = {1: "auto-a", 2: "auto-a", 3: f"auto-a-{suffix('a', 'z')}", 4: "auto-a", 5: f"auto-a-{suffix('a')}", 6: f"auto-a-{suffix('a', 'z')}", 7: f"auto-a-{suffix('a')}", 8: None, 9: None, 10: None, 11: "auto-q"}
    assert found(spark, rows) == want


def test_known_conversations_and_ties(spark):
    known = [("k2", ["a", "b"]), ("k1", ["a", "b"]), ("k3", ["a"]), ("auto-n", ["n", "m"])]
    rows = [(1, 1, ["a", "b", "c"]), (2, 2, ["a", "b", "d"]), (3, 3, ["a", "x"]), (4, 4, ["n", "o"]), (5, 5, ["n", "m"]), (6, 6, ["b"])]
    assert found(spark, rows, known) == one_by_one(rows, known)
    assert found(spark, rows, known)[1] == "k1" and found(spark, rows, known)[2] == "k2"


def test_against_one_by_one(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(200), [rng.choice("abc") for _ in range(rng.randrange(1, 6))]) for i in range(700)]
    assert found(spark, rows) == one_by_one(rows)


def test_no_requests(spark):
    assert found(spark, []) == {}


def test_chain_grows_by_one_hash_a_block(spark):
    row = spark.createDataFrame([(1, 1, list("abcab"))], SCHEMA).select(C.prefix_chain("blocks").alias("c"), C.prefix_chain("blocks")[1].alias("two")).first()
    assert len(row.c) == 5 == len(set(row.c)) and row.two == row.c[1]

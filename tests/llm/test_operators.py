"""Each operator against brute force or its SQL, on small tables with nulls, empties, long texts, ties and repeats."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tools.compare import rows_of

from duskloom.llm import bpe, common, components, embed_dedup, exact_dedup, langid, license_rules, license_scan, license_signatures, mixing, quality, queries, simhash, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, fp long, __extra string"
A_LOT = "word " * 30_000


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 7, 7, "x") for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [
        (1, "Hello World", "en", "a"), (2, "hello world", "en", "a"), (3, "HELLO WORLD", None, None), (4, None, None, None), (5, "", "en", "b"),
        (6, " ", "en", "b"), (7, "Ünïcode ÄÖ", "de", "c"), (8, "ünïcode äö", "de", "c"), (9, A_LOT, "en", "a"), (10, A_LOT, "en", "a"),
        (11, "released under the MIT License. MIT license", "en", None), (11, "released under the MIT License. MIT license", "en", None), (12, "12345 !!", None, "d"),
        (13, "one", "en", "a"), (14, "é" * 5000, "fr", "a"), (15, "a  b\n\n c\t<|endoftext|>x", "en", "a"),
        (None, "nobody's text", "en", "a"), (None, "hello world", "en", None),
    ])


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held_by_sql(frame, sql, **tables):
    with duckdb.connect() as db:
        for name, rows in tables.items():
            db.register(name, rows)
        want = db.execute(sql).df()
    got = frame.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def arrow(df):
    return pa.Table.from_pandas(df.toPandas(), schema=pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[f.dataType.simpleString()]) for f in df.schema]))


def test_rows_beside_values_of_heavy_keys(spark):
    """Whatever number of keys counts as heavy, each row meets the value of its key once; keys without a value meet none."""
    keys = [7] * 500 + [8] * 60 + list(range(20, 80)) + [21] * 9 + [-1]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    counts = [(k, keys.count(k), f"v{k}") for k in sorted(set(keys)) if k != -1]
    values = spark.createDataFrame(counts, "k long, n long, v string")
    for heavy in (1, 3, 10, 1_000_000):
        met = common.beside(rows, values, "k", len(keys), heavy)
        assert met.columns == ["k", "i", "v"]
        assert sorted(map(tuple, met.collect())) == sorted((k, i, f"v{k}") for i, k in enumerate(keys) if k != -1)
        assert sum(n > len(keys) / heavy for _, n, _ in counts) <= heavy
    assert common.beside(rows.limit(0), values.limit(0), "k", 0).count() == 0


@pytest.mark.parametrize("heavy", [1, 4, 512])
def test_components_with_giant_stars(spark, heavy):
    """Stars whose centre is the least, the greatest or a middle node, joined by a chain."""
    edges = [(0, i) for i in range(1, 300)] + [(5000, i) for i in range(1000, 1300)] + [(2000, i) for i in [*range(1900, 2000), *range(2001, 2100)]]
    edges += [(299, 3000), (3000, 3001), (3001, 1000), (9000, 9001)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), heavy).collect()}
    want = {n: 0 for e in edges[:599] + edges[-4:-1] for n in e} | {n: 1900 for e in edges[599:-4] for n in e} | {9000: 9000, 9001: 9000}
    assert got == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}
    a, b = components.contract(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {3: 1, 5: 1, 9: 8}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark, odd, none):
    held_by_sql(exact_dedup.exact_dedup(odd), exact_dedup.ORACLE, documents=arrow(odd))
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r["__extra"]) for r in exact_dedup.keep_distinct(odd).collect())
    assert kept == [(i, "x") for i in (-1, 3, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15)]
    assert exact_dedup.keep_distinct(none).count() == 0


def test_exact_dedup_with_heavy_groups(spark):
    rng = random.Random(1)
    rows = [(i, f"hot{i % 3}" if i % 3 else f"t{rng.randrange(400)}", "en", "a") for i in range(3000)]
    docs = table(spark, rows).repartition(7)
    heavy = exact_dedup.heavy_digests(docs.select("doc_id", exact_dedup.digest_of(docs.text).alias("digest")), counters=8).collect()
    assert {(r.keep_id, r.group_size) for r in heavy} == {(2998, 1000), (2999, 1000)}
    held_by_sql(exact_dedup.exact_dedup(docs, counters=8), exact_dedup.ORACLE, documents=arrow(docs))
    best = {}
    for i, t, _, _ in rows:
        best[t] = max(best.get(t, -1), i)
    twice = docs.union(docs.filter("doc_id % 10 = 9 OR doc_id >= 2990"))
    for most in (None, 5):  # keys of dropped rows broadcast, or joined by shuffle
        assert sorted(r.doc_id for r in exact_dedup.keep_distinct(twice, counters=8, most=most).collect()) == sorted(best.values())


def test_misra_gries_bound():
    rng = random.Random(2)
    stream = [b"h"] * 300 + [str(rng.randrange(500)).encode() for _ in range(700)]
    rng.shuffle(stream)
    batches = [pa.record_batch({"digest": pa.array(stream[i : i + 50], pa.binary())}) for i in range(0, 1000, 50)]
    out = next(exact_dedup.misra_gries(iter(batches), 9)).to_pydict()
    counts = dict(zip(out["digest"], out["n"], strict=True))
    assert len(counts) <= 9 and 300 - 1000 / 10 <= counts[b"h"] <= 300


def brute_mixed(h, sketch):
    if sketch:
        h = (h + sketch * 0x9E3779B97F4A7C15) % 2**64
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
        h ^= h >> 31
    return h


def brute_fingerprint(text, size=3, sketch=0):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(text))]
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [brute_mixed(xxhash.xxh64_intdigest(s, 42), sketch) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_linked(x, y):
    """Sketches of several words: at most 91 bits differ in all, and one of five pieces of some word, of 12 or 13 bits each, is equal."""
    far = [a ^ b for a, b in zip(x, y, strict=True)]
    return sum(f.bit_count() for f in far) <= 91 and any(f >> low & (1 << high - low) - 1 == 0 for f in far for low, high in ((0, 12), (12, 25), (25, 38), (38, 51), (51, 64)))


def brute_components(fps, linked=lambda x, y: (x[0] ^ y[0]).bit_count() <= 2):
    root = {i: i for i in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if linked(fps[i][1:], fps[j][1:]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, *_) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, f"{fp:016x}", least[find(i)]) for i, (doc, fp, *_) in enumerate(fps)]


def near_copies(n=150):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(80)) for _ in range(5)]
    rows = []
    for i in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(9)}"
        rows.append((1000 - i, " ".join(words), "en", "a"))
    return rows


@pytest.mark.parametrize("tile_rows", [65_536, 3])
def test_simhash(spark, odd, tile_rows):
    rows = near_copies() + [(5000 + i, t, "en", "a") for i, t in enumerate(["", None, " \t\x1c", "A b", "a\x0bB", "x y z"])]
    want = brute_components([(i, brute_fingerprint(t)) for i, t, _, _ in rows])
    got = simhash.simhash_components(table(spark, rows), tile_rows=tile_rows).collect()
    assert sorted((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got) == sorted(want)
    if tile_rows > 3:
        want = brute_components([(i, *[brute_fingerprint(t, 5, k) for k in range(8)]) for i, t, _, _ in rows], brute_linked)
        assert sorted(r.doc_id for r in simhash.keep_one_of_each(table(spark, rows)).collect()) == sorted({c for _, _, c in want})


@pytest.mark.parametrize("crowd", [2048, 20])
def test_simhash_crowds_are_joined_as_by_all_pairs(crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "STEP_ROWS", 7)
    monkeypatch.setattr(simhash, "STEP_COLUMNS", 11)
    rng = np.random.default_rng(5)
    middle = rng.integers(0, 2**63, (3, 2), dtype=np.uint64)
    rows = np.repeat(middle, [200, 60, 5], axis=0)
    for _ in range(4):
        rows[np.arange(len(rows)), rng.integers(0, 2, len(rows))] ^= np.uint64(1) << rng.integers(0, 64, len(rows)).astype(np.uint64)
    node = rng.permutation(len(rows))
    for radius in (1, 3, 5):
        links = list(simhash._crowd_links(rows, node, radius))
        got = components.contract(np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links]))
        i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ rows[None]).sum(axis=2) <= radius)
        want = components.contract(node[i], node[j])
        assert dict(zip(*map(np.ndarray.tolist, got), strict=True)) == dict(zip(*map(np.ndarray.tolist, want), strict=True))


def test_simhash_recall_by_similarity(spark):
    """Copies with some of 200 words replaced: those of a five-word similarity well above 0.8 go, those well below it stay."""
    rng = random.Random(8)
    rows, word = [], lambda: f"w{rng.randrange(100_000)}"
    for i in range(60):
        words = [word() for _ in range(200)]
        rows.append((10 * i, " ".join(words)))
        for k, replaced in enumerate((1, 2, 12)):  # similarities of 0.95, 0.90 and, by and large, 0.55
            copy = list(words)
            for at in rng.sample(range(5, 195), replaced):
                copy[at] = word()
            rows.append((10 * i + 1 + k, " ".join(copy)))
    kept = dict.fromkeys(range(4), 0)
    for r in simhash.keep_one_of_each(table(spark, [(i, t, "en", "a") for i, t in rows])).collect():
        kept[r.doc_id % 10] += 1
    assert kept[0] == 60 and kept[1] <= 2 and kept[2] <= 9 and kept[3] >= 57, kept


@pytest.mark.parametrize("similarity, least", [(0.80, 0.9), (0.825, 0.95), (0.85, 0.97), (0.9, 0.99)])
def test_recall_of_the_near_stage(similarity, least):
    """400 pairs of texts of 404 words whose five-word shingles have just that similarity: the share that links."""
    rng, words_of = random.Random(int(1000 * similarity)), lambda t: [simhash.fingerprint(t, 5, sketch=k) for k in range(simhash.KEEP_SKETCHES)]
    replaced = round(400 * (1 - similarity) / (1 + similarity) / 5)
    linked = 0
    for _ in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(404)]
        copy = list(words)
        for at in rng.sample(range(4, 400, 5), replaced):
            copy[at] = f"x{rng.randrange(10**6)}"
        linked += brute_linked(words_of(" ".join(words)), words_of(" ".join(copy)))
    assert linked >= least * 400, linked


def test_simhash_keeps_texts_that_share_an_id(spark):
    one, two = "alpha beta gamma delta " * 30, "eins zwei drei vier " * 30
    docs = table(spark, [(1, one, "en", "a"), (5, one, "en", "a"), (5, two, "en", "a"), (5, two, "en", "a"), (7, two, "de", "b"), (None, one, "en", "a")])
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one_of_each(docs).collect())
    assert kept == [(0, one), (1, one), (5, two), (5, two)]
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


def test_simhash_edges(odd, none):
    assert {len(r.fingerprint) for r in simhash.simhash_dedup(odd).collect()} == {16}
    assert simhash.simhash_dedup(odd).count() == odd.count()
    assert simhash.simhash_dedup(none).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.bpe_path())


def test_bpe_is_the_library(tokenizer):
    own = bpe.BytePairs(open(queries.bpe_path(), encoding="utf-8").read())
    rng = random.Random(4)
    letters = "aaabcdeths  \n\t'strevelld  0129.,!é日😀  ́<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" * 4000, "ab" * 999, "=" * 900, " " * 500, "\n" * 99, "", " ", " a", "a ", "a\n", "\na", "x  y", "x \ny", "<|endoftext|>", "a <|endoftext|> b", "the\r\nend", *map(chr, range(0x20, 0x3000, 3))]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == tokenizer.decode(want, skip_special_tokens=False), text
    assert own.decode(np.array([own.encode("é")[0]], "<u4").tobytes()) in ("�", "é", tokenizer.decode([own.encode("é")[0]]))


def test_bpe_queries(spark, odd, none, tokenizer):
    path = queries.bpe_path()
    want = []
    for r in odd.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (r.text or "")))
    assert sorted(map(str, map(tuple, bpe.bpe_digests(odd, path).collect()))) == sorted(map(str, want))
    assert sorted(str((r.doc_id, r.text)) for r in bpe.bpe_decode(bpe.bpe_encode(odd, path), path).collect()) == sorted(str((r.doc_id, r.text or "")) for r in odd.collect())
    assert bpe.bpe_digests(none, path).count() == bpe.bpe_encode(none, path).count() == 0


def brute_grams(text):
    counts = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = f" {word} "
        counts.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    return counts


def brute_language(text, profiles, size):
    own = sorted(c := brute_grams(text), key=lambda g: (-c[g], g))[:size]
    if not own:
        return "und", 0.0
    away = {lang: sum(abs(grams.index(g) - i) if g in grams else size for i, g in enumerate(own)) for lang, grams in profiles.items()}
    best = min(sorted(away), key=away.get)
    return best, 1 - away[best] / (size * len(own))


def test_language_id(spark, odd, none):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice({"en": ["the", "thing", "with"], "de": ["der", "straße", "mit"]}[lang]) for _ in range(12)), lang, "a") for i in range(60) for lang in ["en", "de"][i % 2 : i % 2 + 1]]
    docs = table(spark, rows)
    profiles = langid.learn_profiles(langid.training_rows(docs), size=40)
    totals = defaultdict(Counter)
    for i, t, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            totals[lang].update(brute_grams(t))
    want = {lang: sorted(c, key=lambda g: (-c[g], g))[:40] for lang, c in totals.items()}
    assert {lang: list(map(langid.spell, grams)) for lang, grams in profiles.items()} == want
    for r in langid.predict_languages(odd.select("doc_id", "text"), profiles, size=40).collect():
        lang, score = brute_language(r.text, want, 40)
        assert (r.lang_pred, pytest.approx(r.score)) == (lang, score)
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    assert all(got[i].lang_pred == lang and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, lang, _ in rows)
    assert langid.language_id(none).count() == 0
    assert {r.lang_pred for r in langid.predict_languages(odd.select("text"), {}).collect()} == {"und"}
    assert langid.language_id(odd).count() == odd.count()


def test_license_scan(spark, odd, none):
    rows = [(100 + i, t, "en", "a") for i, t in enumerate([
        "Licensed under the Apache License, Version 2.0. apache license", "GNU Lesser General Public License v2.1", "SPDX-License-Identifier: GPL-3.0-or-later",
        "CC BY-NC-SA 4.0 license and cc-by license", "mit license mit license", "mit licenses", "smit license", "mit é license", "The MIT licence is under the BSD 3-clause license",
        "general public license " * 400, "Released under the Mozilla Public License 2.0", "license", "under copyright",
    ])]
    docs = odd.unionByName(table(spark, rows))
    held_by_sql(license_scan.license_scan(docs), license_scan.ORACLE, documents=arrow(docs))
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert got[100].labels == "apache,apache-2.0" and got[100].first_word == 3 and got[100].last_word == 8
    assert got[101].labels == "gpl,lgpl-2.1" and got[102].labels == "gpl-3.0" and got[102].score == 1.0
    assert (got[104].n_base, got[104].first_word, got[104].last_word) == (2, 0, 2)
    assert got[105].n_base == got[106].n_base == got[107].n_base == 0 and got[109].n_base == 400
    assert license_scan.license_scan(none).count() == 0
    found = {r.doc_id: r.found for r in license_scan.scan_licenses(docs).collect()}
    assert [(d.label, d.start, d.end) for d in found[110]] == [("mpl-2.0", 0, 8)]


def required(pattern):
    """A pattern without its optional parts."""
    while (less := re.sub(r"\[a-z0-9 \]\{\d+,\d+\}", " ", re.sub(r"\(\?:[^()]*\)\?", "", pattern))) != pattern:
        pattern = less
    return pattern


def test_license_rules_need_their_keyword():
    assert len(license_rules.rules()) > 1000 and len(license_signatures.BODIES) > 120
    for rule in license_rules.rules():
        assert rule.keyword in re.split("[^a-z0-9]+", required(rule.pattern)), rule


def test_license_bodies(spark):
    rows = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction": "mit",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": "bsd",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl-3.0",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS": "apache-2.0",
        "This is free and unencumbered software released into the public domain.": "unlicense", "CC0 1.0 Universal": "cc0-1.0", "under NASA Open Source Agreement 1.3": "nasa-1.3", "plain prose about nothing": "",
    }
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(rows)], "doc_id long, text string, labels string, n_words int")
    for r, want in zip(sorted(license_scan.license_scan(docs).collect()), rows.values(), strict=True):
        assert want in r.labels.split(",") and (r.score >= 0.6) == bool(want), (want, r)
    held_by_sql(license_scan.license_scan(docs), license_scan.ORACLE, documents=docs.select("doc_id", "text").toPandas())


def test_licences_without_a_licence_word_are_found(spark):
    texts = ["This work is CC0 1.0 Universal.", "NASA Open Source Agreement 1.3", "nasa open source agreement", "cc0 universal", "nasa", "cc0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_scan(docs).collect()}
    assert got == {0: ("cc0-1.0", 0.75), 1: ("nasa-1.3", 0.75), 2: ("nasa", 0.6), 3: ("cc0", 0.6), 4: ("", 0.0), 5: ("", 0.0)}


def test_mixing(spark, odd, none):
    held_by_sql(mixing.source_mixing(odd), mixing.ORACLE, documents=arrow(odd))
    assert mixing.source_mixing(none).count() == 0
    docs = table(spark, [(i, "x" * 10, "en", "big" if i % 10 else "small") for i in range(20_000)])
    got = Counter(r.source for r in mixing.mix_sources(docs, {"big": 1, "small": 3}).collect())
    assert abs(got["big"] - 5000) < 5 * 5000**0.5 and abs(got["small"] - 15_000) < 5 * (15_000 * 8.5) ** 0.5
    rates = spark.createDataFrame([("small", 40.0), ("big", 0.0)], "source string, rate double")
    counts = Counter(r.doc_id for r in mixing.replicated(docs, rates).collect())
    sizes = np.array([counts.get(i, 0) for i in range(0, 20_000, 10)])
    assert abs(sizes.mean() - 40) < 0.8 and abs(sizes.var() - 40) < 6
    assert [r.doc_id for r in mixing.mix_sources(docs).collect()] == [r.doc_id for r in mixing.mix_sources(docs.repartition(9)).collect()]


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark, odd, none):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert area(got.score.values, got.quality.values) > 0.97
    empty = labels.limit(0)
    assert {(r.score, r.predicted) for r in quality.quality_scores(odd, empty).collect()} == {(0.5, 1)} and quality.quality_scores(none, empty).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.quality_scores(odd, labels).collect())
    assert len(quality.features(A_LOT)) == len(quality.FEATURES) and not any(quality.features(None) + quality.features(" "))


def rows_like(rng, n, at):
    return rng.normal(at, 1, (n, len(quality.FEATURES)))


def test_nnpu_separates_without_negatives():
    rng = np.random.default_rng(0)
    good, bad = rows_like(rng, 3000, 0.4), rows_like(rng, 1000, -0.6)
    x, trusted = np.vstack([good, bad]), np.arange(4000) < 1500
    model = quality.fit(quality.gathered_here(x, trusted))
    assert abs(model.prior - 0.75) < 0.08
    score = lambda x: np.clip((x - model.mean) / model.scale, -8, 8) @ np.array(model.weights) + model.bias
    assert (score(good[1500:]) > 0).mean() > 0.9 and (score(bad) < 0).mean() > 0.85


def test_nnpu_is_the_least_risk():
    """Newton steps against plain descent on the risk by finite differences, at a given prior."""
    rng = np.random.default_rng(8)
    x, trusted, prior = np.vstack([rows_like(rng, 300, 0.2), rows_like(rng, 200, -0.2)]), np.arange(500) < 200, 0.6
    model = quality.fit(quality.gathered_here(x, trusted), prior)
    z = np.column_stack([np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8), np.ones(500)])

    def risk(w):
        g = z @ w
        away = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[trusted]).mean()
        return prior * np.logaddexp(0, -g[trusted]).mean() + away + quality.DECAY / 2 * (w[:-1] ** 2).sum(), away

    w = np.append(model.weights, model.bias)
    least, away = risk(w)
    assert away >= 0 and all(risk(w + d)[0] >= least - 1e-6 for d in np.vstack([np.eye(16), -np.eye(16)]) * 0.01)


def test_quality_sums_are_those_of_all_rows(spark):
    """Every row counts, whatever its doc_id: a flood of rows with a null id, repeated ids, many partitions."""
    rng = np.random.default_rng(9)
    docs = [(None if i % 3 else i, " ".join(rng.choice(["good", "Text", "1", "!!", "word."], size=1 + i % 40)), "en", "a") for i in range(600)]
    measured = quality.with_features(table(spark, docs)).repartition(7)
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(0, 600, 3)], "doc_id long, quality int")
    model = quality.learn(measured, labels)
    x = np.array([quality.features(t) for _, t, _, _ in docs])
    want = quality.fit(quality.gathered_here(x, np.array([i is not None and i % 2 == 0 for i, _, _, _ in docs])))
    assert np.allclose(model.weights, want.weights, atol=1e-6) and abs(model.bias - want.bias) < 1e-6 and abs(model.prior - want.prior) < 1e-9


def test_toxicity_on_held_out_labels(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity_scores(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert area(got.score.values, got.toxic.values) > 0.9
    assert (got.predicted[got.toxic == 1] == 1).mean() > 0.85 and (got.predicted[got.toxic == 0] == 1).mean() < 0.01
    empty = labels.limit(0)
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(odd, empty).collect())
    assert toxicity.toxicity_scores(none, empty).count() == 0


def test_boosting_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = toxicity.boost(x[:3000], y[:3000])
    assert ((trees.sums(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0.0, 1, 0, 1, 1, 1]))
    assert (np.diff(values) >= 0).all() and np.interp(2.5, knots, values) == pytest.approx(0.5)
    assert len(toxicity.boost(np.zeros((0, 3)), np.zeros(0)).sums(x[:2])) == 2


def test_toxicity_lexicon_by_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["fool", "foolish", "tree", "house", "you", "rain"][(0 if i % 3 == 0 else 2):]) for _ in range(6)), int(i % 3 == 0), i % 12) for i in range(120)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int, part long").repartition(3)
    counts = toxicity.word_counts(sample)
    sizes = Counter((p % 2, y) for _, _, y, p in rows)
    for halves in ((0, 1), (0,), (1,)):
        own = [(set(t.split()) | {w[:n] + "*" for w in t.split() for n in toxicity.BEGINNINGS if len(w) > n}, y) for _, t, y, p in rows if p % 2 in halves]
        n = [sum(y == k for _, y in own) for k in (0, 1)]
        want = dict.fromkeys(toxicity.INSULTS, 1.0)
        for word in set().union(*[w for w, _ in own]):
            kind, hits = ("beginning" if word.endswith("*") else "word"), [sum(word in w and y == k for w, y in own) for k in (0, 1)]
            weight = np.log((hits[1] + 0.5) / (n[1] + 1)) - np.log((hits[0] + 0.5) / (n[0] + 1))
            if hits[1] >= toxicity.SUPPORT[kind] and weight >= np.log(toxicity.LIFT[kind]):
                want[word] = weight
        learned = toxicity.learn_lexicon(counts, sizes, halves)
        assert learned.weights == pytest.approx(want) and len(want) > 0
        assert toxicity.features("fool foolish tree you", learned) == pytest.approx(toxicity.features("fool foolish tree you", toxicity.Lexicon(want)))


def test_samples_never_vanish_and_labels_beyond_two(spark):
    rows = spark.range(20_000)
    assert 800 < common.sampled(rows, 1000, "id", salt="x").count() < 1200 and common.sampled(rows, 20_000, "id", salt="x").count() == 20_000
    assert spark.range(1).select((F.lit(20_000 / 5e10) * common.GRAINS).cast("long")).first()[0] > 10**12
    docs = table(spark, [(i, "you fool" if i % 2 else "rain", "en", "a") for i in range(60)] + [(7, "you fool", "en", "a")] * 500 + [(None, "you fool", "en", "a")] * 50)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 2), (4, None), (None, 1)] + [(7, 1)] * 300, "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 610 and all(0 <= r.score <= 1 for r in got)


def test_toxicity_features():
    lexicon = toxicity.Lexicon({"idiot": 2.0, "blor*": 3.0})
    got = dict(zip(toxicity.FEATURES, toxicity.features("You are an IDIOT, blorfen! 1d1ot id1ot", lexicon), strict=True))
    assert got["distinct"] == 2 and got["near"] == 1.0 and got["masked"] >= 1 and got["shouts"] > 0
    assert not any(toxicity.features(None, lexicon))


def brute_vectors(rows, cosine=0.93):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = defaultdict(set)
    for i, j in itertools.combinations(range(len(rows)), 2):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
            a, b = np.array(a, float), np.array(b, float)
            if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out)


@pytest.mark.parametrize("cell_rows", [2048, 25])
def test_embedding_dedup(spark, cell_rows):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=8)
        rows += [((centre + rng.normal(size=8) * rng.choice([0.02, 0.3])).astype(np.float32).tolist(), c % 2) for _ in range(12)]
    rows += [(rng.normal(size=8).astype(np.float32).tolist(), int(i % 3)) for i in range(60)]
    rows += [rows[0]] * 40 + [(None, 1), ([], 1), ([0.0] * 8, 1), ([float("nan")] * 8, 1), ([1.0, None] * 4, 1), ([float("inf")] + [1.0] * 7, 1), ([1.0] * 8, None), ([1.0] * 8, 1), ([2.0] * 8, 1), ([1.0] * 4, 1), ([1e-30] * 8, 1)]
    rows = [(900 - i, v, label) for i, (v, label) in enumerate(rows)]
    got = embed_dedup.embedding_dedup(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string"), cell_rows=cell_rows)
    assert sorted(tuple(r) for r in got.collect()) == brute_vectors(rows)
    assert embed_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("all_pivots", [8192, 8, 0])
def test_embedding_dedup_of_large_labels(spark, all_pivots):
    """Several labels beyond a cell, ids with a common factor, and more labels than there are pivots for."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(64 * i, (centres[i % 6] + rng.normal(size=8) * [0.05, 0.2, 1.0][i % 3]).astype(np.float32).tolist(), i % 4) for i in range(400)]
    got = embed_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cell_rows=20, all_pivots=all_pivots)
    assert sorted(tuple(r) for r in got.collect()) == brute_vectors(rows)


def test_cover_tree_prunes_clusters_and_covers():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    points = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 16)) * 0.05
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree, met = embed_dedup.build(points), [0] * (len(embed_dedup.LEVELS) + 2)
    found = sum(len(i) for i, _ in embed_dedup.near_pairs(tree, tree, 0.93, True, met))
    assert found >= 40 * 50 * 49 // 2 and sum(met) < 2000 * 1999 // 2 / 8
    for k, radius in enumerate(tree.radius):  # every point lies within its node's radius, on each level
        below = [np.array([i]) for i in range(len(tree.nodes[-1]))]
        for level in range(len(tree.children) - 1, k - 1, -1):
            below = [np.concatenate([below[c] for c in own]) for own in tree.children[level]]
        for node, far, leaves in zip(tree.nodes[k], radius, below, strict=True):
            assert np.linalg.norm(points[tree.nodes[-1][leaves]] - points[node], axis=1).max() <= far + 1e-6
    assert len(embed_dedup.build(points[:0]).points) == 0 and len(embed_dedup.build(points[:1]).nodes[-1]) == 1


def test_cover_tree_pairs_are_exact():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 6))
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = embed_dedup.build(points)
    assert all(set(a.tolist()) <= set(b.tolist()) for a, b in itertools.pairwise(tree.nodes))
    listed = [tuple(sorted((int(a), int(b)))) for i, j in embed_dedup.near_pairs(tree, tree, 0.8, True) for a, b in zip(i, j, strict=True)]
    got = set(listed)
    assert len(got) == len(listed)
    cosine = points @ points.T
    want = {(i, j) for i, j in itertools.combinations(range(300), 2) if cosine[i, j] >= 0.8}
    assert want <= got and all(cosine[p] > 0.8 - 1e-4 for p in got)


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/x", "https://example.org/en/12?q", "https://x.org", "https://x.org/", "http://a.com/de/1", "http://a.com/fr", "http://com/fr/", "http://notcom/de/", "ftp://free-bets.io/x#y",
            "http://a.net?u=://b.com/de/", "no-scheme.com/de/", "", None, "://", "http://www.casino.example.net/en", "http://casino-royale.net/", "http://org/es/", "http://w.net/p/wp-login.php", "http://example.org:80/es/"]
    pages = spark.createDataFrame([(i, u, "<p>", "x") for i, u in enumerate(urls + urls[:1])], "page_id long, url string, html string, host string")
    held_by_sql(url_filter.filter_urls(pages), url_filter.ORACLE, pages=arrow(pages))
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    assert got[0].rule == "example.org/es/" and got[1].verdict == "block" and got[2].rule is None and got[4].verdict == "block"
    assert got[14].verdict == "block" and got[15].verdict == "allow" and got[17].verdict == "block" and got[8].host == "free-bets.io"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    rules = url_filter.rules_table(spark)
    for r in url_filter.filed(pages, rules).collect():
        assert r.token in url_filter.PATTERN_RULES[r.n].tokens


@pytest.mark.parametrize("in_plan", [50_000, 100])
def test_url_rules_from_a_large_table(spark, tmp_path, in_plan):
    """20,000 rules read from a table, in the plan or joined; long, null, empty and repeated URLs; one URL in a third of all rows."""
    rng = random.Random(12)
    rules = [("allow" if n % 9 == 0 else "block", [f"w{n}", f"common{n % 3}"], rf"w{n}[-_./]+common{n % 3}(?:[^a-z0-9]|$)") for n in range(20_000)]
    spark.createDataFrame([(n, *r) for n, r in enumerate(rules)], "n int, action string, tokens array<string>, pattern string").write.parquet(str(tmp_path / "rules"))
    urls = [f"http://h{i % 7}.net/w{(k := rng.randrange(20_000))}{'-' if i % 2 else '/x/'}common{k % 3}/?q=W{rng.randrange(20_000)}" for i in range(200)]
    urls += ["http://hot.net/w5/common2"] * 100 + [None, "", "http://x.net/" + "common0/w3-common0/" * 5000, "http://a.net/w9-common0/w10-common1"]
    pages = spark.createDataFrame([(i, u, "p") for i, u in enumerate(urls)], "page_id long, url string, pattern string")
    got = {r.page_id: (r.verdict, r.pattern_rule) for r in url_filter.filter_urls(pages, rules=url_filter.rules_table(spark, str(tmp_path / "rules")), in_plan=in_plan).collect()}
    for i, u in enumerate(urls):
        hits = sorted((rules[n][0] != "allow", n) for w in set(re.findall("w([0-9]+)", (u or "").lower())) if (n := int(w)) < 20_000 and re.search(rules[n][2], (u or "").lower()))
        assert got[i] == ((rules[hits[0][1]][0], hits[0][1]) if hits else ("allow", None)), u and u[:80]


def test_pipeline_by_brute_force(spark, tmp_path, tokenizer):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).unionByName(spark.createDataFrame([(10**6, None, None, "src0", None), (10**6 + 1, "123", "en", "src1", 3)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "round_trip").collect())
    rows = {r.doc_id: r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    best = {}
    for r in rows.values():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    fps = [(i, *[brute_fingerprint(rows[i].text, 5, k) for k in range(8)]) for i in best.values()]
    left = sorted({c for _, _, c in brute_components(fps, brute_linked)})
    rates = {}
    chars = Counter()
    for i in left:
        chars[rows[i].source] += len(rows[i].text)
    total, weights = sum(chars.values()), {s: n**mixing.TEMPERATURE for s, n in chars.items()}
    rates = {s: w / sum(weights.values()) * total / chars[s] for s, w in weights.items()}
    want = Counter()
    for i in left:
        rate = rates[rows[i].source]
        draws, copies = int(np.ceil(rate / mixing.MEAN_A_DRAW)), 0
        for n in range(1, draws + 1):
            u = (int(hashlib.sha256(f"{mixing.SEED}:{i}:{n}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            k, p = 0, np.exp(-rate / draws)
            below = p
            while u >= below:
                k, p = k + 1, p * (rate / draws) / (k + 1)
                below += p
            copies += k
        ids = tokenizer.encode(rows[i].text, add_special_tokens=False).ids
        if copies:
            want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), True)] = copies
    assert got == want
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_registry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)

"""SimHash near-deduplication by tiled exact comparison.

Each word of a fingerprint is cut into pieces. Fingerprints that share a piece meet: more pieces than the radius has bits leave one whole in any
pair within the radius, so none is missed. Those that meet are sorted by population count and cut into tiles; pairs of tiles
whose counts differ by more than the radius are skipped, in the others numpy compares by exclusive-or and bit counts.
Each task contracts the links it finds to at most one a fingerprint, so that a large group never yields all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, beside, map_batches, saved, without
from .components import connected_components, contract

SHINGLE = 3
RADIUS = 2
SEED = 42

#: What keep_one_of_each takes: words of a shingle, 64-bit words of a fingerprint, pieces of each, and bits that may differ in all.
#: At a five-word similarity of 0.8 some 78 of 512 bits are expected to differ, with a deviation of 8, and nineteen pairs in twenty lie within the
#: radius; one of 40 pieces is equal in all but one pair in 180. At 0.75 some 88 differ, at 0.7 some 98.
KEEP_SHINGLE, KEEP_SKETCHES, KEEP_PIECES, KEEP_RADIUS = 5, 8, 5, 91

#: Fingerprints with an equal piece that a task holds at once, about; of more, parts by hash meet two at a time, in a task each.
TILE_ROWS = 65_536
#: Rows and columns that numpy compares in one step, and links that a task gathers before it contracts them.
STEP_ROWS, STEP_COLUMNS, STEP_LINKS = 256, 4096, 4_000_000
#: Up to so many that meet are compared together with others like them; in crowds, so many centres are tried first.
FEW, CROWD, CENTRES = 64, 2048, 8


def _hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """The XXH64 of each word shingle, repeats included; none without words."""
    words = text.encode().lower().split() if text else []  # bytes: lower() changes A-Z alone, split() cuts at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], seed) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def _other(hashes: np.ndarray, sketch: int) -> np.ndarray:
    """Hashes of the same shingles for another fingerprint, by the finishing steps of SplitMix64; those of sketch 0 stay."""
    if not sketch:
        return hashes
    z = hashes + np.uint64(sketch * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _bits(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the hashes; 0 without any."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, sketch: int = 0) -> int:
    """The 64-bit SimHash of the word shingles, repeats included. No words: 0."""
    return _bits(_other(_hashes(text, shingle, seed), sketch))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, sketches: int = 1) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_key, words): fingerprints of so many 64-bit words, as signed longs; a hash of the text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [_hashes(t, shingle, seed) for t in batch.column("text").to_pylist()]
        words = np.array([_bits(_other(h, k)) for h in hashes for k in range(sketches)], np.uint64).view(np.int64)
        offsets = np.arange(0, len(words) + 1, sketches, dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.ListArray.from_arrays(offsets, words)], ["doc_id", "text_key", "words"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(F.col("text")).alias("text_key"))
    return map_batches(rows, work, "doc_id long, text_key long, words array<long>")


def text_key(text: Column) -> Column:
    """A hash that, beside a doc_id, tells rows that repeat the doc_id apart."""
    return F.xxhash64(text.cast("string"))


def _pieces(sketches: int, pieces: int) -> Column:
    """The pieces of a fingerprint, each as a number that holds its place too."""
    found = []
    for word in range(sketches):
        ends = [64 * (i + 1) // pieces for i in range(pieces)]
        for low, high in zip([0, *ends], ends, strict=False):
            value = F.shiftrightunsigned(F.col("words")[word], low).bitwiseAND(F.lit((1 << high - low) - 1).cast("long"))
            found.append(value.bitwiseOR(F.lit(len(found) << 32).cast("long")))
    return F.array(*found)


def _ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1, dtype=np.int32)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits differ, for each of x and each of y."""
    total = np.zeros((len(x), len(y)), np.uint16)
    for word in range(x.shape[1]):
        total += np.bitwise_count(x[:, word, None] ^ y[None, :, word])
    return total


def _tile_links(words: np.ndarray, node: np.ndarray, ones: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the places x and y, both in the order of population counts: tile by tile, those beyond the radius skipped."""
    for at in range(0, len(x), STEP_ROWS):
        mine = x[at : at + STEP_ROWS]
        low = at if x is y else int(np.searchsorted(ones[y], ones[mine[0]] - radius, "left"))
        high = int(np.searchsorted(ones[y], ones[mine[-1]] + radius, "right"))
        for start in range(low, high, STEP_COLUMNS):
            theirs = y[start : min(start + STEP_COLUMNS, high)]
            i, j = np.nonzero(_apart(words[mine], words[theirs]) <= radius)
            yield node[mine[i]], node[theirs[j]]


def _crowd_links(words: np.ndarray, node: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join all within the radius, of those that meet.

    In a crowd, what lies around a centre is joined by its links to the centre and needs no comparison inside; only the rest
    is compared with it. That keeps thousands of near copies of one text from being compared each with each.
    """
    order = np.argsort(_ones(words), kind="stable")
    words, node = words[order], node[order]
    ones, left = _ones(words), np.arange(len(node))
    while len(left) > CROWD:
        centres = left[np.linspace(0, len(left) - 1, CENTRES).astype(np.int64)]
        around = _apart(words[centres], words[left]) <= radius
        best = int(around.sum(axis=1).argmax())
        ball, rest = left[around[best]], left[~around[best]]
        if len(ball) * CENTRES < len(left):
            break
        yield node[ball], np.full(len(ball), node[centres[best]])
        yield from _tile_links(words, node, ones, rest, ball, radius)
        left = rest
    yield from _tile_links(words, node, ones, left, left, radius)


def _few_links(run: np.ndarray, words: np.ndarray, node: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside many short runs at once: each row beside the first after it, the second, and so on."""
    ones = _ones(words)
    for k in range(1, FEW):
        i = np.flatnonzero(run[k:] == run[:-k])
        if not len(i):
            return
        i = i[np.abs(ones[i + k] - ones[i]) <= radius]
        i = i[np.bitwise_count(words[i] ^ words[i + k]).sum(axis=1, dtype=np.int32) <= radius]
        yield node[i], node[i + k]


def _runs(batches: Iterator[pa.RecordBatch], sketches: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows sorted by piece and meeting -> a number for each run of equal ones, words, nodes; never part of a run."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "meeting", "node")], axis=1)
        words = batch.column("words").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, sketches)
        if held:
            key, words = np.concatenate([held[0], key]), np.concatenate([held[1], words])
        run = np.concatenate([[0], np.cumsum((np.diff(key[:, :2], axis=0) != 0).any(axis=1))])
        end = int(np.searchsorted(run, run[-1]))
        if end:
            yield run[:end], words[:end], key[:end, 2]
        held = key[end:], words[end:]
    if held:
        yield np.zeros(len(held[0]), np.int64), held[1], held[0][:, 2]


def _compare(batches: Iterator[pa.RecordBatch], sketches: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece and meeting -> links between nodes."""
    links: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for run, words, node in _runs(batches, sketches):
            starts = np.flatnonzero(np.diff(run, prepend=-1))
            sizes = np.diff(starts, append=len(run))
            few = np.repeat(sizes <= FEW, sizes)
            yield from _few_links(run[few], words[few], node[few], radius)
            for at, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
                yield from _crowd_links(words[at : at + n], node[at : at + n], radius)

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        return contract(np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links]))

    for a, b in found():
        if (other := a != b).any():
            links.append((a[other], b[other]))
            waiting += int(other.sum())
            if waiting > STEP_LINKS:
                links, waiting = [reduced()], 0
    if links:
        a, b = reduced()
        yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def near_links(classes: DataFrame, sketches: int, pieces: int, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct (node, words) -> links (a, b) that join all nodes with an equal piece whose fingerprints differ in at most radius bits.

    Of more than tile_rows fingerprints that share a piece, parts by hash meet two at a time, in a task each.
    """
    pieced = classes.select("node", "words", F.explode(_pieces(sketches, pieces)).alias("piece"))
    large = saved(pieced.groupBy("piece").count().filter(F.col("count") > tile_rows).select("piece", F.ceil(F.col("count") / tile_rows).cast("int").alias("parts")))
    if large.isEmpty():
        rows = pieced.withColumn("meeting", F.lit(0).cast("long"))
    else:
        large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
        parts = F.coalesce("parts", F.lit(1))
        parted = pieced.join(large, "piece", "left").withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), parts))
        met = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
        rows = met.withColumn("meeting", F.least("part", "other") * 2**31 + F.greatest("part", "other"))
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.select("piece", "meeting", "node", "words").repartition(tasks, "piece", "meeting").sortWithinPartitions("piece", "meeting")
    return dealt.mapInArrow(lambda batches: _compare(batches, sketches, radius), "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, tile_rows: int = TILE_ROWS, sketches: int = 1, pieces: int = RADIUS + 1) -> DataFrame:
    """(doc_id, text) -> doc_id, text_key, fp, component_id (the smallest doc_id that links reach), one row per row.

    Rows link if their fingerprints differ in at most radius of 64 * sketches bits and agree in one of the pieces of a word, which
    always holds when there are more pieces in all than radius. fp is the first word.
    Null and empty texts, and texts of white space, have fingerprint 0 and link like any other; shorter texts than a
    shingle are one shingle. Rows with equal fingerprints are one class. A row with a null doc_id gets its component's smallest
    doc_id, or null if it has none. Rows that repeat a doc_id with several texts are classes of their own. Empty tables give no rows.
    """
    node = F.col("words")[0] if sketches == 1 else F.xxhash64("words")
    fps = saved(fingerprints(docs, shingle, seed, sketches).withColumn("node", node))
    classes = saved(fps.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("words").alias("words"), F.count("*").alias("n")))
    roots = connected_components(near_links(classes.select("node", "words"), sketches, pieces, radius, tile_rows))
    roots = roots.withColumnRenamed("node", "linked")
    rooted = saved(classes.join(roots, F.col("node") == F.col("linked"), "left").select("node", "least", "n", F.coalesce("root", "node").alias("root")))
    named = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    found = saved(beside(rooted.withColumnRenamed("n", "size"), named, "root", rooted.count()).select("node", F.col("size").alias("n"), "component_id"))
    return beside(fps, found, "node", fps.count()).select("doc_id", "text_key", F.col("words")[0].alias("fp"), "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lower-case hex digits), component_id."""
    found = simhash_components(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = KEEP_SHINGLE, radius: int = KEEP_RADIUS, sketches: int = KEEP_SKETCHES, pieces: int = KEEP_PIECES) -> DataFrame:
    """docs with one text of each component, all columns kept: that of its smallest doc_id, of several texts under that doc_id the one
    with the least key. A null doc_id stays; rows that repeat a doc_id and a text stay or go together."""
    found = saved(simhash_components(docs, shingle, radius, sketches=sketches, pieces=pieces).filter("doc_id IS NOT NULL"))
    first = saved(found.groupBy("component_id").agg(F.min(F.when(F.col("doc_id") == F.col("component_id"), F.col("text_key"))).alias("first"), F.count("*").alias("n")))
    lost = beside(found, first, "component_id", found.count()).filter("doc_id <> component_id OR text_key <> first")
    lost = lost.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("__near_id"), F.col("text_key").alias("__near_key"))
    keyed = docs.withColumns({"__near_id": F.col("doc_id"), "__near_key": text_key(F.col("text"))})
    return without(keyed, lost, ["__near_id", "__near_key"]).drop("__near_id", "__near_key")

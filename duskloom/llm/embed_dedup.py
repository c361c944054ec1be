"""Embedding near-deduplication by dual traversal of cover trees.

On unit vectors cosine >= t is distance <= sqrt(2 - 2 t). Equal vectors are one class. Each label's classes are dealt to
cells around pivots, and a cell to parts of bounded size. The cover tree of each part is built once, by insertion, and
written. A class also visits the parts of other cells in which it may have a partner, by the bisecting planes of the
pivots; visitors meet a part in bounded groups with a tree of their own. Two trees, nested levels with halving radii, are
traversed together: a pair of nodes whose distance exceeds the threshold by more than both covering radii is pruned with
all below it. The pairs of leaves that remain are decided by their cosine in double precision, so no pair is missed and
none below it is given.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, beside, saved
from .components import connected_components, contract

COSINE = 0.93

#: Classes in a part of a cell, and visitors that meet it at once, about.
CELL_ROWS = 2048
#: Pivots of a label, and of all labels together, at most. Labels beyond them are cut by hash alone.
PIVOTS = 512
ALL_PIVOTS = 8192
#: Radii of the levels below the root, whose ball has all unit vectors.
LEVELS = (1.0, 0.5, 0.25, 0.125)
#: Centres in a row that cover nothing but themselves before a node is taken to have no structure at its radius.
LONELY = 32
#: Pairs that numpy holds at once.
STEP_PAIRS = 1_000_000

_SLACK = 1e-6  # of distances, for rounding


class CoverTree(NamedTuple):
    """points: unit vectors. nodes[k]: places of level k's nodes, all of which are nodes of the next level too; the last level is all
    points. children[k][i]: places in nodes[k + 1] that level k's node i covers. radius[k][i]: the farthest of the points below it."""

    points: np.ndarray
    nodes: list[np.ndarray]
    children: list[list[np.ndarray]]
    radius: list[np.ndarray]


def _from(points: np.ndarray, centre: int, members: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * points[members] @ points[centre]))


def _split(points: np.ndarray, centre: int, members: np.ndarray, away: np.ndarray, limit: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Balls (centre, members, their distances) that cover a node's members: the node's own, then one for each point that none
    has taken, inserted in turn. A centre's distances are taken to the points still open alone.

    When LONELY centres in a row have taken nothing but themselves, each point left becomes a ball of its own: the covering radii, which
    are all that pruning needs, stay true, and no more than LONELY distances a point are spent on what has no structure.
    """
    near = away <= limit
    found, left, lonely = [(centre, members[near], away[near])], members[~near], 0
    while len(left) and lonely < LONELY:
        far = _from(points, left[0], left)
        far[0] = 0.0
        near = far <= limit
        found.append((int(left[0]), left[near], far[near]))
        lonely = lonely + 1 if near.sum() == 1 else 0
        left = left[~near]
    return found + [(int(p), np.array([p]), np.zeros(1)) for p in left.tolist()]


def build(points: np.ndarray) -> CoverTree:
    """A cover tree by insertion, from the root down; no distances but those of centres to their node's open points are taken."""
    n = len(points)
    if not n:
        return CoverTree(points, [np.zeros(0, np.int64)] * (len(LEVELS) + 2), [[] for _ in range(len(LEVELS) + 1)], [np.zeros(0)] * (len(LEVELS) + 2))
    everything = np.arange(n)
    away = _from(points, 0, everything)
    away[0] = 0.0
    level = [(0, everything, away)]
    nodes, children, radius = [np.zeros(1, np.int64)], [], [np.array([away.max()])]
    for limit in LEVELS:
        below, own = [], []
        for centre, members, far in level:
            balls = _split(points, centre, members, far, limit) if len(members) > 1 else [(centre, members, far)]
            own.append(np.arange(len(below), len(below) + len(balls)))
            below += balls
        children.append(own)
        nodes.append(np.array([c for c, _, _ in below], np.int64))
        radius.append(np.array([d.max() for _, _, d in below]))
        level = below
    order = np.concatenate([m for _, m, _ in level])
    ends = np.cumsum([len(m) for _, m, _ in level])
    children.append(np.split(np.arange(n), ends[:-1]))
    return CoverTree(points, [*nodes, order], children, [*radius, np.zeros(n)])


def _descend(children_a: list[np.ndarray], children_b: list[np.ndarray], i: np.ndarray, j: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of children of pairs of nodes, in steps. In one tree, children of one node give each pair once; those of two
    nodes never meet again."""
    size_a, size_b = (np.array([len(c) for c in children], np.int64) for children in (children_a, children_b))
    flat_a, flat_b = (np.concatenate([*children, np.zeros(0, np.int64)]).astype(np.int64) for children in (children_a, children_b))
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    total = np.cumsum(size_a[i] * size_b[j])
    at = 0
    while at < len(i):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + STEP_PAIRS, side="right")))
        x, y = i[at:end], j[at:end]
        n = size_a[x] * size_b[y]
        pair = np.repeat(np.arange(len(x)), n)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        below_a, below_b = flat_a[start_a[x[pair]] + inner // size_b[y[pair]]], flat_b[start_b[y[pair]] + inner % size_b[y[pair]]]
        if same:
            once = (x[pair] != y[pair]) | (below_a <= below_b)
            below_a, below_b = below_a[once], below_b[once]
        yield below_a, below_b
        at = end


def _distance(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    if len(i) * 8 > len(a) * len(b):  # most pairs: one product of matrices
        cos = (a @ b.T)[i, j]
    else:
        cos = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 65_536]], b[j[k : k + 65_536]]) for k in range(0, len(i), 65_536)] or [np.zeros(0)])
    return np.sqrt(np.maximum(0, 2 - 2 * cos))


def near_pairs(a: CoverTree, b: CoverTree, cosine: float, same: bool, met: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the points with cosine >= the threshold, less about 1e-6 of distance; each pair once if both trees are the same.
    met: gets the number of pairs of nodes looked at on each level."""
    limit = np.sqrt(2 - 2 * cosine) + _SLACK
    last = len(a.nodes) - 1
    if not len(a.points) or not len(b.points):
        return
    todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        nodes_a, nodes_b = a.nodes[level], b.nodes[level]
        if met is not None:
            met[level] += len(i)
        far = _distance(a.points[nodes_a], b.points[nodes_b], i, j) > limit + a.radius[level][i] + b.radius[level][j]
        i, j = i[~far], j[~far]
        if level == last:
            if same:
                i, j = i[i != j], j[i != j]
            if len(i):
                yield nodes_a[i], nodes_b[j]
        elif len(i):
            for x, y in _descend(a.children[level], b.children[level], i, j, same):
                if len(x):
                    todo.append((level + 1, x, y))


def _deal(pivots: dict[int, np.ndarray], limit: float, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each class with its cell, that of the nearest pivot, and the cells before it in which it may have a partner: those whose
    bisecting plane with its own is no farther than the threshold. Without pivots: cell 0."""
    group = batch.column("grp").to_numpy()
    unit = batch.column("unit")
    cell, targets = np.zeros(len(group), np.int32), [[] for _ in range(len(group))]
    for g in np.unique(group):
        p = pivots.get(int(g))
        if p is None:
            continue
        rows = np.flatnonzero(group == g)
        x = unit.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1)
        square = np.maximum(0, 2 - 2 * x @ p.T)
        home = np.argmin(square, axis=1)
        between = np.sqrt(np.maximum(1e-30, 2 - 2 * p @ p.T))
        plane = (square - square[np.arange(len(x)), home][:, None]) / (2 * between[home])
        cell[rows] = home
        visited = (plane <= limit + _SLACK) & (np.arange(len(p)) < home[:, None])
        for row, hit in zip(rows.tolist(), visited, strict=True):
            targets[row] = np.flatnonzero(hit).tolist()
    names = ["grp", "node", "size", "unit"]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(cell), pa.array(targets, pa.list_(pa.int32()))], [*names, "cell", "targets"])


def _side(table: pa.Table) -> tuple[np.ndarray, np.ndarray, CoverTree]:
    unit = table.column("unit").combine_chunks()
    return table.column("node").to_numpy(), table.column("size").to_numpy(), build(unit.flatten().to_numpy().reshape(len(unit), -1))


def _planted(table: pa.Table) -> pa.Table:
    """The tree of one part, as one row."""
    return pa.table({"grp": table.column("grp").slice(0, 1), "cell": table.column("cell").slice(0, 1), "part": table.column("part").slice(0, 1), "tree": pa.array([pickle.dumps(_side(table), protocol=5)], pa.binary())})


def _links(side_a: tuple, side_b: tuple, cosine: float, same: bool) -> pa.Table:
    """The links between two trees, or within one -> rows (node, links, a, b): other vectors that a node is linked to directly, or a contracted link."""
    (node_a, size_a, a), (node_b, size_b, b) = side_a, side_b
    count_a, count_b = np.zeros(len(node_a), np.int64), np.zeros(len(node_b), np.int64)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in near_pairs(a, b, cosine, same):
        for k in range(0, len(i), 65_536):
            x, y = i[k : k + 65_536], j[k : k + 65_536]
            enough = np.einsum("ij,ij->i", a.points[x], b.points[y]) >= cosine
            x, y = x[enough], y[enough]
            if len(x):
                np.add.at(count_a, x, size_b[y])
                np.add.at(count_a if same else count_b, y, size_a[x])
                links.append(contract(node_a[x], node_b[y]))
    found = [(node_a, count_a)] if same else [(node_a, count_a), (node_b, count_b)]
    node, count = np.concatenate([n[c > 0] for n, c in found]), np.concatenate([c[c > 0] for _, c in found])
    x, y = contract(*[np.concatenate([link[s] for link in links]) for s in (0, 1)]) if links else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    gap_count, gap_link = pa.nulls(len(count), pa.int64()), pa.nulls(len(x), pa.int64())
    return pa.table({
        "node": pa.chunked_array([pa.array(node, pa.int64()), gap_link]), "links": pa.chunked_array([pa.array(count, pa.int64()), gap_link]),
        "a": pa.chunked_array([gap_count, pa.array(x, pa.int64())]), "b": pa.chunked_array([gap_count, pa.array(y, pa.int64())]),
    })


def _met(trees: pa.Table, visitors: pa.Table, cosine: float) -> pa.Table:
    """A part's tree against a group of visitors."""
    return _links(pickle.loads(trees.column("tree")[0].as_py()), _side(visitors), cosine, False)


_FOUND = "node long, links long, a long, b long"


def _alone(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Parts' trees against themselves."""
    for batch in batches:
        for tree in batch.column("tree"):
            side = pickle.loads(tree.as_py())
            yield from _links(side, side, cosine, True).to_batches()


def _pivots(classes: DataFrame, cell_rows: int, most: int, everywhere: int) -> dict[int, np.ndarray]:
    """Pivots of the largest labels, chosen by hash: one for cell_rows classes, at most most a label and everywhere in all."""
    large = classes.groupBy("grp").count().filter(F.col("count") > cell_rows).orderBy(F.col("count").desc(), "grp").limit(everywhere).collect()
    want, sizes, left = {}, {r["grp"]: r["count"] for r in large}, everywhere
    for g, n in sizes.items():
        if (k := min(most, -(-n // cell_rows), left)) > 1:
            want[g], left = k, left - k
    if not want:
        return {}
    draw = F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1_000_000_000)) / 1e9
    shares = classes.sparkSession.createDataFrame([(g, min(1.0, (4 * k + 40) / sizes[g])) for g, k in want.items()], "grp long, share double")
    rows = classes.join(F.broadcast(shares), "grp").filter(draw < F.col("share")).select("grp", "unit", draw.alias("draw")).collect()
    found: dict[int, np.ndarray] = {}
    for g, k in want.items():
        own = sorted((r["draw"], r["unit"]) for r in rows if r["grp"] == g)[:k]
        if own:
            found[g] = np.unique(np.array([u for _, u in own], float), axis=0)
    return found


def _joined(rows: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """rows with the counts of their keys: broadcast when there are few enough, else both are shuffled by key."""
    return rows.join(F.broadcast(counts) if counts.count() <= BROADCAST_KEYS else counts, on)


def embedding_links(classes: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS, all_pivots: int = ALL_PIVOTS) -> DataFrame:
    """classes (grp long, node long, size long, unit array<double>) -> (node, links, a, b) rows, see _links.

    A class visits only parts before its own: those of its cell with a lower number, and all parts of its target cells, so that each
    pair meets once. A part has about cell_rows classes, and so many visitors meet it in one task.
    """
    spread = _pivots(classes, cell_rows, pivots, all_pivots)
    limit = float(np.sqrt(2 - 2 * cosine))
    rows = classes.select("grp", "node", "size", "unit")
    names = "grp long, node long, size long, unit array<double>, cell int, targets array<int>"
    if spread:
        sent = classes.sparkSession.sparkContext.broadcast(spread)
        dealt = saved(rows.mapInArrow(lambda it: (_deal(sent.value, limit, b) for b in it if b.num_rows), names))
    else:
        dealt = rows.withColumns({"cell": F.lit(0), "targets": F.array().cast("array<int>")})
    cells = saved(dealt.groupBy("grp", "cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"), F.count("*").alias("n")))
    homes = _joined(dealt, cells, ["grp", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    visits = homes.filter((F.size("targets") > 0) | (F.col("part") > 0)).select("grp", "node", "size", "unit", F.col("cell").alias("own"), F.col("part").alias("own_part"), F.explode(F.array_append("targets", F.col("cell"))).alias("cell"))
    visits = _joined(visits, cells.select("grp", "cell", "parts"), ["grp", "cell"])
    last = F.when(F.col("cell") == F.col("own"), F.col("own_part")).otherwise(F.col("parts")) - 1
    visits = visits.withColumn("last", last).filter("last >= 0").select("grp", "cell", F.explode(F.sequence(F.lit(0), "last")).alias("part"), "node", "size", "unit")
    met = homes.filter((F.col("n") > 1) | F.col("grp").isin(list(spread)))  # a class alone in its cell may still be visited
    trees = saved(met.select("grp", "cell", "part", "node", "size", "unit").groupBy("grp", "cell", "part").applyInArrow(_planted, "grp long, cell int, part int, tree binary"))
    alone = trees.select("tree").mapInArrow(lambda it: _alone(it, cosine), _FOUND)
    if not spread and cells.filter("parts > 1").isEmpty():
        return alone
    groups = saved(visits.groupBy("grp", "cell", "part").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("groups")))
    keys = ["grp", "cell", "part", "group"]
    asked = _joined(visits, groups, keys[:3]).withColumn("group", F.pmod(F.xxhash64("node", F.lit("visit")), "groups").cast("int")).select(*keys, "node", "size", "unit")
    offered = _joined(trees, groups, keys[:3]).select(*keys[:3], F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "tree")
    between = offered.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda t, v: _met(t, v, cosine) if t.num_rows and v.num_rows else _NOTHING, _FOUND)
    return alone.union(between)


_NOTHING = pa.table({name: pa.nulls(0, pa.int64()) for name in ("node", "links", "a", "b")})


def embedding_dedup(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS, all_pivots: int = ALL_PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of vectors (vec_id, embedding, label).

    Only rows of equal, non-null labels and equal lengths link, when their cosine in double precision is at least the
    threshold. Vectors that are null, empty, zero, or hold a null or non-finite component, and those with a null label or vec_id, link with
    nothing: 0 links, their own component. Equal vectors are linked to each other and count in n_links. Rows that repeat a
    vec_id count as vectors of their own. Empty tables give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  a lambda works out anew for every element what it takes from outside
    largest = F.array_max(F.transform("v", F.abs))  # scaling by it keeps squares from over- and underflow
    scaled = once(F.struct("v", largest.alias("top")), lambda b: F.transform(b["v"], lambda x: x / b["top"]))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    normed = once(scaled, lambda v: once(F.struct(v.alias("v"), length(v).alias("norm")), lambda b: F.transform(b["v"], lambda x: x / b["norm"])))
    known = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    unit = rows.filter(known).select("vec_id", "label", normed.alias("unit"))
    unit = saved(unit.withColumn("key", F.sha2(F.concat_ws(",", F.col("label"), F.to_json("unit")), 256)))
    classes = unit.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.min("label").alias("label"), F.min("unit").alias("unit"))
    grouped = classes.withColumn("grp", F.xxhash64("label", F.size("unit")))
    classes = saved(grouped)
    found = saved(embedding_links(classes, cosine, cell_rows, pivots, all_pivots))
    roots = connected_components(found.filter("a IS NOT NULL").select("a", "b"))
    counts = found.filter("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("key", "node", "size").join(counts, "node", "left").join(roots, "node", "left")
    named = saved(named.select("key", F.col("size").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id")))
    linked = beside(unit.select("vec_id", "key"), named, "key", unit.count()).select("vec_id", "n_links", "component_id")
    loose = rows.filter(~known).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(loose).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}
),
reach AS (
  SELECT a AS vec_id, a AS root FROM links
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id
),
roots AS (SELECT vec_id, min(root) AS root FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(root, e.vec_id) AS component_id, e.vec_id IS NOT DISTINCT FROM coalesce(root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON c.vec_id = e.vec_id LEFT JOIN roots r ON r.vec_id = e.vec_id
"""

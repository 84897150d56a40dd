"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are quantized to ``floor(scale * x)``.

1. Candidates go to the nearest of at most ``CENTRES`` sampled centres, and a cell
   of more than ``BLOCK`` vectors is dealt by id into blocks; each block is indexed
   in one cover tree, once.  The stated queries become groups of about ``GROUP``
   in the same way.
2. A group is first searched in the block whose centre is nearest to its own;
   that gives each query's k-th score so far.
3. Tile by tile of block centres, groups are held against blocks: a query q scores
   at most ``<q, x> + |q| r`` in a block with centre x and radius r, so pairs of a
   group and a block in which no query can reach its k-th score are never made.
4. The remaining pairs are searched dually: a pair of nodes with centres q, x and
   covering radii s, r holds no score over ``<q, x> + |q| r + |x| s + r s``; it is
   pruned when that is under the worst k-th score of the query node's queries.
   Leaf pairs are one exact matrix product over the queries that the leaf's own
   bound leaves.  The best of all blocks are merged by a ranked window, which
   drops all but k of each query before the shuffle.

A cover tree's node at scale c has children whose centres are more than c / 2
apart and that hold the points within c / 2 of them; the stored radii are the
exact ones, which are smaller.  Equal vectors of a block are one point with its
k + 1 smallest ids, which is all that any query can need of them.  The centres
are a bounded sample (those with the smallest seeded hashes of their ids) and only
deal the work; every row is indexed and the result is exact.

Defined cases: vectors that are null, empty, or hold null or non-finite
components, and rows without id, take no part; shorter vectors are continued by
zeros; rows that repeat an id are one row, the smallest vector standing for it;
a query's own id is no candidate of it; ties go to the smaller id; fewer
candidates than k are all returned; very long vectors are whole; empty tables
give an empty result; products that could pass 2**53 are computed in 64-bit
integers and must fit them; ids are numbers (others raise); further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import materialize

BLOCK, GROUP, LEAF = 8192, 2048, 64
CENTRES = 64
#: Block centres that are held against a group at once.
TILE = 4096


def quantized(table: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors of the rows that take part, in the order of ids, one row per id."""
    table = table.combine_chunks()
    column = table.column("_v")
    column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if not n:
        return np.empty(0, np.int64), np.zeros((0, 1), np.int64)
    valid = ~np.asarray(column.is_null())
    offs = column.offsets.to_numpy().astype(np.int64)
    size = np.where(valid, np.diff(offs), 0)
    values = column.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    ok = np.isfinite(flat)  # a null component is NaN here
    bad = np.concatenate(([0], np.cumsum(~ok)))
    keep = np.flatnonzero((size > 0) & (bad[offs[1:]] == bad[offs[:-1]]))
    if not len(keep):
        return np.empty(0, np.int64), np.zeros((0, 1), np.int64)
    dim = int(size[keep].max())
    at = offs[keep][:, None] + np.arange(dim)
    inside = np.arange(dim) < size[keep][:, None]
    vec = np.where(inside, np.floor(scale * flat[np.minimum(at, len(flat) - 1)]), 0).astype(np.int64)
    ids = table.column("_id").to_numpy()[keep].astype(np.int64)
    order = np.lexsort((*vec.T[::-1], ids))
    ids, vec = ids[order], vec[order]
    first = np.concatenate(([True], ids[1:] != ids[:-1]))
    return ids[first], vec[first]


class CoverTree:
    """Nodes as arrays: centre, covering radius, children, and the points of leaves."""

    def __init__(self, points: np.ndarray, size: int) -> None:
        self.points, self.size = points, size
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[np.ndarray | None] = []
        if len(points):
            own = np.arange(len(points))
            gap = self._distances(points, points[0])
            self._build(own, points[0], gap, float(gap.max()))
        self.centres = np.array(self.centre) if self.centre else np.zeros((0, points.shape[1]))
        self.norms = np.linalg.norm(self.centres, axis=1)
        self.radii = np.array(self.radius)

    @staticmethod
    def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
        diff = points - centre
        return np.sqrt(np.einsum("ij,ij->i", diff, diff)) * (1 + 1e-12)

    def _build(self, own: np.ndarray, centre: np.ndarray, gap: np.ndarray, scale: float) -> int:
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(gap.max()))
        self.children.append([])
        self.leaf.append(None)
        if len(own) <= self.size or gap.max() == 0:
            self.leaf[node] = own
            return node
        while scale / 2 >= gap.max():  # scales at which the centre alone covers all
            scale /= 2
        half, rest, far = scale / 2, own, gap
        groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rest):  # a greedy net: the first centre is the node's own
            at = centre if not groups else self.points[rest[np.argmax(far)]]
            near = far if not groups else self._distances(self.points[rest], at)
            inside = near <= half
            groups.append((rest[inside], at, near[inside]))
            rest, far = rest[~inside], np.minimum(far, near)[~inside]
            if len(groups) * self.size > 4 * len(own) + self.size:  # far-spread points: leaves of what is left
                for part in np.array_split(rest, max(1, -(-len(rest) // self.size))):
                    if len(part):
                        groups.append((part, self.points[part[0]], self._distances(self.points[part], self.points[part[0]])))
                break
        small: list[np.ndarray] = []
        for members, at, near in groups:
            if len(members) >= self.size // 4:
                self.children[node].append(self._build(members, at, near, half))
            elif len(members):
                small.append(members)
        # tiny children are cheaper as shared leaves than as nodes of their own
        merged = np.concatenate(small) if small else np.empty(0, np.int64)
        for part in np.array_split(merged, max(1, -(-len(merged) // self.size))):
            if len(part):
                mid = self.points[part].mean(0)
                self.children[node].append(len(self.centre))
                self.centre.append(mid)
                self.radius.append(float(self._distances(self.points[part], mid).max()))
                self.children.append([])
                self.leaf.append(part)
        return node


def _wide(x: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x


class Index:
    """The distinct vectors of a block or group, the ids of each, and their cover tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: int, leaf: int) -> None:
        self.points, back = np.unique(vectors, axis=0, return_inverse=True)
        order = np.argsort(back.ravel(), kind="stable")  # ids ascend within a point
        cut = np.searchsorted(back.ravel()[order], np.arange(len(self.points) + 1))
        self.ids = [ids[order[a : min(b, a + most)]] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        self.tree = CoverTree(self.points.astype(np.float64), leaf)

    def __getstate__(self) -> dict:
        """Without the tree's copy of the points, which are sent as 32 bits where they fit."""
        small = np.abs(self.points).max(initial=0) < 2**31
        tree = {k: v for k, v in self.tree.__dict__.items() if k not in ("points", "centre", "radius")}
        return {"points": self.points.astype(np.int32) if small else self.points, "ids": self.ids, "tree": tree}

    def __setstate__(self, state: dict) -> None:
        self.points, self.ids = state["points"].astype(np.int64), state["ids"]
        self.tree = CoverTree.__new__(CoverTree)
        self.tree.__dict__ |= state["tree"] | {"points": self.points.astype(np.float64)}

    def widened(self, dim: int) -> Index:
        if self.points.shape[1] < dim:
            self.points, tree = _wide(self.points, dim), self.tree
            tree.points, tree.centres = _wide(tree.points, dim), _wide(tree.centres, dim)
        return self


def dual_search(q: Index, x: Index, k: int, worst: np.ndarray, count: dict[str, int] | None = None) -> list[list[tuple[int, int]]]:
    """For each query point of ``q`` (one id each) the best (score, -id) of ``x`` that are not under its ``worst`` score.

    ``worst`` is raised to the k-th scores found.  ``count`` gets the products made and those that were possible.
    """
    dim = max(q.points.shape[1], x.points.shape[1])
    qt, xt = q.widened(dim).tree, x.widened(dim).tree
    exact = float(np.abs(q.points).max(initial=0)) * float(np.abs(x.points).max(initial=0)) * dim < 2**53
    norms = np.linalg.norm(qt.points, axis=1)
    best: list[list[tuple[int, int]]] = [[] for _ in q.ids]  # heaps of (score, -id)
    made = 0

    def bound(a: int, bs: list[int]) -> np.ndarray:
        top = xt.centres[bs] @ qt.centres[a] + qt.norms[a] * xt.radii[bs] + xt.norms[bs] * qt.radii[a] + qt.radii[a] * xt.radii[bs]
        return top + 1e-9 * np.abs(top) + 1e-6

    members: list[np.ndarray] = [np.empty(0, np.int64)] * len(qt.radii)
    for a in range(len(qt.radii) - 1, -1, -1):  # children come after their parent
        members[a] = qt.leaf[a] if qt.leaf[a] is not None else np.concatenate([members[c] for c in qt.children[a]])

    def base(a: int, b: int) -> None:
        nonlocal made
        top = qt.points[qt.leaf[a]] @ xt.centres[b] + norms[qt.leaf[a]] * xt.radii[b]
        qs, xs = qt.leaf[a][top + 1e-9 * np.abs(top) + 1e-6 >= worst[qt.leaf[a]]], xt.leaf[b]
        if not len(qs):
            return
        made += len(qs) * len(xs)
        scores = qt.points[qs] @ xt.points[xs].T if exact else q.points[qs] @ x.points[xs].T
        hit = scores >= worst[qs][:, None]
        for i in np.flatnonzero(hit.any(1)).tolist():
            one, heap = int(qs[i]), best[qs[i]]
            for j in np.flatnonzero(hit[i]).tolist():
                for own in x.ids[xs[j]].tolist():
                    if own == q.ids[one][0]:
                        continue
                    item = (int(scores[i, j]), -own)
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                    else:
                        break
            if len(heap) == k:
                worst[one] = max(worst[one], heap[0][0])

    todo = [(0, 0, float(bound(0, [0])[0]))]
    while todo:
        a, b, top = todo.pop()
        if top < worst[members[a]].min():
            continue
        if qt.leaf[a] is not None and xt.leaf[b] is not None:
            base(a, b)
        elif qt.leaf[a] is not None or (xt.leaf[b] is None and xt.radii[b] * qt.norms[a] >= qt.radii[a] * xt.norms[b]):
            tops = bound(a, xt.children[b])
            order = np.argsort(tops, kind="stable")  # the best is popped first
            todo += [(a, xt.children[b][i], float(tops[i])) for i in order.tolist()]
        else:
            todo += [(c, b, float(bound(c, [b])[0])) for c in qt.children[a]]
    if count is not None:
        count["made"], count["possible"] = count.get("made", 0) + made, count.get("possible", 0) + len(q.ids) * len(x.points)
    return best


def _cells(centres: np.ndarray):
    """``_id, _v, cell``: the number of the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = 0.5 * (centres * centres).sum(1)
        for batch in batches:
            column = batch.column("_v")
            size = np.diff(column.offsets.to_numpy())
            x = np.zeros((len(size), centres.shape[1]))
            at = np.arange(x.shape[1]) < np.minimum(size, x.shape[1])[:, None]
            start = column.offsets.to_numpy()[:-1].astype(np.int64)
            x[at] = column.values.to_numpy()[(start[:, None] + np.arange(x.shape[1]))[at]]
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "_v": column, "cell": pa.array(np.argmax(x @ centres.T - half, axis=1), pa.int32())})

    return run


def _indexed(scale: int, most: int, leaf: int, name: str):
    """One row a block or group: its number, centre, radius and pickled index."""

    def run(table: pa.Table) -> pa.Table:
        ids, vectors = quantized(table, scale)
        index = Index(ids, vectors, most, leaf)
        if most == 1:  # queries: one point each
            index.ids, index.points = [ids[i : i + 1] for i in range(len(ids))], vectors
            index.tree = CoverTree(vectors.astype(np.float64), leaf)
        centre = index.tree.points.mean(0)
        radius = float(np.linalg.norm(index.tree.points - centre, axis=1).max())
        key = f"{table.column('cell')[0].as_py()}/{table.column('part')[0].as_py()}"
        return pa.table({name: [key], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [radius], name + "_index": pa.array([pickle.dumps(index)], pa.binary())})

    return run


def _nearest(table: pa.Table, groups: pa.Table) -> pa.Table:
    """For each group of a tile the block whose centre is nearest to its own."""
    out = {"group": [], "block": [], "gap": []}
    if len(table) and len(groups):
        names, x = table.column("block").to_pylist(), _matrix(table.column("centre"))
        for name, c in zip(groups.column("group").to_pylist(), groups.column("centre").to_pylist(), strict=True):
            dim = max(len(c), x.shape[1])
            gap = np.linalg.norm(_wide(x, dim) - _wide(np.array([c]), dim), axis=1)
            i = min(range(len(names)), key=lambda j: (gap[j], names[j]))
            out["group"].append(name)
            out["block"].append(names[i])
            out["gap"].append(float(gap[i]))
    return pa.table({"group": pa.array(out["group"], pa.string()), "block": pa.array(out["block"], pa.string()), "gap": pa.array(out["gap"], pa.float64())})


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _reachable(table: pa.Table, groups: pa.Table) -> pa.Table:
    """The blocks of a tile, but for the one that it was seeded with, in which a query of a group may reach its k-th score."""
    out = {"group": [], "block": []}
    if len(table) and len(groups):
        names, x, r = np.array(table.column("block").to_pylist(), object), _matrix(table.column("centre")), table.column("radius").to_numpy()
        for name, seed, index, worst in zip(*(groups.column(c).to_pylist() for c in ("group", "seed", "group_index", "worst")), strict=True):
            q = pickle.loads(index).tree.points
            dim = max(q.shape[1], x.shape[1])
            top = _wide(q, dim) @ _wide(x, dim).T + np.linalg.norm(q, axis=1)[:, None] * r
            may = (top + 1e-9 * np.abs(top) + 1e-6 >= np.frombuffer(worst)[:, None]).any(0) & (names != seed)
            out["group"] += [name] * int(may.sum())
            out["block"] += names[may].tolist()
    return pa.table({"group": pa.array(out["group"], pa.string()), "block": pa.array(out["block"], pa.string())})


_FOUND = "query_id long, vec_id long, score long"


def _searched(k: int, seeds: bool):
    """Search one group in one block; a seed also tells the k-th scores."""

    def run(table: pa.Table, groups: pa.Table) -> pa.Table:
        q, x = (pickle.loads(t.column(c)[0].as_py()) for t, c in ((groups, "group_index"), (table, "block_index")))
        worst = np.full(len(q.ids), -np.inf) if seeds else np.frombuffer(groups.column("worst")[0].as_py()).copy()
        found = [(int(q.ids[i][0]), -own, score) for i, heap in enumerate(dual_search(q, x, k, worst)) for score, own in heap]
        cols = [pa.array([r[i] for r in found], pa.int64()) for i in range(3)]
        if not seeds:
            return pa.table(cols, ["query_id", "vec_id", "score"])
        rows = pa.array([[{"query_id": a, "vec_id": b, "score": c} for a, b, c in found]], pa.list_(pa.struct([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])))
        return pa.table({"group": groups.column("group"), "seed": table.column("_b"), "worst": pa.array([worst.tobytes()], pa.binary()), "found": rows})

    return run


def _plain(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``_id, _v`` of the rows that take part, one row per id."""
    v = F.col("_v")
    whole = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v")).filter(whole)
    many = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > 1).select(F.col("_id").alias("_m"))
    if many.isEmpty():
        return rows
    again = rows.join(many, F.col("_id") == F.col("_m"), "left_semi").groupBy("_id").agg(F.min("_v").alias("_v"))
    return rows.join(many, F.col("_id") == F.col("_m"), "left_anti").unionByName(again)


def _dealt(rows: DataFrame, centres: np.ndarray, size: int) -> DataFrame:
    """``_id, _v, cell, part``: cells by the nearest centre, parts of at most about ``size`` rows by the id."""
    rows = rows.mapInArrow(_cells(centres), "_id long, _v array<double>, cell int") if len(centres) > 1 else rows.withColumn("cell", F.lit(0))
    count = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CENTRES rows
    parts = F.element_at(F.create_map(*(F.lit(x) for c, n in sorted(count.items()) for x in (c, -(-n // size)))), F.col("cell")) if count else F.lit(1)
    return rows.withColumn("part", F.pmod(F.xxhash64("_id"), parts.cast("long")).cast("int"))


def _tiled(blocks: DataFrame, groups: DataFrame, tiles: int):
    """Blocks by tile, with every group in each tile."""
    dealt = blocks.select("block", "centre", "radius", F.pmod(F.xxhash64("block"), F.lit(tiles)).cast("int").alias("tile")).groupBy("tile")
    return dealt.cogroup(groups.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).groupBy("tile"))


def plan(candidates: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Indexed blocks, seeded groups (with what their first blocks gave) and the pairs still to search; None if there is nothing to search."""
    x, q = _plain(candidates, vec_id, vector), _plain(queries, vec_id, vector)
    n = x.count()
    if not n or q.isEmpty():
        return None
    # few queries are few groups, as each group meets every block that it cannot rule out
    some = x.orderBy(F.xxhash64(F.lit("centre"), "_id"), "_id").limit(min(CENTRES, -(-n // BLOCK))).select("_v").collect()  # bounded
    centres = np.zeros((len(some), max(len(r._v) for r in some)))
    for i, r in enumerate(some):
        centres[i, : len(r._v)] = r._v
    row = "{0} string, centre array<double>, radius double, {0}_index binary"
    blocks = materialize(_dealt(x, centres, BLOCK).groupBy("cell", "part").applyInArrow(_indexed(scale, k + 1, LEAF, "block"), row.format("block")))
    groups = materialize(_dealt(q, centres[: -(-q.count() // GROUP)], GROUP).groupBy("cell", "part").applyInArrow(_indexed(scale, 1, LEAF, "group"), row.format("group")))
    tiles = -(-blocks.count() // TILE)
    near = _tiled(blocks, groups.select("group", "centre"), tiles).applyInArrow(_nearest, "group string, block string, gap double")
    first = near.groupBy("group").agg(F.min(F.struct("gap", "block")).getField("block").alias("block"))
    out = "group string, seed string, worst binary, found array<struct<query_id:bigint,vec_id:bigint,score:bigint>>"
    seeds = materialize(_paired(first, blocks, groups.drop("centre", "radius")).applyInArrow(_searched(k, True), out))
    groups = groups.select("group", "group_index").join(seeds.select("group", "seed", "worst"), "group")
    pairs = materialize(_tiled(blocks, groups, tiles).applyInArrow(_reachable, "group string, block string"))
    return blocks, groups, seeds, pairs


def _paired(pairs: DataFrame, blocks: DataFrame, groups: DataFrame):
    """Each pair's block with its group."""
    left = pairs.select(F.col("group").alias("_g"), F.col("block").alias("_b")).join(blocks.select(F.col("block").alias("_b"), "block_index"), "_b").groupBy("_g", "_b")
    return left.cogroup(pairs.join(groups, "group").groupBy("group", "block"))


def top_k(candidates: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank (from 1), vec_id, score`` of the k candidates with the highest inner products with each query."""
    made = plan(candidates, queries, vec_id=vec_id, vector=vector, k=k, scale=scale)
    if made is None:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, groups, seeds, pairs = made
    found = seeds.select(F.explode("found").alias("f")).select("f.*").unionByName(_paired(pairs, blocks, groups).applyInArrow(_searched(k, False), _FOUND))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP4_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

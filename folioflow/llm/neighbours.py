"""The most similar vectors of every vector, by stable projections and a kd-tree."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.plans.runtime import cut, spread

#: Kept beyond k while searching, so that values which tie once rounded are all seen.
SPARE = 5


@dataclass(frozen=True)
class Neighbours:
    """Parameters.

    ``projected`` Gaussian (2-stable) projections; a search stops when, for a point at the k-th
    distance found, a projection this far off has a chi-square probability of ``stop`` or more.
    ``block`` to ``most_block`` vectors are searched together in a task: as many as leave each slot a few
    blocks, since every block has the leaves it opens sent to it. Leaves hold ``leaf`` vectors. The tree over all blocks
    is fitted on about ``sample`` vectors, at most ``most_sample``; every vector is indexed.
    """

    k: int = 10
    dims: int = 64
    projected: int = 6
    stop: float = 0.85
    block: int = 8192
    most_block: int = 65_536
    leaf: int = 256
    sample: int = 20_000
    most_sample: int = 40_000
    seed: int = 7

    def projection(self) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.dims, self.projected))

    def chi_square(self) -> float:
        """The quantile ``stop`` of the chi-square distribution of ``projected`` degrees, by bisection."""
        from math import exp, gamma, lgamma, log

        def below(x: float) -> float:
            a, h = self.projected / 2, x / 2
            term = total = 1 / gamma(a + 1) if a < 100 else exp(-lgamma(a + 1))
            n = 1
            while term > total * 1e-15:
                term *= h / (a + n)
                total += term
                n += 1
            return total * exp(a * log(h) - h)

        low, high = 1e-9, 10.0 * self.projected + 100
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if below(mid) < self.stop else (low, mid)
        return low


@dataclass(frozen=True)
class Tree:
    """A complete kd-tree over projections: at each level every node has one dimension and one cut."""

    dims: np.ndarray
    cuts: np.ndarray
    depth: int

    @classmethod
    def fit(cls, points: np.ndarray, depth: int) -> Tree:
        dims, cuts = np.zeros(max(1, 2**depth), int), np.zeros(max(1, 2**depth))
        parts = {1: points}
        for node in range(1, 2**depth):
            own = parts.pop(node)
            if len(own):
                dims[node] = int(own.var(axis=0).argmax())
                cuts[node] = np.median(own[:, dims[node]])
            right = own[:, dims[node]] > cuts[node]
            parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
        return cls(dims, cuts, depth)

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), int)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dims[node]] > self.cuts[node])
        return node - 2**self.depth


def _leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    out, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            out.append(own)
            continue
        half = len(own) // 2
        order = np.argpartition(points[own, points[own].var(axis=0).argmax()], half)
        todo += [own[order[:half]], own[order[half:]]]
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    whole = vectors.astype(float)
    whole /= np.abs(whole).max(axis=1, keepdims=True)
    return whole / np.linalg.norm(whole, axis=1, keepdims=True)


class Block:
    """Vectors in the order of their leaves, with the leaves' boxes."""

    def __init__(self, leaves: list[tuple[np.ndarray, np.ndarray, dict[int, list[int]]]], p: Neighbours):
        ids, vectors, members = zip(*leaves)
        self.ids, self.members = np.concatenate(ids), {k: v for m in members for k, v in m.items()}
        self.unit = _unit(np.concatenate(vectors))
        self.points = self.unit @ p.projection()
        self.near = self.unit.astype(np.float32)
        self.edges = np.cumsum([0, *map(len, ids)])
        self.low = np.minimum.reduceat(self.points, self.edges[:-1])
        self.high = np.maximum.reduceat(self.points, self.edges[:-1])


def _beyond(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d])) ** 2
    return out


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared projected distance of each box of one list to each of another."""
    gap = np.maximum(lows[None, :, :] - high[:, None, :], low[:, None, :] - highs[None, :, :])
    return (np.maximum(0, gap) ** 2).sum(axis=2)


class Search:
    """The queries of one block, and the nearest found so far of each."""

    def __init__(self, block: Block, p: Neighbours):
        self.block, self.keep, self.kth = block, p.k + 1 + SPARE, p.k
        n = len(block.ids)
        self.ids = np.full((n, self.keep), np.iinfo(np.int64).max)
        self.cos = np.full((n, self.keep), -3.0)
        self.factor = p.chi_square()
        self.members: dict[int, list[int]] = {}

    def radius(self, rows) -> np.ndarray:
        """Squared projected distance at which the chi-square test stops the search of a query."""
        return self.factor * np.maximum(2e-6, 2 - 2 * (self.cos[rows, self.kth] - 1e-6))

    def visit(self, other: Block) -> None:
        """Look at the leaves of another block, nearest first, until the test stops each query."""
        own = self.block
        for a, b in zip(own.edges[:-1], own.edges[1:]):
            rows = np.arange(a, b)
            lower = _beyond(own.points[a:b], other.low, other.high)
            order = np.argsort(lower.mean(axis=0), kind="stable")
            self._sweep(rows, lower, order[:1], other)
            for start in range(1, len(order), 8):
                self._sweep(rows, lower, order[start : start + 8], other)

    def _sweep(self, rows: np.ndarray, lower: np.ndarray, leaves: np.ndarray, other: Block) -> None:
        own = self.block
        may = lower[:, leaves] <= self.radius(rows)[:, None]
        used, active = may.any(axis=0), may.any(axis=1)
        # Leaves that most of the queries open are compared in one product; a few more pairs cost less than many small ones.
        together = [used] if may[active][:, used].mean() > 0.6 else list(np.eye(len(leaves), dtype=bool)[used])
        found = []
        for chosen in together if active.any() else []:
            queries = rows[may[:, chosen].any(axis=1)]
            points = np.concatenate([np.arange(other.edges[x], other.edges[x + 1]) for x in leaves[chosen]])
            near = own.near[queries] @ other.near[points].T
            least = (self.cos[queries, -1] - 2e-6).astype(np.float32)
            hits = np.flatnonzero(near > least[:, None])
            if len(points) > self.keep and len(hits) > 4 * self.keep * len(queries):
                # Early on nearly all are nearer than what is known; of these points alone no more are kept either.
                best = np.partition(near, len(points) - self.keep, axis=1)[:, len(points) - self.keep]
                hits = np.flatnonzero(near > np.maximum(least, best - np.float32(4e-6))[:, None])
            if len(hits):
                found.append((queries[hits // len(points)], points[hits % len(points)]))
        if found:
            q, c = (np.concatenate(x) for x in zip(*found))
            exact = np.concatenate([np.einsum("ij,ij->i", own.unit[q[i : i + 65536]], other.unit[c[i : i + 65536]]) for i in range(0, len(q), 65536)])
            self._take(q, other.ids[c], exact)
            if other.members:
                self.members.update((i, other.members[i]) for i in set(other.ids[c].tolist()) & other.members.keys())

    def _take(self, q: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> None:
        touched = np.unique(q)
        rows = np.concatenate([np.repeat(touched, self.keep), q])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        cos = np.concatenate([self.cos[touched].ravel(), cos])
        order = np.lexsort((ids, -cos.round(6), rows))
        rows, ids, cos = rows[order], ids[order], cos[order]
        starts = np.searchsorted(rows, touched)
        pick = starts[:, None] + np.arange(self.keep)
        self.ids[touched], self.cos[touched] = ids[pick], cos[pick]

    def nearest(self, n: int) -> list[list[int]]:
        """The ids of the ``n`` nearest of each query, copies spelt out: highest cosine, then smallest id."""
        out = []
        for ids, cos in zip(self.ids.tolist(), self.cos.round(6).tolist()):
            if self.members and not self.members.keys().isdisjoint(ids):
                spelt = sorted((-c, m) for i, c in zip(ids, cos) if c > -2 for m in self.members.get(i, (i,)))
                out.append([m for _, m in spelt[:n]])
            else:
                out.append([i for i, c in zip(ids[:n], cos[:n]) if c > -2])
        return out


_BLOCK = "cell int, sub int, low array<double>, high array<double>, boxes binary, leaves array<binary>"
#: Leaves that are looked at together, nearest first, once they have come to a block.
_AT_ONCE = 16


def usable_vectors(vectors: DataFrame, p: Neighbours, row_id: str = "row_id", embedding: str = "embedding", indexed_at: str = "indexed_at") -> DataFrame:
    """``row_id, vkey, embedding``: the latest vector of each row, if it can be used.

    Of several rows of a row_id the one of the latest time counts (null lowest; ties: the greatest
    vector); it is usable if it has ``p.dims`` finite numbers, none null and not all zero. ``vkey`` is a
    128-bit hash, equal for equal vectors.
    """
    e = F.col("embedding")
    latest = (
        vectors.where(F.col(row_id).isNotNull())
        .groupBy(F.col(row_id).cast("bigint").alias("row_id"))
        .agg(F.max(F.struct(F.col(indexed_at).alias("at"), F.col(embedding).alias("embedding"))).alias("last"))
        .select("row_id", F.col("last.embedding").alias("embedding"))
    )
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = latest.where(e.isNotNull() & (F.size(e) == p.dims)).where(finite & F.exists(e, lambda x: x != 0))
    return good.select("row_id", F.struct(F.xxhash64("embedding").alias("x"), F.xxhash64(F.lit(1), "embedding").alias("y")).alias("vkey"), "embedding")


def nearest_vectors(vectors: DataFrame, p: Neighbours = Neighbours(), **columns: str) -> DataFrame:
    """``row_id, neighbours array<bigint>``: the ``p.k`` most similar other vectors of every usable vector.

    Similarity is the cosine in double precision, rounded to 6 decimals; ties go to the smaller row_id.
    Fewer than k others give fewer neighbours; an empty table gives no rows.

    Copies of one vector are one point of the index, with the k + 1 smallest row_ids they have (found
    by a grouped limit, so a group that holds a third of all rows is cut before it is shuffled) and
    the same neighbours for each. Points are projected and placed in the cells of a kd-tree fitted on
    a bounded sample; a cell is packed into blocks, and a block into leaves. Each block first searches
    itself, and from the distances found states which other cells can still hold a nearer point by
    the chi-square test. The boxes of those cells' leaves, without their points, are then compared with those
    of the block's own; only leaves that one of these can still open travel to the block, which takes them nearest first, a few at a time, each
    shrinking the radius that the next is tested with. So a task holds one block of queries, its
    results and a few leaves, whatever the size of the table. The stopping test is the only
    approximation: a visited leaf is searched whole.
    """
    usable = cut(usable_vectors(vectors, p, **columns))
    width = p.k + 1
    ranked = usable.withColumn("turn", F.row_number().over(Window.partitionBy("vkey").orderBy("row_id"))).where(F.col("turn") <= width)
    points = cut(
        ranked.groupBy("vkey")
        .agg(F.min("row_id").alias("rep"), F.sort_array(F.collect_list("row_id")).alias("members"), F.first("embedding").alias("embedding"))
        .select("rep", "vkey", "members", "embedding")
    )
    n = points.count()
    share = min(1.0, p.sample / max(1, n))
    sample = points.where(F.pmod(F.col("vkey.x"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("embedding").limit(p.most_sample)
    fitted = np.array([r[0] for r in sample.collect()], float).reshape(-1, p.dims)
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    block = int(min(max(p.block, n / (4 * slots)), max(p.block, p.most_block)))
    depth = int(np.ceil(np.log2(max(1.0, n / block))))
    depth = max(0, min(depth, int(np.log2(max(1, len(fitted) // 16)))))
    tree = Tree.fit(_unit(fitted) @ p.projection(), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = p.projection()
        for batch in batches:
            if batch.num_rows:
                values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, p.dims).astype(float)
                cells = pa.array(tree.cells(_unit(values) @ projection).astype(np.int32))
                yield pa.RecordBatch.from_arrays([cells, *(batch.column(i) for i in range(3))], names=["cell", "rep", "members", "embedding"])

    placed = points.select("rep", "members", "embedding").mapInArrow(place, "cell int, rep bigint, members array<bigint>, embedding array<float>")
    held = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [max(1, -(-held.get(c, 0) // (block * 2))) for c in range(2**depth)]
    subs = F.element_at(F.array(*map(F.lit, parts)), F.col("cell") + 1)

    def pack(table: pa.Table) -> pa.Table:
        members = table.column("members").to_pylist()
        ids = table.column("rep").to_numpy()
        values = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p.dims)
        points = _unit(values) @ p.projection()
        parts = _leaves(points, p.leaf)
        leaves = [(ids[x], values[x], {int(ids[i]): members[i] for i in x if len(members[i]) > 1}) for x in parts]
        low, high = (np.array([f(points[x], axis=0) for x in parts]) for f in (np.min, np.max))
        return pa.table(
            {
                "cell": table.column("cell").slice(0, 1), "sub": table.column("sub").slice(0, 1), "low": [low.min(axis=0).tolist()],
                "high": [high.max(axis=0).tolist()], "boxes": [pickle.dumps((low, high))], "leaves": [list(map(pickle.dumps, leaves))],
            }
        )

    blocks = cut(placed.withColumn("sub", F.pmod(F.xxhash64("rep"), subs).cast("int")).groupBy("cell", "sub").applyInArrow(pack, _BLOCK))
    edges = [F.min(F.col("low")[d]).alias(f"l{d}") for d in range(p.projected)] + [F.max(F.col("high")[d]).alias(f"h{d}") for d in range(p.projected)]
    boxes = {r.cell: [float(x) for x in tuple(r)[1:]] for r in blocks.groupBy("cell").agg(*edges).collect()}
    order = sorted(boxes)
    low = np.array([boxes[c][: p.projected] for c in order]).reshape(-1, p.projected)
    high = np.array([boxes[c][p.projected :] for c in order]).reshape(-1, p.projected)
    several = {c for c in order if held[c] > block * 2}

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Block(list(map(pickle.loads, row["leaves"])), p)
                search = Search(own, p)
                search.visit(own)
                radius = search.radius(slice(None))
                may = _beyond(own.points, low, high) <= radius[:, None]
                need = [c for i, c in enumerate(order) if may[:, i].any() and (c != row["cell"] or c in several)]
                asks = pickle.dumps((own.low, own.high, np.maximum.reduceat(radius, own.edges[:-1])))
                state = pickle.dumps((search.ids, search.cos, search.members))
                yield pa.RecordBatch.from_pylist([{"cell": row["cell"], "sub": row["sub"], "need": need, "asks": asks, "state": state}], schema=started)

    started = pa.schema([("cell", pa.int32()), ("sub", pa.int32()), ("need", pa.list_(pa.int32())), ("asks", pa.binary()), ("state", pa.binary())])
    states = cut(blocks.select("cell", "sub", "leaves").mapInArrow(begin, "cell int, sub int, need array<int>, asks binary, state binary"))
    wanted = states.select(F.col("cell").alias("qc"), F.col("sub").alias("qs"), "asks", F.explode("need").alias("to"))
    compared = wanted.join(blocks.select("cell", "sub", "boxes"), F.col("to") == F.col("cell")).where("not (qc = cell and qs = sub)")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qc, qs, cell, sub, asks, boxes in zip(*(batch[c].to_pylist() for c in ("qc", "qs", "cell", "sub", "asks", "boxes"))):
                own_low, own_high, radius = pickle.loads(asks)
                lower = _apart(own_low, own_high, *pickle.loads(boxes))
                leaf = np.flatnonzero((lower <= radius[:, None]).any(axis=0))
                fixed = [pa.array(np.full(len(leaf), x, np.int32)) for x in (qc, qs, cell, sub)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(leaf.astype(np.int32)), pa.array(lower[:, leaf].mean(axis=0))], names=["qc", "qs", "cell", "sub", "leaf", "far"])

    opens = compared.select("qc", "qs", "cell", "sub", "asks", "boxes").mapInArrow(opened, "qc int, qs int, cell int, sub int, leaf int, far double")
    leaves = blocks.select("cell", "sub", F.posexplode("leaves").alias("leaf", "data"))
    visits = opens.join(leaves, ["cell", "sub", "leaf"]).select("qc", "qs", "far", F.array("data").alias("data"), F.lit(None).cast("binary").alias("state"))
    begun = states.join(blocks, ["cell", "sub"]).select(F.col("cell").alias("qc"), F.col("sub").alias("qs"), F.lit(-1.0).alias("far"), F.col("leaves").alias("data"), "state")
    stream = visits.unionByName(begun)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(search: Search) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(search.block.ids), pa.array(search.nearest(width), pa.list_(pa.int64()))], names=["rep", "near"])

        search, waiting = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                own, state = list(map(pickle.loads, batch.column(3)[i].as_py())), batch.column(4)[i].as_py()
                if waiting and (state is not None or len(waiting) >= _AT_ONCE):
                    search.visit(Block(waiting, p))
                    waiting = []
                if state is None:
                    waiting += own
                    continue
                if search is not None:
                    yield done(search)
                search = Search(Block(own, p), p)
                search.ids, search.cos, search.members = pickle.loads(state)
        if waiting:
            search.visit(Block(waiting, p))
        if search is not None:
            yield done(search)

    # Blocks are numbered through, so that each has a task of its own.
    number = F.element_at(F.array(*[F.lit(sum(parts[:c])) for c in range(2**depth)]), F.col("qc") + 1) + F.col("qs")
    found = stream.repartitionById(sum(parts), number).sortWithinPartitions("qc", "qs", "far").mapInArrow(finish, "rep bigint, near array<bigint>")
    by_key = found.join(points.select("rep", "vkey"), "rep").select("vkey", "near")
    of_row = usable.select("row_id", "vkey").join(by_key, "vkey")
    others = F.slice(F.filter("near", lambda x: x != F.col("row_id")), 1, p.k)
    return of_row.select("row_id", others.alias("neighbours"))


def neighbour_pairs(nearest: DataFrame) -> DataFrame:
    """``row_id_a < row_id_b``: pairs of which at least one is among the nearest of the other."""
    one = nearest.select("row_id", F.explode("neighbours").alias("other"))
    return one.select(F.least("row_id", "other").alias("row_id_a"), F.greatest("row_id", "other").alias("row_id_b")).distinct()

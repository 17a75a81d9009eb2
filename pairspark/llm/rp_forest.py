"""Approximate nearest neighbours: a forest of random-projection trees, then exact reranking.

The trees' planes and medians come from a bounded sample; every vector is then put into its leaf of
every tree. A query walks all trees through one shared priority queue, ordered by the squared
margins it had to cross, until it has opened a fixed share of the leaves. Queries and vectors meet
per leaf, both cut into bounded parts, where the inner products are taken exactly in double
precision. Of equal vectors only the ``k + 1`` smallest ids can be among the ``k`` nearest, so no
leaf fills up with copies.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, stored

#: Trees, share of all leaves that a query opens, and rows (on average) that the planes are fitted on.
TREES, OPENED, SAMPLE = 2, 0.45, 16_384
#: Leaves double while they would hold more rows than this, within these depths.
LEAF_ROWS, LEAST_DEPTH, MOST_DEPTH = 65_536, 6, 12
#: Vectors and queries of a leaf that meet in one group.
PART_VECTORS, PART_QUERIES = 16_384, 8_192


class Forest:
    """Trees of planes: level by level, a node's children are numbered ``2 i`` and ``2 i + 1``."""

    def __init__(self, sample, depth: int, trees: int = TREES, seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.depth, self.trees, width = depth, [], sample.shape[1]
        for _ in range(trees):
            planes, cuts, groups = [], [], [sample]
            for level in range(depth):
                plane, cut, below = np.zeros((1 << level, width)), np.zeros(1 << level), []
                for node, rows in enumerate(groups):
                    # Between two sampled vectors, so that planes follow the data.
                    way = rows[rng.integers(len(rows))] - rows[rng.integers(len(rows))] if len(rows) else np.zeros(width)
                    if not way.any():
                        way = rng.normal(size=width)
                    plane[node] = way / np.linalg.norm(way)
                    along = rows @ plane[node]
                    cut[node] = np.median(along) if len(rows) else 0.0
                    below += [rows[along <= cut[node]], rows[along > cut[node]]]
                planes.append(plane)
                cuts.append(cut)
                groups = below
            self.trees.append((planes, cuts))

    def leaves(self, rows):
        """Leaf of each row in each tree, as ``tree << MOST_DEPTH | leaf``."""
        import numpy as np

        out = []
        for t, (planes, cuts) in enumerate(self.trees):
            node = np.zeros(len(rows), np.int64)
            for plane, cut in zip(planes, cuts):
                node = 2 * node + (np.einsum("ij,ij->i", rows, plane[node]) > cut[node])
            out.append(node + (t << MOST_DEPTH))
        return out

    def nearest_leaves(self, row, count: int) -> list[int]:
        """The first ``count`` leaves from the queue shared by all trees."""
        queue = [(0.0, 0, t, 0) for t in range(len(self.trees))]
        found: list[int] = []
        along = [[plane @ row - cut for plane, cut in zip(*tree)] for tree in self.trees]
        while queue and len(found) < count:
            crossed, level, t, node = heapq.heappop(queue)
            if -level == self.depth:
                found.append((t << MOST_DEPTH) + node)
                continue
            margin = float(along[t][-level][node])
            near = 2 * node + (margin > 0)
            heapq.heappush(queue, (crossed, level - 1, t, near))
            heapq.heappush(queue, (crossed + margin * margin, level - 1, t, near ^ 1))
        return found


def _matrix(column):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _as_bytes(batch):
    import numpy as np

    rows = batch.column(1).to_pylist()
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(v, "<f8").tobytes() for v in rows], pa.binary())], names=["vec_id", "v"])


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, v`` (eight bytes a component) of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
                      " AND exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size("v") == (sizes["size"] if sizes else 0))
    return rows.mapInArrow(by_batch(_as_bytes), "vec_id long, v binary")


def _search(k: int):
    """The cogroup function: the ``k`` nearest vectors of a part of a leaf to each query there."""

    def run(vectors, queries):
        import numpy as np

        out_q, out_v, out_s = [], [], []
        if vectors.num_rows and queries.num_rows:
            ids, x = vectors["vec_id"].to_numpy(), _matrix(vectors["v"])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            # Rows of one id count as its nearest one before the k nearest are taken.
            each, first, many = np.unique(ids, return_index=True, return_counts=True)
            asked, q = queries["query_id"].to_numpy(), _matrix(queries["v"])
            for at in range(0, len(q), 256):
                near = q[at:at + 256] @ x.T
                near[asked[at:at + 256, None] == ids[None, :]] = -np.inf
                if len(each) < len(ids):
                    near = np.maximum.reduceat(near, first, axis=1)
                most = min(k, len(each))
                floor = np.partition(near, len(each) - most, axis=1)[:, len(each) - most]
                for row, low in enumerate(floor):
                    # Products by blocks may differ in the last place, also for equal vectors; the
                    # final ones are summed in one fixed order.
                    pick = np.flatnonzero((near[row] >= low - 1e-9 * max(1.0, abs(low))) & (near[row] > -np.inf)) if np.isfinite(low) else np.flatnonzero(near[row] > -np.inf)
                    if len(each) < len(ids):
                        pick = np.concatenate([np.arange(first[i], first[i] + many[i]) for i in pick]) if len(pick) else pick
                    score = (x[pick] * q[at + row]).sum(axis=1)
                    best = np.lexsort((ids[pick], -score))
                    if len(each) < len(ids):
                        best = best[np.sort(np.unique(ids[pick][best], return_index=True)[1])]
                    best = best[:k]
                    out_q.append(np.full(len(best), asked[at + row]))
                    out_v.append(ids[pick][best])
                    out_s.append(score[best])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.array([], kind))
        return pa.table({"query_id": join(out_q, np.int64), "vec_id": join(out_v, np.int64), "score": join(out_s, np.float64)})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, opened: float = OPENED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for each query.

    ``vectors`` and ``queries`` have ``vec_id, v`` as :func:`usable` makes them: null vectors, zero
    vectors, those with null or non-finite components, those of another length than the most
    frequent one (the shorter one in a tie) and rows without an id take no part. A query never
    meets its own id. Repeated rows count once; of one id with several vectors the nearest counts.
    Nearness is the largest inner product, equal ones go to the smaller id. An empty side gives
    no rows.
    """
    import numpy as np

    copies = Window.partitionBy("v").orderBy("vec_id")
    distinct = stored(vectors.select("vec_id", "v").distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("vec_id", "v"), "forest-vectors")
    n = distinct.count()
    asked = queries.select(F.col("vec_id").alias("query_id"), "v").distinct()
    depth = LEAST_DEPTH
    while depth < MOST_DEPTH and n >> depth > LEAF_ROWS:
        depth += 1
    point = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    drawn = distinct.where(point < min(1.0, SAMPLE / max(1, n))).orderBy("vec_id", "v").collect()
    sample = np.array([np.frombuffer(r["v"], "<f8") for r in drawn]) if drawn else np.zeros((1, 1))
    forest = Forest(sample, depth, trees)
    count = max(1, round(opened * trees * (1 << depth)))

    def place(batch):
        x = _matrix(batch.column(1))
        cells = forest.leaves(x)
        reps = len(cells)
        index = np.tile(np.arange(len(x)), reps)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), batch.column(0).take(pa.array(index)), batch.column(1).take(pa.array(index))], names=["cell", "vec_id", "v"])

    def probe(batch):
        x = _matrix(batch.column(1))
        cells = [forest.nearest_leaves(row, count) for row in x]
        index = np.repeat(np.arange(len(x)), [len(c) for c in cells])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.array(c, np.int64) for c in cells])), batch.column(0).take(pa.array(index)), batch.column(1).take(pa.array(index))], names=["cell", "query_id", "v"])

    placed = stored(distinct.mapInArrow(by_batch(place), "cell long, vec_id long, v binary"), "forest-index")
    probes = stored(asked.mapInArrow(by_batch(probe), "cell long, query_id long, v binary"), "forest-probes")
    # Parts per leaf: a table of at most trees x 2^MOST_DEPTH rows.
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_VECTORS).alias("parts"))
    blocks = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).alias("blocks"))
    shape = stored(parts.join(blocks, "cell"), "forest-shape")

    def spread(rows, own, of, other):
        pick = F.pmod(F.xxhash64(own), F.col(of))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return rows.join(F.broadcast(shape), "cell").select("cell", own, "v", pick.alias(of[:-1]), every.alias(other[:-1]))

    left = spread(placed, "vec_id", "parts", "blocks").select(F.struct("cell", "part", "block").alias("group"), "vec_id", "v")
    right = spread(probes, "query_id", "blocks", "parts").select(F.struct("cell", "part", "block").alias("group"), "query_id", "v")
    found = left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(
        lambda a, b: _search(k)(a, b), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

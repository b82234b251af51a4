"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results merged.

Rows are dealt to shards of about SHARD_ROWS by a hash of vec_id (and by dimension). In a shard equal vectors
become one node that keeps all their ids, so a vector that is a third of all rows costs one node a shard. A graph
is stored as flat arrays: vectors, ids with offsets, and for each level the nodes on it and a matrix of
neighbours, padded with -1. Nodes are linked in blocks, with the nearest of those inserted before them; each graph is
loaded once and all queries stream past it, in blocks that walk it together; the shards' results are merged and ranked.

Every row is indexed; no sample is fitted. Distances of results are computed again in double precision on the
original vectors. Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part; a query never finds its own row but does find other rows with an equal vector; ties go to the smaller
vec_id; with fewer than k candidates all are returned; queries search vectors of their own dimension only. Rows
with a null vec_id take no part. Of repeated rows (equal vec_id and vector) one counts.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import table, written

SHARD_ROWS = 8192
LINKS, BUILD, SEARCH = 24, 128, 128  # neighbours a node asks for (twice that on level 0), candidates in building and in search
BLOCK, VALUES = 256, 1 << 22  # most nodes linked or queries asked at a time, and numbers of vectors compared then: what bounds memory
STEP = 4  # nodes whose links a query follows at a time
SEED = 5


class Graph:
    """A navigable small-world graph over distinct float32 vectors.

    Nodes are inserted in order, the entry first. On each of its levels a node is linked with a choice of the nodes
    before it that are nearest to it, and they with it; a node that then has too many links keeps a choice of them.
    All nodes of a level are linked in blocks: the nearest before each are found by one matrix product.
    """

    def __init__(self, vectors, links: int = LINKS, build: int = BUILD, seed: int = SEED):
        import numpy as np

        self.x, n = np.ascontiguousarray(vectors, np.float32), len(vectors)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        draw = np.random.default_rng(seed).random(n) if n else np.zeros(0)
        top = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int), 6)
        self.levels = int(top.max()) + 1 if n else 0
        self.entry = int(top.argmax()) if n else -1
        self.near, self.count = [], []
        order = np.concatenate([[self.entry], np.delete(np.arange(n), self.entry)]) if n else np.zeros(0, int)
        for level in range(self.levels):
            near, count = self._level(order[top[order] >= level], links, 2 * links if level == 0 else links, build)
            self.near.append(near)
            self.count.append(count)

    def _level(self, nodes, links: int, most: int, build: int):
        """Neighbours (padded with -1) and their number for all nodes of the graph, on the level of ``nodes``."""
        import numpy as np

        near, count = np.full((len(self.x), most), -1, np.int32), np.zeros(len(self.x), np.int32)
        ends: list[tuple] = []
        dim = self.x.shape[1]
        size = max(1, min(BLOCK, VALUES // (build * dim)))
        for begin in range(0, len(nodes), size):
            block = nodes[begin : begin + size]
            before = nodes[: begin + len(block)]
            far = self.norms[block][:, None] + self.norms[before][None, :] - 2 * (self.x[block] @ self.x[before].T)
            far[np.arange(len(before))[None, :] >= begin + np.arange(len(block))[:, None]] = np.inf
            at = np.argpartition(far, build - 1, 1)[:, :build] if len(before) > build else np.broadcast_to(np.arange(len(before)), far.shape)
            i, j = np.nonzero(self._pick(block, before[at], np.take_along_axis(far, at, 1), links))
            ends.append((block[i], before[at[i, j]], far[i, at[i, j]]))
        one, other, far = (np.concatenate(c) for c in zip(*ends, strict=True))
        one, other, far = np.concatenate([one, other]), np.concatenate([other, one]), np.concatenate([far, far])
        by = np.lexsort([other, far, one])
        one, other, far = one[by], other[by], far[by]
        has = np.bincount(one, minlength=len(self.x))
        first = np.cumsum(has) - has
        waiting = nodes[np.argsort(has[nodes], kind="stable")]
        while len(waiting):  # nodes with equally many links together, in rows padded to the longest
            size = max(1, min(BLOCK, VALUES // (dim * max(1, int(has[waiting[:BLOCK][-1]])))))
            block, waiting = waiting[:size], waiting[size:]
            place = np.arange(max(1, int(has[block].max())))[None, :]
            here = place < has[block][:, None]
            at = np.where(here, first[block][:, None] + place, 0)
            kept = here if place.size <= most else self._pick(block, other[at], np.where(here, far[at], np.inf), most)
            i, j = np.nonzero(kept)
            count[block] = kept.sum(1)
            near[block[i], (np.cumsum(kept, 1) - 1)[i, j]] = other[at[i, j]]
        return near, count

    def _pick(self, nodes, found, far, most: int):
        """Marks at most ``most`` of each node's ``found`` (at distances ``far``, infinite for none): the nearest, leaving
        out those nearer to one already picked, then filled up with the nearest left out."""
        import numpy as np

        order = np.argsort(far, 1, kind="stable")
        found, sorted_far = np.take_along_axis(found, order, 1), np.take_along_axis(far, order, 1)
        x, norms, rows = self.x[found], self.norms[found], np.arange(len(nodes))
        real = np.isfinite(sorted_far)
        open_, kept = real.copy(), np.zeros(far.shape, bool)
        for _ in range(most):
            k = open_.argmax(1)
            has = open_[rows, k]
            if not has.any():
                break
            kept[rows[has], k[has]] = True
            between = norms + norms[rows, k][:, None] - 2 * np.matmul(x, x[rows, k][:, :, None])[:, :, 0]
            open_ &= ~has[:, None] | (between > sorted_far)
            open_[rows, k] = False
        rest = real & ~kept
        kept |= rest & (np.cumsum(rest, 1) <= (most - kept.sum(1))[:, None])
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, order, kept, 1)
        return out

    def _descend(self, q, at, most: int, level: int):
        """For each row of ``q``, the ``most`` nearest nodes found on a level from the nodes ``at``; -1 where there are fewer.

        All queries take their steps together. A step follows the links of the STEP nearest nodes of each query's list that
        it has not followed yet; a query is done when its list has none.
        """
        import numpy as np

        near, live = self.near[level], np.arange(len(q))
        seen = np.full((len(q), len(self.x)), -1, np.int32)
        ids, far = np.full((len(q), most), -1, np.int32), np.full((len(q), most), np.inf, np.float32)
        done = np.ones((len(q), most), bool)
        new, stamp = at, 0
        while True:
            valid = new >= 0
            valid &= seen[live[:, None], new] < 0
            i, j = np.nonzero(valid)
            seen[live[i], new[i, j]] = stamp + j
            valid[i, j] = seen[live[i], new[i, j]] == stamp + j  # of nodes met twice in a step one counts
            stamp += new.shape[1]
            d = self.norms[new] - 2 * np.matmul(self.x[new], q[live][:, :, None])[:, :, 0]
            all_far = np.concatenate([far[live], np.where(valid, d, np.float32(np.inf))], 1)
            k = np.argpartition(all_far, most - 1, 1)[:, :most]
            far[live] = here = np.take_along_axis(all_far, k, 1)
            ids[live] = np.where(np.isfinite(here), np.take_along_axis(np.concatenate([ids[live], new], 1), k, 1), -1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~valid], 1), k, 1)
            waits = np.where(done[live], np.inf, here)
            k = np.argsort(waits, 1, kind="stable")[:, :STEP]
            go = np.isfinite(np.take_along_axis(waits, k, 1))
            left = go.any(1)
            if not left.any():
                return ids
            live, k, go = live[left], k[left], go[left]
            i, j = np.nonzero(go)
            done[live[i], k[i, j]] = True
            new = np.where(go[:, :, None], near[ids[live[:, None], k]], -1).reshape(len(live), -1)

    def search(self, q, most: int):
        """Nodes near each row of ``q``, at most ``most``, in no order; -1 where there are fewer."""
        import numpy as np

        at = np.full((len(q), 1), self.entry, np.int32)
        for level in range(self.levels - 1, 0, -1):
            at = self._descend(q, at, 1, level)
        return self._descend(q, at, most, 0)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", bad), F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    ).select("vec_id", F.col("embedding").cast("array<float>").alias("vector"))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Shard graphs, one row for each: shard, dim and the flat arrays."""
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    placed = rows.select("vec_id", "vector", F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(shards)).cast("int").alias("shard"), F.size("vector").alias("dim"))

    def build(key, part):
        import numpy as np
        import pyarrow as pa

        ids = part.column("vec_id").to_numpy()
        x = np.stack(part.column("vector").to_numpy()).astype(np.float32)
        x += np.float32(0)  # -0.0 becomes 0.0, so equal vectors have equal bytes
        _, first, node = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
        order = np.lexsort([ids, node])
        ids, node = ids[order], node[order]
        once = np.ones(len(ids), bool)
        once[1:] = (ids[1:] != ids[:-1]) | (node[1:] != node[:-1])
        ids, node = ids[once], node[once]
        graph = Graph(x[first])
        flat = {
            "vectors": x[first].tobytes(), "ids": ids.astype("<i8").tobytes(), "id_ends": np.searchsorted(node, np.arange(len(first)), "right").astype("<i8").tobytes(),
            "neighbours": [m.tobytes() for m in graph.near], "counts": [c.tobytes() for c in graph.count],
        }
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "entry": pa.array([graph.entry], pa.int32())} | {k: pa.array([v]) for k, v in flat.items()})

    schema = "shard int, dim int, entry int, vectors binary, ids binary, id_ends binary, neighbours array<binary>, counts array<binary>"
    return written(placed.groupBy("shard", "dim").applyInArrow(build, schema), "ann-index")


def stored_graph(row: dict):
    """A graph from its stored row, its ids and where each node's ids end."""
    import numpy as np

    g = Graph.__new__(Graph)
    g.x = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"])
    g.norms, g.entry, g.levels = np.einsum("ij,ij->i", g.x, g.x), row["entry"], len(row["counts"])
    g.near = [np.frombuffer(m, np.int32).reshape(len(g.x), -1) for m in row["neighbours"]]
    g.count = [np.frombuffer(c, np.int32) for c in row["counts"]]
    return g, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["id_ends"], "<i8")


class Shard:
    """A shard's graph, loaded once and asked many times."""

    def __init__(self, row: dict):
        import numpy as np

        self.graph, self.ids, self.ends = stored_graph(row)
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.x = self.graph.x.astype(np.float64)

    def search(self, q, own: list[int], k: int, most: int = SEARCH) -> list[tuple[int, int, float]]:
        """(own, vec_id, score) of the k nearest to each row of ``q`` but ``own``."""
        import numpy as np

        found: list[tuple[int, int, float]] = []
        size = max(1, min(BLOCK, VALUES // (STEP * self.graph.near[0].shape[1] * q.shape[1])))
        for begin in range(0, len(q), size):
            for i, nodes in enumerate(self.graph.search(q[begin : begin + size], most), begin):
                nodes = nodes[nodes >= 0]
                reached = int((self.ends[nodes] - self.begins[nodes]).sum())
                if reached < min(k + 1, len(self.ids)):  # a part of the graph that can't be reached
                    nodes = np.arange(len(self.x))
                scores = np.sqrt(((self.x[nodes] - q[i].astype(np.float64)) ** 2).sum(1))
                mine: list[tuple[float, int]] = []
                for j in np.lexsort([nodes, scores]):
                    if len(mine) >= k and scores[j] > mine[k - 1][0]:
                        break
                    first = self.begins[nodes[j]]
                    mine += [(float(scores[j]), v) for v in self.ids[first : min(self.ends[nodes[j]], first + k + 1)].tolist() if v != own[i]]
                found += [(own[i], v, s) for s, v in sorted(mine)[:k]]
        return found


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, most: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries``: vec_id and vector.

    Each graph moves once, to the task of its shard, and is followed there by the queries, which stream past it; so what
    moves is the index and, for each shard, the queries' vectors.
    """
    shards = index.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] + 1
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = queries.select(every, F.size("vector").alias("dim"), F.lit(1).alias("kind"), "vec_id", "vector")
    both = index.withColumn("kind", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    names = ["shard", "dim", "kind", "entry", "vectors", "ids", "id_ends", "neighbours", "counts"]
    in_turn = both.repartition("shard", "dim").sortWithinPartitions("shard", "dim", "kind").select(*names, "vec_id", "vector")

    def search(batches):
        import numpy as np
        import pyarrow as pa

        here, shard = None, None
        for batch in batches:
            got: list[tuple] = []
            places = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
            for (number, dim, kind), run in groupby(range(len(places)), key=places.__getitem__):
                run = list(run)
                if kind == 0:
                    here, shard = (number, dim), Shard(dict(zip(names, (batch.column(c)[run[0]].as_py() for c in range(len(names))), strict=True)))
                elif here == (number, dim):  # else no row of that dimension is in the shard
                    asked = batch.slice(run[0], len(run))
                    q = asked.column(10).flatten().to_numpy().astype(np.float32).reshape(len(run), dim)
                    got += shard.search(q, asked.column(9).to_pylist(), k, most)
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = in_turn.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(build_index(rows), rows.where(F.col("vec_id") % 100 == 0))

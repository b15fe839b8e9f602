"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Vectors are dealt to shards of about ``SHARD_VECTORS`` by hash; equal vectors are one node. For the
greatest inner product a vector x with its shard's greatest norm M gets one more component,
sqrt(M^2 - |x|^2); among such vectors the nearest to (q, 0) has the greatest product with q. Each shard
becomes a hierarchical graph: a node reaches level n with probability 1 / ``DEGREE`` ** n, every level
links near nodes in a flat neighbour array, and a search descends from the top level to a beam of width
``beam`` at the bottom. Nodes are inserted, and queries searched, in groups that step together in numpy.

The index is a table with one row per shard (flat arrays), written to the shared folder. A search sends
blocks of queries to every shard, keeps each shard's best, and merges them by their exact product in
double precision. All vectors are indexed; recall is measured in the tests.

Vectors that are null, empty, zero, or hold a null or non-finite component take no part. Vectors of other
lengths than a query's are no candidates of it. Equal vectors differ in id only, so a node keeps just the
smallest ``k + 1`` of its ids, of which at most one is the query's own: no result is lost. Repeated ids
are separate rows. Fewer than ``k`` candidates are all returned. An empty table gives an empty table.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriloom.llm.frames import small_batches
from metriloom.session import written

SHARD_VECTORS = 4_096
DEGREE = 16
BUILD_BEAM = 64
BEAM = 96
GROUP = 256  # nodes or queries that step together
QUERY_BLOCK = 512


def usable(vector: str | Column) -> Column:
    """Vectors that take part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


class Graph:
    """Levels of neighbour arrays over the rows of ``vectors``; -1 fills short lists."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors = vectors  # float32, rows
        self.levels = levels  # from the top: (member rows, neighbours as places among the members)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Graph:
        n = len(vectors)
        height = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
        height[0] = max(0, height.max()) if n else 0
        levels = []
        for level in range(int(height.max()) if n else 0, -1, -1):
            members = np.flatnonzero(height >= level)
            levels.append((members, _link(vectors[members], 2 * DEGREE if level == 0 else DEGREE)))
        return cls(vectors, levels)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and squared distances of the ``beam`` nearest found, nearest first; -1 and inf fill up."""
        at = np.zeros((len(queries), 1), dtype=np.int64)
        for i, (members, neighbours) in enumerate(self.levels):
            last = i == len(self.levels) - 1
            found, distances = _beam(self.vectors[members], neighbours, queries, at, beam if last else 1)
            at = np.searchsorted(self.levels[i + 1][0], members[found]) if not last else at
        return np.where(found >= 0, members[found], -1), distances

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{kind}{i}": a.astype(np.int32) for i, level in enumerate(self.levels) for kind, a in zip("mn", level)}
        np.savez(out, vectors=self.vectors, **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as f:
            count = sum(k[0] == "m" for k in f.files)
            return cls(f["vectors"], [(f[f"m{i}"].astype(np.int64), f[f"n{i}"].astype(np.int64)) for i in range(count)])


def _distances(vectors: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distance of each query to its own row of candidates."""
    gap = vectors[rows] - queries[:, None, :]
    return np.einsum("qcd,qcd->qc", gap, gap)


def _beam(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: each opens its nearest node that is not open yet."""
    q, n = len(queries), len(vectors)
    found = np.full((q, width), -1, dtype=np.int64)
    distance = np.full((q, width), np.inf, dtype=np.float32)
    opened = np.ones((q, width), dtype=bool)
    found[:, :1], distance[:, :1], opened[:, :1] = start, _distances(vectors, start, queries), False
    seen = np.zeros((q, n), dtype=bool)
    seen[np.arange(q), start[:, 0]] = True
    live = np.arange(q)
    while len(live):
        waiting = np.where(opened[live], np.inf, distance[live])
        best = waiting.argmin(axis=1)
        go = np.isfinite(waiting[np.arange(len(live)), best])
        live, best = live[go], best[go]
        if not len(live):
            break
        opened[live, best] = True
        near = neighbours[found[live, best]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[np.repeat(live, fresh.sum(axis=1)), near[fresh]] = True
        d = np.where(fresh, _distances(vectors, np.maximum(near, 0), queries[live]), np.inf)
        ids = np.concatenate([found[live], near], axis=1)
        ds = np.concatenate([distance[live], d.astype(np.float32)], axis=1)
        op = np.concatenate([opened[live], ~fresh], axis=1)
        top = np.argsort(ds, axis=1, kind="stable")[:, :width]
        found[live], distance[live], opened[live] = (np.take_along_axis(x, top, axis=1) for x in (ids, ds, op))
        found[live] = np.where(np.isfinite(distance[live]), found[live], -1)
    return found, distance


def _link(vectors: np.ndarray, degree: int) -> np.ndarray:
    """Neighbour array of one level. Nodes come in growing groups; each is tied to diverse near nodes."""
    n = len(vectors)
    neighbours = np.full((n, degree), -1, dtype=np.int64)
    done = 0
    while done < n:
        size = min(n - done, max(1, min(GROUP, done)))
        group = np.arange(done, done + size)
        inside = vectors[group] @ vectors[group].T
        norms = np.einsum("nd,nd->n", vectors[group], vectors[group])
        mutual = np.maximum(norms[:, None] + norms[None, :] - 2 * inside, 0)
        np.fill_diagonal(mutual, np.inf)
        ids, ds = np.tile(group, (size, 1)), mutual
        if done:
            a, b = _beam(vectors[:done], neighbours[:done], vectors[group], np.zeros((size, 1), dtype=np.int64), BUILD_BEAM)
            ids, ds = np.concatenate([a, ids], axis=1), np.concatenate([b, ds], axis=1)
        order = np.argsort(ds, axis=1, kind="stable")[:, :BUILD_BEAM]
        ids, ds = np.take_along_axis(ids, order, axis=1), np.take_along_axis(ds, order, axis=1)
        chosen = _diverse(vectors, ids, ds, max(1, degree // 2))
        back: dict[int, list[int]] = {}
        for node, row in zip(group.tolist(), chosen):
            row = row[row >= 0]
            neighbours[node, : len(row)] = row
            for other in row.tolist():
                back.setdefault(other, []).append(node)
        over = []
        for other, new in back.items():
            old = neighbours[other]
            old = old[old >= 0]
            every = np.concatenate([old, np.setdiff1d(new, old)])
            if len(every) <= degree:
                neighbours[other, : len(every)] = every
            else:
                over.append((other, every))
        if over:
            longest = max(len(e) for _, e in over)
            ids = np.array([np.pad(e, (0, longest - len(e)), constant_values=-1) for _, e in over])
            nodes = np.array([o for o, _ in over])
            ds = np.where(ids >= 0, _distances(vectors, np.maximum(ids, 0), vectors[nodes]), np.inf)
            order = np.argsort(ds, axis=1, kind="stable")
            kept = _diverse(vectors, np.take_along_axis(ids, order, axis=1), np.take_along_axis(ds, order, axis=1), degree)
            neighbours[nodes] = kept
        done += size
    return neighbours


def _diverse(vectors: np.ndarray, ids: np.ndarray, ds: np.ndarray, count: int) -> np.ndarray:
    """Of candidates sorted by distance, those nearer to the node than to any chosen one, then the nearest others."""
    q, c = ids.shape
    free = np.isfinite(ds)
    nearest_chosen = np.full((q, c), np.inf, dtype=np.float32)
    chosen = np.full((q, count), -1, dtype=np.int64)
    rows = np.arange(q)
    spread = vectors[np.maximum(ids, 0)]
    for i in range(count):
        good = free & (ds < nearest_chosen)
        pick = np.where(good.any(axis=1), good.argmax(axis=1), free.argmax(axis=1))
        ok = free[rows, pick]
        if not ok.any():
            break
        chosen[ok, i] = ids[rows, pick][ok]
        free[rows[ok], pick[ok]] = False
        gap = spread - spread[rows, pick][:, None, :]
        nearest_chosen = np.minimum(nearest_chosen, np.einsum("qcd,qcd->qc", gap, gap))
    return chosen


def build_index(df: DataFrame, vector: str = "embedding", id: str = "vec_id", k: int = 20, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """``shard, size, graph, ids, vectors``: one row per shard, as flat arrays.

    ``vectors`` are the originals in double precision, ``ids`` the smallest ``k + 1`` ids of each node.
    """
    rows = df.where(usable(vector)).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # Spark limits each task to k + 1 ids of a vector before the shuffle
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    nodes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = written(nodes.withColumn("size", F.size("v")), "vectors")
    shards = {r["size"]: max(1, -(-r["n"] // shard_vectors)) for r in nodes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    number = F.lit(1).cast("long")
    for size, n in shards.items():
        number = F.when(F.col("size") == size, F.lit(n).cast("long")).otherwise(number)
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), number)).repartition(max(1, sum(shards.values())), "size", "shard")
    small_batches(df.sparkSession)

    def run(batches):
        import pandas as pd

        def solve(frame):
            v = np.stack(frame["v"].tolist())
            norm = np.einsum("nd,nd->n", v, v)
            wide = np.concatenate([v, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1).astype(np.float32)
            lists = frame["ids"].tolist()
            lengths = np.array([len(x) for x in lists], dtype=np.int64)
            return [int(frame["size"].iloc[0]), int(frame["shard"].iloc[0]), Graph.build(wide).to_bytes(), np.concatenate(lists).astype("<i8").tobytes(), lengths.tobytes(), v.tobytes()]

        held = pd.concat([b.to_pandas() for b in batches] or [pd.DataFrame({"size": [], "shard": []})], ignore_index=True)
        for _, frame in held.groupby(["size", "shard"]):
            out = solve(frame.reset_index(drop=True))
            kinds = [pa.int32(), pa.int64(), *[pa.large_binary()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], type=pa.binary() if k == pa.large_binary() else k) for x, k in zip(out, kinds)],
                names=["size", "shard", "graph", "ids", "id_counts", "vectors"],
            )

    schema = "size int, shard long, graph binary, ids binary, id_counts binary, vectors binary"
    return dealt.select("size", "shard", "ids", "v").mapInArrow(run, schema)


def search(index: DataFrame, queries: DataFrame, vector: str = "embedding", id: str = "vec_id", k: int = 20, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query, without its own id."""
    asked = queries.where(usable(vector)).select(
        F.col(id).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("size")
    )
    shards = index.select("size", "shard").groupBy("size").agg(F.collect_list("shard").alias("shards"))
    block = F.pmod(F.xxhash64("query", "v"), F.lit(1 << 20))
    sent = asked.join(shards, "size").select("size", F.explode("shards").alias("shard"), "query", "v", block.alias("block"))
    one = index.withColumns({"query": F.lit(None).cast("long"), "v": F.lit(None).cast("array<double>"), "block": F.lit(-1).cast("long")})
    both = one.unionByName(sent, allowMissingColumns=True).repartition("size", "shard").sortWithinPartitions("size", "shard", "block", "query")
    small_batches(index.sparkSession)

    def run(batches):
        graph = ids = ends = vectors = None
        ask: list = []

        def answer():
            q = np.array([v for _, v in ask])
            at, _ = graph.search(np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32), beam)
            out = ([], [], [])
            for (query, v), row in zip(ask, at):
                row = row[row >= 0]
                scores = vectors[row] @ v
                best = np.argsort(-scores, kind="stable")
                if len(best) > k + 1:  # all that equal the last one wanted: the smaller ids are chosen below
                    best = best[scores[best] >= scores[best[k]]]
                found = [(s, i) for r, s in zip(row[best], scores[best]) for i in ids[ends[r] : ends[r + 1]].tolist()]
                own = [f for f in found if f[1] == query][:1]
                if own:
                    found.remove(own[0])
                found.sort(key=lambda f: (-f[0], f[1]))
                for s, i in found[:k]:
                    out[0].append(query)
                    out[1].append(i)
                    out[2].append(s)
            ask.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["graph"] is not None:
                    if ask:
                        yield answer()
                    graph = Graph.from_bytes(row["graph"])
                    ids = np.frombuffer(row["ids"], dtype="<i8")
                    ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["id_counts"], dtype=np.int64))])
                    vectors = np.frombuffer(row["vectors"]).reshape(len(graph.vectors), -1)
                else:
                    ask.append((row["query"], np.array(row["v"])))
                    if len(ask) >= QUERY_BLOCK:
                        yield answer()
        if ask:
            yield answer()

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

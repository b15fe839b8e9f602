"""Near-duplicates by SimHash: fingerprints searched in BK-trees, linked into components.

Fingerprints of all documents have no size bound, so trees are not broadcast whole: a shard holds the
fingerprints that agree in one choice of bit blocks, and two fingerprints within the radius agree in at
least one choice (``masks``). Every shard gets a BK-tree, children keyed by their Hamming distance to
the parent, and searches follow only edges within the radius. A shard above ``SHARD_ROWS`` is cut into
several trees; its fingerprints are sent to each of them as queries, so nothing is capped.

A tree's links are reduced to stars inside the task (one row per linked fingerprint), and equal
fingerprints are one row before any of this, so large groups of copies do not multiply.

A null text is empty; texts without words have fingerprint zero and are linked like any other. Repeated
rows share a component. Null ids count as largest: a component is named by its smallest id that is not
null, and by null if it has none. An empty table gives an empty table. Columns named like the results
are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriloom.llm.components import connected
from metriloom.llm.frames import ROW_KEY, add_arrow_column, keyed, picked, small_batches, texts
from metriloom.session import written

RADIUS = 3
SHINGLE = 3
SEED = 42
#: fingerprints of one tree, and rows that a task works on together
SHARD_ROWS = 4_096
TASK_ROWS = 200_000
#: mean shard size up to which fewer, wider choices of blocks are taken
MEAN_SHARD = 64
#: (query, node) pairs that a search may have open at once
OPEN_PAIRS = 2_000_000


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Unsigned SimHash: a bit is 1 if set in over half of the shingles' hashes."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    ones, n = np.zeros(64, dtype=np.int64), 0
    last = max(1, len(words) - size + 1)
    for at in range(0, last, 100_000):
        part = words[at : min(last, at + 100_000) + size - 1]
        if len(part) <= size:
            hashes = [digest(b" ".join(part), SEED)]
        else:
            hashes = [digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(size)))]
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", out: str = "simhash") -> DataFrame:
    """Append the fingerprint of each whole text as a signed long."""

    def make(batch):
        return pa.array(np.array([fingerprint(t) for t in texts(batch.column(text))], dtype=np.uint64).view(np.int64))

    return add_arrow_column(df, out, "long", make)


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` blocks, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    out = [sum(c) for c in itertools.combinations(bits, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def block_count(rows: int, radius: int) -> int:
    """Blocks for which a shard of evenly spread fingerprints stays small; any count finds every link."""
    blocks = radius + 1
    while rows > MEAN_SHARD * 2 ** (64 * (blocks - radius) // blocks) and blocks < 2 * radius:
        blocks += 1
    return blocks


def build_trees(fp: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once: roots by shard, and edges as sorted ``node * 65 + distance`` -> child.

    ``shard`` is 0, 1, ... and the fingerprints of a shard differ. All waiting rows step down together:
    the first of those at the same node and distance becomes the child there, the rest move on to it.
    """
    _, roots = np.unique(shard, return_index=True)
    at = roots[shard]
    waiting = np.setdiff1d(np.arange(len(fp)), roots, assume_unique=True)
    keys, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(waiting):
        key = at[waiting] * 65 + np.bitwise_count(fp[waiting] ^ fp[at[waiting]])
        new, first, place = np.unique(key, return_index=True, return_inverse=True)
        keys.append(new)
        children.append(waiting[first])
        at[waiting] = waiting[first][place]
        waiting = np.delete(waiting, first)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return roots, key[order], child[order]


def search_trees(fp: np.ndarray, queries: np.ndarray, query_roots: np.ndarray, nodes_fp: np.ndarray, key: np.ndarray, child: np.ndarray, radius: int):
    """(query, node) within the radius; queries are rows of ``fp``, nodes rows of ``nodes_fp``."""
    query, node = queries, query_roots
    found = []
    while len(query):
        d = np.bitwise_count(fp[query] ^ nodes_fp[node]).astype(np.int64)
        near = d <= radius
        found.append((query[near], node[near]))
        low = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0))
        n = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), side="right") - low
        query = np.repeat(query, n)
        ends = np.cumsum(n)
        node = child[np.repeat(low - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (queries[:0], queries[:0])


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of each a and b; every set's smallest member is its root."""
    while True:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def links_in_shards(fp: np.ndarray, shard: np.ndarray, in_tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (fingerprint, first of its component in the shard) of all links of these shards."""
    member = np.flatnonzero(in_tree)
    present, dense = np.unique(shard[member], return_inverse=True)
    nodes = fp[member]
    roots, key, child = build_trees(nodes, dense)
    sizes = np.bincount(dense, minlength=len(present))
    place = np.searchsorted(present, shard)
    ok = np.flatnonzero((place < len(present)) & (present[np.minimum(place, len(present) - 1)] == shard)) if len(present) else member
    parent = np.arange(len(fp))
    work = np.cumsum(sizes[place[ok]])
    for part in np.split(ok, np.searchsorted(work, np.arange(OPEN_PAIRS, int(work[-1]) if len(work) else 0, OPEN_PAIRS))):
        q, node = search_trees(fp, part, roots[place[part]], nodes, key, child, radius)
        parent = unite(parent, q, member[node])
    moved = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[moved], fp[parent[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, blocks: int | None = None) -> DataFrame:
    """Edges ``a, b`` that connect all fingerprints (column ``fp``, no repeats) within the radius."""
    chosen = masks(radius, blocks or block_count(distinct.count(), radius))
    keyed = distinct.select(
        "fp", F.inline(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(chosen)]))
    )
    # trees of a shard: 1 unless it is large
    counts = keyed.groupBy("choice", "bits").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    trees = F.ceil(F.col("rows") / shard_rows)
    placed = keyed.join(counts.select("choice", "bits", trees.alias("trees")), ["choice", "bits"])
    own = F.pmod(F.xxhash64("fp"), F.col("trees"))
    sent = placed.withColumn("own", own).withColumn("tree", F.explode(F.sequence("own", F.col("trees") - 1)))
    rows = sent.select("choice", "bits", "tree", "fp", (F.col("own") == F.col("tree")).alias("in_tree"))
    small_batches(distinct.sparkSession)

    def run(batches):
        import pandas as pd

        def solve(frame):
            shard = pd.factorize(pd.MultiIndex.from_frame(frame[["choice", "bits", "tree"]]))[0]
            a, b = links_in_shards(frame["fp"].to_numpy().view(np.uint64), shard, frame["in_tree"].to_numpy(), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.to_pandas())
            n += len(held[-1])
            if n >= TASK_ROWS:
                frame = pd.concat(held, ignore_index=True)
                last = frame[["choice", "bits", "tree"]].eq(frame[["choice", "bits", "tree"]].iloc[-1]).all(axis=1)
                done = frame[~last]
                if len(done):
                    yield solve(done)
                held, n = [frame[last]], int(last.sum())
        if n:
            yield solve(pd.concat(held, ignore_index=True))

    shards = ["choice", "bits", "tree"]
    return rows.repartition(*shards).sortWithinPartitions(*shards).mapInArrow(run, "a long, b long")


def _tied(distinct: DataFrame, radius: int) -> DataFrame:
    """Fingerprints ``fp`` with the ``root`` of their component."""
    roots = connected(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``doc_id, simhash, component_id`` of every row; components follow links of at most ``radius`` bits."""
    marked = written(fingerprints(df.select(doc_id, text), text).select(F.col(doc_id).alias("doc_id"), "simhash"), "simhash")
    distinct = written(marked.groupBy(F.col("simhash").alias("fp")).agg(F.min("doc_id").alias("first_id")), "fingerprints")
    tied = _tied(distinct, radius)
    named = tied.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # written, so that the last join shuffles both sides anew and Spark can split a fingerprint of many copies
    names = written(tied.join(named, "root").select("fp", "component_id"), "components")
    return marked.withColumnRenamed("simhash", "fp").join(names, "fp").select("doc_id", F.col("fp").alias("simhash"), "component_id")


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row of each component, all columns as they were: that of the smallest id, null ids last, then by content."""
    rows = keyed(df, text, doc_id)
    marked = fingerprints(rows.select(*ROW_KEY, F.col("_row")[text].alias("text"))).select(*ROW_KEY, F.col("simhash").alias("fp"))
    distinct = written(marked.groupBy("fp").agg(F.min(F.struct(*ROW_KEY)).alias("least")), "fingerprints")
    chosen = _tied(distinct, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    return picked(rows, written(chosen, "survivors")).select("_row.*")

"""Trie of conversation prefixes: how many conversations share each first d turns, and what sharing saves.

A node of depth d is a distinct sequence of d turns; its members are the conversations that start with it.
Method: conversations are cut into bands of ``BAND`` turns and sorted by (band, turns before the band, turns),
dealt by range. Each task reads its sorted rows block by block into a padded matrix of dense turn ids, sorts
it (numpy ``lexsort``), marks where a column differs from the row above and ORs the marks along each row: a
mark at column j is the start of a node of that depth, and ``reduceat`` over the starts aggregates the depth.
Nodes that touch the first or last row of a block may go on in the next one; only these are aggregated again.

Sums over subtrees take a second pass: what a node adds (is it childless, what does sharing it save) is put
at its smallest member, which is a member of all its ancestors too, so a suffix sum along the row and a
``reduceat`` over the same starts give the sum of every subtree; bands further on are one number per row.

Turns are compared by 128 bits of hash of (position, MD5 of role and text). A node's key is the XOR of its
turns' hashes, so the key of a band's start needs no look at the turns before.

Bounds. A task holds one block (``BLOCK_ROWS`` rows of at most ``BAND`` turns), whatever the length of a
conversation, the number of equal conversations or of children. The digest of a node's own conversations is
read in order by one task, as SHA-256 wants it, from pieces joined before, one piece in memory at a time.

Null roles and texts are empty. Rows without a conversation id are left out. Rows of one turn number (null
first) are ordered by the MD5 of role and text. Repeated rows are turns of their own. Empty table: no nodes.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metriloom.llm.frames import small_batches, whole_text
from metriloom.llm.turns import WORD, numbered
from metriloom.session import written

BAND = 32
BLOCK_ROWS = 32_768
EMPTY = hashlib.sha256().hexdigest()

NODE = ["depth", "k1", "k2"]
SEGMENT = ["conv", "band", "k1", "k2", "path", "words", "ends"]
PARTIAL = "depth long, k1 long, k2 long, p1 long, p2 long, conv long, n long, words long, edge boolean, ends string, first_end long"
TOTAL = "depth long, k1 long, k2 long, leaves long, saved long, edge boolean"


def turns_of(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, pos, turn_md5, words`` of every row with a conversation id; ``pos`` counts from 0."""
    said = whole_text(role)
    rows = df.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv"),
        F.col(turn).alias("turn"),
        F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, whole_text(text))).alias("turn_md5"),
        F.regexp_count(whole_text(text), F.lit(WORD)).cast("bigint").alias("words"),
    )
    return numbered(rows, "conv", ["turn", "turn_md5"]).drop("turn")


def with_shared_starts(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c starts with the first h turns of conversation c - c % family, in place of its own first h.

    h is crc32 of c modulo ``most``. One more row per conversation, with a null ``turn_md5``, keeps those that
    are left without turns.
    """
    given = turns.where(F.expr(f"conv % {family} = 0 AND pos < {most - 1}"))
    first = given.groupBy(F.col("conv").alias("_base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_md5", "words"))).alias("_first"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    heads = turns.where("pos = 0").select("conv", h.alias("_h"), F.expr(f"conv - conv % {family}").alias("_base")).join(first, "_base", "left")
    none = F.array().cast("array<struct<pos:bigint,turn_md5:string,words:bigint>>")
    heads = heads.select("conv", "_h", F.slice(F.coalesce("_first", none), F.lit(1), F.col("_h")).alias("_taken"))
    own = turns.join(heads.select("conv", "_h", F.size("_taken").alias("_n")), "conv").where("pos >= _h")
    own = own.select("conv", (F.col("pos") - F.col("_h") + F.col("_n")).alias("pos"), "turn_md5", "words")
    taken = heads.select("conv", F.inline("_taken")).select("conv", "pos", "turn_md5", "words")
    marks = heads.select("conv", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("turn_md5"), F.lit(0).cast("bigint").alias("words"))
    return own.unionByName(taken).unionByName(marks)


def segments(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row per conversation and band: turn hashes and words in order, and the key of what comes before.

    ``turns``: ``conv, pos, turn_md5, words``; a null ``turn_md5`` is no turn but keeps its conversation.
    """
    t1 = F.xxhash64("turn_md5", "pos")
    t2 = F.xxhash64(F.lit("second"), "pos", "turn_md5")
    rows = turns.withColumn("band", F.expr(f"pos DIV {band}")).withColumn("t", F.when(F.col("turn_md5").isNotNull(), F.struct("pos", t1.alias("t1"), t2.alias("t2"), "words")))
    zero = F.lit(0).cast("bigint")
    bands = written(
        rows.groupBy("conv", "band").agg(
            F.sort_array(F.collect_list("t")).alias("turns"),
            F.coalesce(F.bit_xor("t.t1"), zero).alias("x1"),
            F.coalesce(F.bit_xor("t.t2"), zero).alias("x2"),
        ),
        "bands",
    )
    along = Window.partitionBy("conv").orderBy("band")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    keys = bands.select(
        "conv", "band", F.coalesce(F.bit_xor("x1").over(before), zero).alias("k1"), F.coalesce(F.bit_xor("x2").over(before), zero).alias("k2"),
        F.lead("band").over(along).isNull().alias("ends"),
    )
    path = F.flatten(F.transform("turns", lambda t: F.array(t["t1"], t["t2"])))
    return bands.join(keys, ["conv", "band"]).select("conv", "band", "k1", "k2", path.alias("path"), F.col("turns.words").alias("words"), "ends")


class Block:
    """Sorted rows of one block: ids, lengths and, per column, the rows where a node starts."""

    def __init__(self, table: pa.Table):
        get = lambda name: table.column(name).combine_chunks()
        whole = lambda name: get(name).to_numpy(zero_copy_only=False).astype(np.int64)
        self.n = n = table.num_rows
        path = get("path")
        lens = np.diff(path.offsets.to_numpy()) // 2
        flat = path.flatten().to_numpy().reshape(-1, 2)
        self.width = width = int(lens.max(initial=0))
        row = np.repeat(np.arange(n), lens)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
        by = np.lexsort((flat[:, 1], flat[:, 0]))
        dense = np.empty(len(by), dtype=np.int64)
        dense[by] = np.cumsum(np.r_[False, (flat[by][1:] != flat[by][:-1]).any(axis=1)]) if len(by) else 0
        ids = np.full((n, width), -1, dtype=np.int64)
        ids[row, at] = dense
        conv, band, k1, k2 = (whole(c) for c in ("conv", "band", "k1", "k2"))
        self.order = order = np.lexsort((conv, *ids.T[::-1], k2, k1, band))
        ids, self.conv, self.band, self.lens = ids[order], conv[order], band[order], lens[order]
        self.before = np.stack([k1[order], k2[order]])
        hashes = np.zeros((2, n, width), dtype=np.int64)
        hashes[:, row, at] = flat.T
        self.keys = self.before[:, :, None] ^ np.bitwise_xor.accumulate(hashes[:, order], axis=2)
        changed = np.ones((n, width + 1), dtype=bool)
        changed[1:, 0] = (self.band[1:] != self.band[:-1]) | (self.before[:, 1:] != self.before[:, :-1]).any(axis=0)
        changed[1:, 1:] = ids[1:] != ids[:-1]
        self.changed = np.logical_or.accumulate(changed, axis=1)
        self.place = (row, at)
        self.table = table

    def padded(self, name: str) -> np.ndarray:
        """A list column of the rows as a matrix."""
        out = np.zeros((self.n, self.width), dtype=np.int64)
        out[self.place] = self.table.column(name).combine_chunks().flatten().to_numpy()
        return out[self.order]

    def starts(self, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First rows, row counts and "is a node" of the runs of a column; column -1 is the root."""
        s = np.flatnonzero(self.changed[:, column + 1])
        counts = np.diff(np.append(s, self.n))
        return s, counts, (self.lens[s] > column) if column >= 0 else (self.band[s] == 0)

    def key(self, rows: np.ndarray, column: int) -> np.ndarray:
        return self.keys[:, rows, column] if column >= 0 else self.before[:, rows]


def _blocks(batches, rows: int):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= rows:
            table = pa.Table.from_batches(held)
            yield Block(table.slice(0, rows))
            rest = table.slice(rows)
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield Block(pa.Table.from_batches(held))


def _batch(columns: dict, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))


def _own_ends(block: Block, is_end: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
    """By last column: (first row, smallest id, joined ids) of the conversations that end at one node."""
    rows = np.flatnonzero(is_end)
    if not len(rows):
        return {}
    new = np.ones(len(rows), dtype=bool)
    # the full run of marks from one end row to the next: a node ends where any row between has changed
    marks = np.cumsum(block.changed[:, -1])
    new[1:] = marks[rows[1:]] != marks[rows[:-1]]
    found: dict[int, list[tuple[int, int, str]]] = {}
    first = np.flatnonzero(new)
    for a, b in zip(first, np.append(first[1:], len(rows))):
        r = rows[a]
        found.setdefault(int(block.lens[r]) - 1, []).append((int(r), int(block.conv[r]), ",".join(map(str, block.conv[rows[a:b]].tolist()))))
    return found


def _partials(band: int, rows: int):
    """Nodes of each block; those that touch its first or last row are marked ``edge``."""

    def run(batches):
        for block in _blocks(batches, rows):
            words = block.padded("words")
            ends = _own_ends(block, block.table.column("ends").to_numpy()[block.order])
            for j in range(-1, block.width):
                s, counts, real = block.starts(j)
                if not real.any():
                    continue
                key, above = block.key(s, j), block.key(s, j - 1) if j >= 0 else np.zeros((2, len(s)), np.int64)
                edge = (s == 0) | (s + counts == block.n)
                digest, first = [None] * len(s), [None] * len(s)
                for r, conv, text in ends.get(j, ()):
                    i = int(np.searchsorted(s, r, "right")) - 1
                    digest[i], first[i] = (text if edge[i] else hashlib.sha256(text.encode()).hexdigest()), conv
                keep = np.flatnonzero(real)
                yield _batch(
                    {
                        "depth": (block.band[s] * band + j + 1)[keep], "k1": key[0][keep], "k2": key[1][keep], "p1": above[0][keep], "p2": above[1][keep],
                        "conv": np.minimum.reduceat(block.conv, s)[keep], "n": counts[keep], "words": (words[s, j] if j >= 0 else np.zeros(len(s), np.int64))[keep],
                        "edge": edge[keep], "ends": [digest[i] for i in keep], "first_end": [first[i] for i in keep],
                    },
                    {"edge": pa.bool_(), "ends": pa.string()},
                )

    return run


def _totals(band: int, rows: int):
    """Sums over the subtrees of each block's nodes, of what stands at their member rows."""

    def run(batches):
        for block in _blocks(batches, rows):
            sums = []
            for name in ("leaf", "saved"):
                at = np.zeros((block.n, block.width + 1), dtype=np.int64)
                listed = block.table.column("places").combine_chunks()
                row = np.repeat(np.arange(block.n), np.diff(listed.offsets.to_numpy()))
                if len(row):
                    at[row, listed.flatten().to_numpy() + 1] = block.table.column(name).combine_chunks().flatten().to_numpy()
                later = block.table.column(f"later_{name}").to_numpy()
                sums.append((at[:, ::-1].cumsum(axis=1)[:, ::-1] + later[:, None])[block.order])
            for j in range(-1, block.width):
                s, counts, real = block.starts(j)
                keep = np.flatnonzero(real)
                if len(keep):
                    key = block.key(s, j)
                    leaves, saved = (np.add.reduceat(x[:, j + 1], s)[keep] for x in sums)
                    edge = ((s == 0) | (s + counts == block.n))[keep]
                    yield _batch({"depth": (block.band[s] * band + j + 1)[keep], "k1": key[0][keep], "k2": key[1][keep], "leaves": leaves, "saved": saved, "edge": edge}, {"edge": pa.bool_()})

    return run


def _digests(batches):
    """SHA-256 of the pieces of each node, read in order, one piece at a time."""
    at, digest = None, None
    for b in batches:
        for depth, k1, k2, piece in zip(*(b.column(c).to_pylist() for c in (*NODE, "ends"))):
            if at == (depth, k1, k2):
                digest.update(b",")
            else:
                if at:
                    yield _batch(dict(zip((*NODE, "sha"), ([at[0]], [at[1]], [at[2]], [digest.hexdigest()]))), {"sha": pa.string()})
                at, digest = (depth, k1, k2), hashlib.sha256()
            digest.update(piece.encode())
    if at:
        yield _batch(dict(zip((*NODE, "sha"), ([at[0]], [at[1]], [at[2]], [digest.hexdigest()]))), {"sha": pa.string()})


def _sorted(rows: DataFrame) -> DataFrame:
    key = ["band", "k1", "k2", "path", "conv"]
    return rows.repartitionByRange(*key).sortWithinPartitions(*key)


def _joined(partials: DataFrame) -> DataFrame:
    """Whole nodes: those inside a block as they are, those at an edge aggregated."""
    inside = partials.where("NOT edge").select(*NODE, "p1", "p2", "conv", "n", "words", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
    edges = partials.where("edge")
    pieces = edges.where("ends IS NOT NULL").select(*NODE, "first_end", "ends")
    sha = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first_end").mapInArrow(_digests, "depth long, k1 long, k2 long, sha string")
    whole = edges.groupBy(*NODE).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("words").alias("words"))
    return inside.unionByName(whole.join(sha, NODE, "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).drop("sha"))


def nodes(turns: DataFrame, band: int = BAND, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per node of the conversations in ``turns`` (see ``segments``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256`` and the node's 128-bit key ``k1, k2``.
    """
    small_batches(turns.sparkSession)
    rows = written(segments(turns, band), "segments")
    found = written(_joined(written(_sorted(rows).mapInArrow(_partials(band, block_rows), PARTIAL), "partials")), "nodes")
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"))
    known = written(found.join(children, NODE, "left").withColumn("children", F.coalesce("children", F.lit(0))), "counted")

    placed = known.select(
        "conv", F.expr(f"greatest(depth - 1, 0) DIV {band}").alias("band"), F.expr(f"if(depth = 0, -1, (depth - 1) % {band})").cast("bigint").alias("place"),
        (F.col("children") == 0).cast("bigint").alias("leaf"), ((F.col("n") - 1) * F.col("words")).alias("saved"),
    ).where("leaf > 0 OR saved > 0")
    own = placed.groupBy("conv", "band").agg(F.collect_list(F.struct("place", "leaf", "saved")).alias("own"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    later = Window.partitionBy("conv").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        rows.select("conv", "band").join(own, ["conv", "band"], "left")
        .select("conv", "band", "own", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("leaf", "saved")])
    )
    listed = lambda c: F.coalesce(F.col(f"own.{c}"), F.array().cast("array<bigint>"))
    marked = rows.join(sums, ["conv", "band"]).select("conv", "band", "k1", "k2", "path", listed("place").alias("places"), listed("leaf").alias("leaf"), listed("saved").alias("saved"), "later_leaf", "later_saved")
    totals = written(_sorted(marked).mapInArrow(_totals(band, block_rows), TOTAL), "totals")
    summed = totals.where("edge").groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    whole = known.join(totals.where("NOT edge").drop("edge").unionByName(summed), NODE)
    parents = known.select(F.col("depth").alias("_d"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("conv").alias("parent_conv_id"))
    up = (F.col("depth") - 1 == F.col("_d")) & (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2"))
    return whole.join(parents, up, "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256", "k1", "k2",
    )

"""Conversation structure repair: cheapest edits that give a system turn at most, then user and assistant in turn.

Lattice. A node is (rows read, state); the states are nothing yet, after system, after user, after assistant.
Keep (K) and Rerole (R) read a row and move the state on, Delete (D) reads a row, Insert (I) moves the state on;
from one node every edit leads to one node, so a path is its letters. Method: Dijkstra's search runs from the
start and, over reversed edges, from the accepting nodes at once. It goes on until no path as cheap as the best
can be open (ties of the last distance included). Every cheapest path then has a first node that the reverse
search has settled, and the forward search has settled all before it. Walking from the start by the least letter
that stays on such a path gives the least audit: no audit of a node is the beginning of another one as cheap.

Conversations of up to ``CHUNK`` rows are solved by the task that holds them. Longer ones are numbered and cut;
each chunk, in its own task, gives the cheapest cost and the order of the audits from every state to every state
(edits before a row belong to the row's chunk). The same search over the states at the borders, a few numbers a
chunk, fixes how each chunk is entered and left, and each is then solved alone. Only the digest of a long
conversation is read in order by one task, piece by piece, as SHA-256 wants it.

Rows are ordered by turn (null first); rows of one turn by role, MD5 of the text and copy number. Null roles and
texts are one space, as is a null conversation id or turn where the damage is chosen; rows without a conversation
id are one conversation. A role is known by its first character; other roles can only be reroled or deleted.
Repeated rows are duplicates. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metriloom.llm.frames import small_batches
from metriloom.llm.turns import numbered
from metriloom.session import written

CHUNK = 1_024
BLANKS = " \t\n\x0b\f\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: state after a turn of user or assistant is put in, by state
NEXT = (2, 2, 3, 2)
LEGAL = {"su", "ua", "au"}
NAMES = {2: "user", 3: "assistant"}
ORDER = ["turn", "own_role", "own_text", "copy"]
PIECE = "conv string, chunk long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string, first string, last string"


def least_path(start: int, goals: Iterable[int], after: Callable, before: Callable) -> tuple[int, list] | None:
    """Cost and letters of the cheapest path, of equal ones that of the least letters; None without a path.

    ``after(u)``: (letter, cost, v) of the edges from u, by letter; ``before(v)``: (cost, u) of the edges to v.
    """
    ends = set(goals)
    reached = ({start: 0}, dict.fromkeys(ends, 0))
    heaps = ([(0, start)], [(0, g) for g in ends])
    settled: tuple[dict[int, int], dict[int, int]] = ({}, {})
    edges = (lambda u: [(c, v) for _, c, v in after(u)], before)
    best = 0 if start in ends else None

    def step(side: int) -> None:
        nonlocal best
        d, u = heapq.heappop(heaps[side])
        if u in settled[side]:
            return
        settled[side][u] = d
        for cost, v in edges[side](u):
            if (other := reached[1 - side].get(v)) is not None and (best is None or d + cost + other < best):
                best = d + cost + other
            if v not in settled[side] and d + cost < reached[side].get(v, d + cost + 1):
                reached[side][v] = d + cost
                heapq.heappush(heaps[side], (d + cost, v))

    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        step(0 if heaps[0][0][0] <= heaps[1][0][0] else 1)
    if best is None:
        return None
    for side in (0, 1):  # ties of the last distance
        last = max(settled[side].values(), default=0)
        while heaps[side] and heaps[side][0][0] <= last:
            step(side)
    f, b = settled
    # forward nodes on a cheapest path: those with an edge to a settled reverse node, and what leads to them
    good = {u for u, d in f.items() if u not in b and any(v in b and d + c + b[v] == best for _, c, v in after(u))}
    todo = list(good)
    while todo:
        v = todo.pop()
        for c, u in before(v):
            if u in f and u not in b and u not in good and f[u] + c == f[v]:
                good.add(u)
                todo.append(u)
    letters, u = [], start
    while u not in b:
        letter, u = next((x, v) for x, c, v in after(u) if (v in b and f[u] + c + b[v] == best) or (v in good and f[u] + c == f[v]))
        letters.append(letter)
    while u not in ends or b[u] > 0:
        letter, u = next((x, v) for x, c, v in after(u) if v in b and b[u] == c + b[v])
        letters.append(letter)
    return best, letters


class Lattice:
    """Edits of consecutive rows, given their role initials and faults; node = 4 * rows read + state."""

    def __init__(self, initials: list[str], faults: list[int], last: bool):
        self.initials, self.faults, self.n, self.last = initials, faults, len(initials), last

    def moves(self, i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(letter, cost, rows read, state) of the edits at a node, by letter."""
        out = []
        if i < self.n:
            out.append(("D", DELETE, i + 1, state))
        if i < self.n or self.last:
            out.append(("I", INSERT, i, NEXT[state]))
        if i < self.n and self.faults[i] not in (BLANK, DUPLICATE):
            more = CUT_SHORT if self.faults[i] == TRUNCATED else 0
            first = self.initials[i]
            if first == "s" and state == 0:
                out.append(("K", KEEP + more, i + 1, 1))
            elif first == "ua"[NEXT[state] - 2]:
                out.append(("K", KEEP + more, i + 1, NEXT[state]))
            out.append(("R", REROLE + more, i + 1, NEXT[state]))
        return out

    def after(self, u: int) -> list[tuple[str, int, int]]:
        return [(x, c, 4 * i + s) for x, c, i, s in self.moves(u // 4, u % 4)]

    def before(self, v: int) -> list[tuple[int, int]]:
        i, state = divmod(v, 4)
        near = [4 * j + s for j in (i - 1, i) if j >= 0 for s in range(4)]
        return [(c, u) for u in near for _, c, w in self.after(u) if w == v]

    def solve(self, entry: int, leave: int | None) -> tuple[int, str] | None:
        """Cost and audit from state ``entry`` to state ``leave`` (None: to an accepting end)."""
        goals = [4 * self.n + leave] if leave is not None else [4 * self.n, 4 * self.n + 3]
        found = least_path(entry, goals, self.after, self.before)
        return found and (found[0], "".join(found[1]))


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows after damage chosen by crc32 of ``conv_id:turn``: ``conv, turn, role, text, fault, ...`` (``ORDER``)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    rows = df.select(space(conv_id).alias("conv"), F.col(turn).alias("turn"), space(role).alias("own_role"), space(text).alias("_text"), kind.alias("_kind"))
    said = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    rows = rows.where("_kind <> 0").select(
        "conv", "turn", "own_role", F.md5("_text").alias("own_text"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("own_role")).alias("role"), said.alias("text"),
    )
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    return rows.withColumn("fault", fault)


def _groups(batches, columns: tuple[str, ...]):
    """Consecutive rows of one (conv, chunk), as a dict of lists."""
    key, held = None, None
    for b in batches:
        lists = [b.column(c).to_pylist() for c in columns]
        a, n = 0, b.num_rows
        while a < n:
            here = (lists[0][a], lists[1][a])
            e = a + 1
            while e < n and (lists[0][e], lists[1][e]) == here:
                e += 1
            if here != key:
                if key is not None:
                    yield key, held
                key, held = here, {c: [] for c in columns}
            for c, values in zip(columns, lists):
                held[c].extend(values[a:e])
            a = e
    if key is not None:
        yield key, held


def _repaired(lattice: Lattice, roles: list[str], texts: list[str], entry: int, audit: str) -> str:
    lines, i, state = [], 0, entry
    for letter in audit:
        _, _, after, to = next(m for m in lattice.moves(i, state) if m[0] == letter)
        if letter != "D":
            lines.append(f"{roles[i] if letter == 'K' else NAMES[to]}:{texts[i] if letter != 'I' else ''}")
        i, state = after, to
    return "\n".join(lines)


def _pieces(batches):
    """Faults, audit and repaired text of each chunk; ``seen`` is null where the chunk is a whole conversation."""
    columns = ("conv", "chunk", "role", "text", "fault", "seen", "entry", "leave")
    rows: list[tuple] = []
    size = 0

    def batch():
        names = [c.split()[0] for c in PIECE.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in PIECE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    for (conv, chunk), g in _groups(batches, columns):
        seen, faults = set(), []
        for role, text, fault, known in zip(g["role"], g["text"], g["fault"], g["seen"]):
            if known is None:
                digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
                known = digest in seen
                seen.add(digest)
            faults.append(DUPLICATE if known and fault != BLANK else fault)
        initials = [r[:1] for r in g["role"]]
        lattice = Lattice(initials, faults, g["leave"][0] is None)
        cost, audit = lattice.solve(g["entry"][0], g["leave"][0])
        text = _repaired(lattice, g["role"], g["text"], g["entry"][0], audit)
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        rows.append((conv, chunk, *(faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, text, initials[0], initials[-1]))
        size += len(text)
        if len(rows) >= 2_000 or size >= 8 << 20:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _crossings(chunk_rows: int):
    """Per chunk of a long conversation: costs and audit ranks from each state to each (-1: none)."""

    def run(batches):
        for (conv, chunk), g in _groups(batches, ("conv", "chunk", "initial", "fault", "rows")):
            final = (chunk + 1) * chunk_rows >= g["rows"][0]
            lattice = Lattice(g["initial"], g["fault"], final)
            costs, ranks = [], []
            for entry in range(4):
                found = [lattice.solve(entry, leave) for leave in ((None,) if final else range(4))]
                order = sorted({x[1] for x in found if x})
                costs += [x[0] if x else -1 for x in found]
                ranks += [order.index(x[1]) if x else -1 for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([chunk]), pa.array([costs], pa.list_(pa.int64())), pa.array([ranks], pa.list_(pa.int64()))], names=["conv", "chunk", "costs", "ranks"])

    return run


def _borders(batches):
    """How each chunk of a long conversation is entered and left on its cheapest path of least audit."""
    for conv, chunks in _by_conv(batches):
        m = len(chunks)

        def after(u):
            j, s = divmod(u, 4)
            if j >= m:
                return []
            costs, ranks = chunks[j]
            wide = len(costs) // 4
            return sorted((ranks[s * wide + t], costs[s * wide + t], 4 * (j + 1) + t) for t in range(wide) if costs[s * wide + t] >= 0)

        def before(v):
            j = v // 4
            return [(c, u) for u in range(4 * (j - 1), 4 * j) for _, c, w in after(u) if w == v] if j else []

        _, ranks = least_path(0, [4 * m], after, before)
        u, states = 0, [0]
        for rank in ranks:
            u = next(v for r, _, v in after(u) if r == rank)
            states.append(u % 4)
        leave = [*states[1:-1], None]
        yield pa.RecordBatch.from_arrays([pa.array([conv] * m), pa.array(list(range(m)), pa.int64()), pa.array(states[:-1], pa.int64()), pa.array(leave, pa.int64())], names=["conv", "chunk", "entry", "leave"])


def _by_conv(batches):
    at, held = None, []
    for b in batches:
        for conv, costs, ranks in zip(b.column("conv").to_pylist(), b.column("costs").to_pylist(), b.column("ranks").to_pylist()):
            if conv != at:
                if held:
                    yield at, held
                at, held = conv, []
            held.append((costs, ranks))
    if held:
        yield at, held


def _endings(batches):
    """Audit, digest and the illegal pairs at chunk borders of each long conversation, from its pieces in order."""
    names = ["conv", "audit", "sha", "border"]

    def batch(conv, audit, digest, border):
        return pa.RecordBatch.from_arrays([pa.array([conv]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()]), pa.array([border], pa.int64())], names=names)

    at = None
    for b in batches:
        for conv, piece, text, first, last in zip(*(b.column(c).to_pylist() for c in ("conv", "audit", "repaired", "first", "last"))):
            if conv != at:
                if at is not None:
                    yield batch(at, audit, digest, border)
                at, audit, digest, border, before, any_line = conv, [], hashlib.sha256(), 0, None, False
            if before is not None and before + first not in LEGAL:
                border += 1
            if text:
                digest.update(("\n" if any_line else "").encode() + text.encode())
                any_line = True
            audit.append(piece)
            before = last
    if at is not None:
        yield batch(at, audit, digest, border)


def pieces(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Repair of damaged rows (``damaged``): one row per conversation, or per ``chunk`` rows of a longer one (``PIECE``)."""
    small_batches(rows.sparkSession)
    sizes = rows.groupBy("conv").agg(F.count("*").alias("rows")).where(F.col("rows") > chunk)
    long = written(sizes, "long")
    none = F.lit(None).cast("bigint")
    short = rows.join(long, "conv", "left_anti").select("conv", F.lit(0).cast("bigint").alias("chunk"), *ORDER, "role", "text", F.col("fault").cast("bigint").alias("fault"))
    short = short.withColumns({"seen": F.lit(None).cast("boolean"), "entry": F.lit(0).cast("bigint"), "leave": none})
    whole = short.repartition("conv").sortWithinPartitions("conv", *ORDER).select("conv", "chunk", "role", "text", "fault", "seen", "entry", "leave").mapInArrow(_pieces, PIECE)
    if long.isEmpty():
        return whole

    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    placed = numbered(rows.join(long, "conv").withColumn("_said", digest), "conv", ORDER).withColumn("chunk", F.expr(f"pos DIV {chunk}"))
    first = placed.groupBy("conv", "_said").agg(F.min("pos").alias("_first"))
    marked = placed.join(first, ["conv", "_said"]).withColumn("seen", F.col("_first") < F.col("pos"))
    marked = written(marked.select("conv", "chunk", "pos", "rows", "role", "text", F.col("fault").cast("bigint").alias("fault"), "seen"), "numbered")
    slim = marked.select(
        "conv", "chunk", "pos", "rows", F.substring("role", 1, 1).alias("initial"),
        F.when(F.col("seen") & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault")).cast("bigint").alias("fault"),
    )
    crossed = slim.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos").mapInArrow(_crossings(chunk), "conv string, chunk long, costs array<long>, ranks array<long>")
    borders = crossed.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_borders, "conv string, chunk long, entry long, leave long")
    parts = marked.join(written(borders, "borders"), ["conv", "chunk"]).repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos")
    return whole.unionByName(parts.select("conv", "chunk", "role", "text", "fault", "seen", "entry", "leave").mapInArrow(_pieces, PIECE))


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per original conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    rows = damaged(df, conv_id, turn, role, text)
    wide = "CAST(max(turn) AS DECIMAL(38, 0)) - min(turn) + 1 - count(DISTINCT turn)"
    gaps = rows.groupBy("conv").agg(F.expr(f"try_cast(coalesce({wide}, 0) AS BIGINT)").alias("gaps"))
    found = written(pieces(rows, chunk), "pieces")
    parts = found.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.count("*").alias("_parts"), F.min("audit").alias("_audit"), F.min(F.sha2("repaired", 256)).alias("_sha"),
    )
    cut = found.select("conv").where("chunk > 0").distinct()
    ends = found.join(cut, "conv", "left_semi").repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_endings, "conv string, audit string, sha string, border long")
    all_ids = df.select(F.col(conv_id).alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return all_ids.join(gaps, "conv", "left").join(parts, "conv", "left").join(ends, "conv", "left").select(
        "conv_id", zero("gaps").alias("gaps"), *[zero(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (zero("illegal") + zero("border")).alias("illegal"), zero("cost").alias("cost"),
        F.coalesce("audit", "_audit", F.lit("")).alias("audit"), F.coalesce("sha", "_sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )

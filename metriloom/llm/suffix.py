"""Repeated passages: every byte covered by a string of ``length`` bytes that starts somewhere else too.

1. Every window of ``length`` bytes names an anchor, its k-gram of least hash (the leftmost of equals),
   which depends on the window alone; neighbouring windows with the same anchor form one segment. A
   document thus has about ``2 / (length - k)`` segments per byte, found with sliding minima in numpy.
2. Equal windows have equal anchors. Anchors that occur once are done. Segments that are equal as a whole
   are counted by digest, so copies of a document never travel as text; one representative of each
   different segment goes on.
3. The representatives of an anchor meet in one shard. A shard's suffix array is built by
   Larsson-Sadakane refinement to the depth of ``length``; Kasai's walk, in step over all segments, gives
   the common prefixes, and windows whose common prefix reaches ``length`` repeat.
   One suffix array holds at most about twice ``SHARD_BYTES``: a larger shard gets several, one after the
   other, and their classes of windows are matched by digest.
4. An anchor with more than ``SPLIT_SEGMENTS`` different segments is cut into several shards. These also
   give the sorted digests of their windows, which are merged by binary search.
5. The runs of repeated windows are joined to the documents, whose text is shuffled once for steps 3
   and 5 together.

Matches never cross documents. A null text is empty; texts shorter than ``length`` keep every byte;
equal rows repeat each other; an empty table gives an empty table. Columns named like the results or
like the helpers (``HELPERS``) are replaced.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metriloom.llm.frames import forget_kept, small_batches, whole_text
from metriloom.session import written

LENGTH = 400
GRAM = 128  # a power of two
#: bytes of a text that are hashed at once
TEXT_BLOCK = 4 << 20
#: bytes of a suffix array, and different segments of an anchor that one shard holds
SHARD_BYTES = 1 << 20
SPLIT_SEGMENTS = 20_000
HELPERS = ("n_bytes", "n_removed", "n_spans", "kept", "_k1", "_k2", "_runs", "_pieces")
MULTIPLIERS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(1, 40)]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of every ``gram`` bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    size, level = 1, 0
    while size < gram:
        h = h[:-size] * np.uint64(MULTIPLIERS[level]) + h[size:]
        size, level = 2 * size, level + 1
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor, first start, last start) arrays: windows of ``data`` grouped by their anchor."""
    anchors, firsts, lasts = [], [], []
    width = length - gram + 1
    for base in range(0, len(data) - length + 1, TEXT_BLOCK):
        block = data[base : base + TEXT_BLOCK + length - 1]
        h = gram_hashes(block, gram)
        packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)  # hash, then place
        pad = -len(h) % width
        rows = np.concatenate([packed, np.full(pad, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, width)
        upto = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(block) - length + 1
        at = (np.minimum(after[:n], upto[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        anchors.append(h[at[first]].view(np.int64))
        firsts.append(first + base)
        lasts.append(np.concatenate([first[1:] - 1, [n - 1]]) + base)
    if not anchors:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(anchors), np.concatenate(firsts), np.concatenate(lasts)


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``data`` in the order of their next ``depth`` bytes at least (Larsson-Sadakane).

    Positions start in groups of equal 8-byte words. A group's number is the place of its first member;
    refinement sorts the members of groups that are not single yet by the group number h bytes on.
    """
    n = len(data)
    place = np.int32 if n + 2 * depth < 1 << 31 else np.int64
    words = byte_words(data)
    order = np.argsort(words, kind="stable").astype(place)
    words = words[order]
    new = np.ones(n, dtype=bool)
    np.not_equal(words[1:], words[:-1], out=new[1:])
    del words
    start = np.arange(n, dtype=place)
    start[~new] = 0
    group = np.full(n + 1, -1, dtype=place)
    group[order] = np.maximum.accumulate(start, out=start)
    del start
    open_places = _not_single(new).astype(place)
    h = 8
    while h < depth and len(open_places):
        at = order[open_places]
        key = group[at].astype(np.int64)
        key *= n + 1
        key += group[np.minimum(at + place(h), place(n))]
        by = np.argsort(key, kind="stable").astype(place)
        at, key = at[by], key[by]
        del by
        order[open_places] = at
        new = np.ones(len(key), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        del key
        first = np.arange(len(at), dtype=place)
        first[~new] = 0
        group[at] = open_places[np.maximum.accumulate(first, out=first)]
        open_places = open_places[_not_single(new)]
        h *= 2
    return order


def _not_single(new: np.ndarray) -> np.ndarray:
    """Places in groups of several; ``new`` marks the first member of each group."""
    several = ~new
    several[:-1] |= several[1:]
    return np.flatnonzero(several)


def byte_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on as one big-endian word; zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view(np.uint64).ravel()
    return words if sys.byteorder == "big" else words.byteswap(inplace=True)


def common_prefixes(data: np.ndarray, order: np.ndarray, firsts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Common prefix, up to ``length``, of every start with the start before it in the suffix array.

    Kasai: the next position shares at least one byte less with its predecessor than this one with its
    own, if what follows this predecessor is a start before the next position in the array too (ends of
    segments, and ties beyond the sorted depth, break that; the walk then begins anew). Segments
    (``counts`` starts from ``firsts`` on) take each step together.
    """
    words = byte_words(data)
    place = np.full(len(data) + 1, len(data), dtype=order.dtype)  # behind all others where no start is
    place[order] = np.arange(len(order))
    before = np.full(len(data), -1, dtype=order.dtype)
    before[order[1:]] = order[:-1]
    out = np.zeros(len(data), dtype=np.int32)
    longest = np.argsort(-counts, kind="stable")
    firsts, counts = firsts[longest], counts[longest]
    shared = np.zeros(len(firsts), dtype=np.int64)
    for step in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -step, side="left"))  # segments with more than ``step`` starts
        at = firsts[:live] + step
        other = before[at]
        if step:
            kept = (before[at - 1] >= 0) & (place[before[at - 1] + 1] < place[at])
            shared = np.where(kept, np.maximum(shared[:live] - 1, 0), 0)
        shared[other < 0] = 0
        go = np.flatnonzero(other >= 0)
        while len(go):
            a, b = at[go] + shared[go], other[go] + shared[go]
            differ = words[a] ^ words[b]
            same = differ == 0
            top = np.where(same, 8, (64 - _bit_length(differ)) // 8)
            shared[go] += top
            go = go[same & (shared[go] < length)]
        shared = np.minimum(shared, length)
        out[at] = shared
    return out


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of each word; only its whole leading zero bytes matter."""
    n = np.zeros(len(x), dtype=np.int64)
    for shift in (32, 16, 8):
        high = (x >> np.uint64(shift)) != 0
        n += np.where(high, shift, 0)
        x = np.where(high, x >> np.uint64(shift), x)
    return n + 8 * (x != 0)


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start of each segment, one after the other: segment, start in it, class of equal windows.

    Windows are equal if and only if their classes are.
    """
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    firsts = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    segment = np.repeat(np.arange(len(pieces)), counts)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    is_start = np.zeros(len(data), dtype=bool)
    is_start[firsts[segment] + inside] = True
    order = suffix_array(data, length)
    order = order[is_start[order]]
    shared = common_prefixes(data, order, firsts, counts, length)
    names = np.full(len(data), -1, dtype=order.dtype)
    names[order] = np.cumsum(shared[order] < length)
    return segment, inside, names[firsts[segment] + inside]


def window_digests(pieces: list[bytes], segment: np.ndarray, inside: np.ndarray, length: int) -> list[bytes]:
    """A digest of 16 bytes of each window, by its segment and start in it."""
    return [hashlib.blake2b(pieces[s][i : i + length], digest_size=16).digest() for s, i in zip(segment.tolist(), inside.tolist())]


def window_classes(pieces: list[bytes], length: int = LENGTH, most: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``repeated_starts`` with bounded memory: beyond twice ``most`` bytes, suffix arrays of about ``most`` bytes each.

    Each array names the different windows of its segments; classes of several arrays are one if the
    digests of their first windows are equal.
    """
    upto = np.cumsum([len(p) for p in pieces], dtype=np.int64)
    if upto[-1] <= 2 * most:
        return repeated_starts(pieces, length)
    part = (upto - 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(pieces)]
    parts, marks, named = [], [], 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        segment, inside, names = repeated_starts(pieces[a:b], length)
        _, first, names = np.unique(names, return_index=True, return_inverse=True)
        found = window_digests(pieces[a:b], segment[first], inside[first], length)
        marks.append(np.frombuffer(b"".join(found), dtype="<u8").reshape(-1, 2))
        parts.append(((segment + a).astype(np.int32), inside.astype(np.int32), (names + named).astype(np.int32)))
        named += len(first)
    marks = np.concatenate(marks)
    order = np.lexsort((marks[:, 1], marks[:, 0]))
    marks = marks[order]
    new = np.concatenate([[True], (marks[1:] != marks[:-1]).any(axis=1)])
    classes = np.empty(named, dtype=np.int32)
    classes[order] = np.cumsum(new)
    segment, inside, names = (np.concatenate(c) for c in zip(*parts))
    return segment, inside, classes[names]


def _runs(segment: np.ndarray, inside: np.ndarray):
    """Ends of runs of neighbouring starts: (segment, first, last)."""
    cut = np.flatnonzero((segment[1:] != segment[:-1]) | (inside[1:] != inside[:-1] + 1)) + 1
    first = np.concatenate([[0], cut]) if len(segment) else cut
    last = np.concatenate([cut - 1, [len(segment) - 1]]) if len(segment) else cut
    return segment[first], inside[first], inside[last]


def keyed(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """All columns with the row's key; rows of equal keys have equal texts."""
    return df.withColumns({"_k1": F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), "_k2": F.xxhash64(whole_text(text))})


def anchored(docs: DataFrame, text: str, length: int) -> DataFrame:
    """One row per segment: anchor, digest of its bytes, row key, first and last start."""

    def run(batches):
        import xxhash

        forget_kept()
        for batch in batches:
            rows = []
            for k1, k2, t in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()):
                data = (t or "").encode()
                if len(data) < length:
                    continue
                anchor, first, last = segments(np.frombuffer(data, dtype=np.uint8), length)
                digest = xxhash.xxh3_64_digest
                marks = b"".join([digest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())])
                rows.append((anchor, np.frombuffer(marks, dtype="<i8"), np.full(len(anchor), k1), np.full(len(anchor), k2), first, last))
            if rows:
                columns = [np.concatenate(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(np.int64)) for c in columns[:4]] + [pa.array(c.astype(np.int32)) for c in columns[4:]],
                    names=["anchor", "mark", "_k1", "_k2", "first", "last"],
                )

    return docs.select("_k1", "_k2", text).mapInArrow(run, "anchor long, mark long, _k1 long, _k2 long, first int, last int")


def repeated_runs(docs: DataFrame, shuffled: DataFrame, text: str, length: int, split: int) -> DataFrame:
    """``_k1, _k2, first, last``: runs of repeated window starts. ``shuffled`` are the rows of ``docs`` by key."""
    found = written(anchored(docs, text, length), "anchors")
    # written, so that the join shuffles anew and Spark can split the rows of a frequent anchor
    twice = found.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("mark") != F.max("mark")).alias("mixed")).where("n > 1")
    twice = written(twice, "twice")
    shared = written(found.join(twice.select("anchor", "mixed"), "anchor"), "shared")
    equal = shared.where("not mixed")
    mixed = shared.where("mixed")
    kinds = mixed.groupBy("anchor", "mark").agg(F.count("*").alias("n"), F.min(F.struct("_k1", "_k2", "first", "last")).alias("one"))
    kinds = written(kinds, "kinds")
    copies = mixed.join(kinds.where("n > 1").select("anchor", "mark"), ["anchor", "mark"], "left_semi")
    hot = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > split), "hot")
    single = kinds.join(hot.select("anchor", F.ceil(F.col("kinds") / split).alias("shards")), "anchor", "left").select(
        "one._k1", "one._k2", F.struct("anchor", F.coalesce("shards", F.lit(1).cast("long")).alias("shards"), (F.col("n") > 1).alias("known"), "one.first", "one.last").alias("piece")
    )
    wanted = single.groupBy("_k1", "_k2").agg(F.collect_list("piece").alias("_pieces"))
    texts = shuffled.join(wanted, ["_k1", "_k2"])
    shards = _cut(texts, text, length).repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    solved = written(_solve(shards, length), "solved")
    merged = _merge(solved.where("kind > 0"))
    columns = ["_k1", "_k2", "first", "last"]
    return equal.select(columns).unionByName(copies.select(columns)).unionByName(solved.where("kind = 0").select(columns)).unionByName(merged)


def _cut(texts: DataFrame, text: str, length: int) -> DataFrame:
    """The bytes of the wanted segments."""
    names = ["anchor", "shard", "shards", "known", "_k1", "_k2", "first", "piece"]

    def run(batches):
        for batch in batches:
            k1, k2, text_column, pieces = (batch.column(batch.schema.get_field_index(c)) for c in ("_k1", "_k2", text, "_pieces"))
            for a, b, t, wanted in zip(k1.to_pylist(), k2.to_pylist(), text_column, pieces):
                data = (t.as_py() or "").encode()
                out = [
                    (p["anchor"], (a ^ p["first"]) % p["shards"], p["shards"], p["known"], a, b, p["first"], data[p["first"] : p["last"] + length])
                    for p in wanted.as_py()
                ]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)

    return texts.mapInArrow(run, "anchor long, shard long, shards long, known boolean, _k1 long, _k2 long, first int, piece binary")


def _solve(shards: DataFrame, length: int) -> DataFrame:
    """kind 0: runs of repeated starts; of anchors in several shards also, per different window, its digest.

    kind 1 is a window that is single in its shard, kind 2 one that is not.
    """

    def run(batches):
        import pandas as pd

        forget_kept()

        def solve(frame):
            pieces = frame["piece"].tolist()
            segment, inside, names = window_classes(pieces, length, SHARD_BYTES)
            _, place, n = np.unique(names, return_inverse=True, return_counts=True)
            many = n[place] > 1
            known = frame["known"].to_numpy()
            k1, k2, first = (frame[c].to_numpy() for c in ("_k1", "_k2", "first"))
            new = many & ~known[segment]
            s, a, b = _runs(segment[new], inside[new])
            parts = [(np.zeros(len(s), np.int32), k1[s], k2[s], first[s] + a, first[s] + b, [None] * len(s))]
            several = (frame["shards"].to_numpy() > 1)[segment]
            if several.any():
                at = np.flatnonzero(several)
                at = at[np.unique(names[at], return_index=True)[1]]
                s, i = segment[at], inside[at]
                marks = window_digests(pieces, s, i, length)
                fixed = many[at] | known[s]
                parts.append((np.where(fixed, 2, 1).astype(np.int32), k1[s], k2[s], first[s] + i, first[s] + i, marks))
            for kind, x, y, p, q, marks in parts:
                if len(kind):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kind), pa.array(x), pa.array(y), pa.array(p.astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(marks, type=pa.binary())],
                        names=["kind", "_k1", "_k2", "first", "last", "digest"],
                    )

        held, size = [], 0
        for batch in batches:
            frame = batch.to_pandas()
            sizes = frame["piece"].str.len().cumsum().to_numpy()
            change = np.flatnonzero((frame["anchor"].to_numpy()[1:] != frame["anchor"].to_numpy()[:-1]) | (frame["shard"].to_numpy()[1:] != frame["shard"].to_numpy()[:-1])) + 1
            if held and len(frame):
                last = held[-1].iloc[-1]
                if (last["anchor"], last["shard"]) != (frame["anchor"].iloc[0], frame["shard"].iloc[0]):
                    change = np.concatenate([[0], change])
            start = 0
            for c in change:
                if size + (sizes[c - 1] if c else 0) - (sizes[start - 1] if start else 0) >= SHARD_BYTES:
                    held.append(frame.iloc[start:c])
                    yield from solve(pd.concat(held, ignore_index=True))
                    held, size, start = [], 0, c
            if start < len(frame):
                held.append(frame.iloc[start:])
                size += sizes[-1] - (sizes[start - 1] if start else 0)
        if held:
            yield from solve(pd.concat(held, ignore_index=True))

    return shards.mapInArrow(run, "kind int, _k1 long, _k2 long, first int, last int, digest binary")


def _merge(windows: DataFrame) -> DataFrame:
    """Single windows that another shard of their anchor holds too, by binary search in the sorted digests."""

    def run(batches):
        import pandas as pd

        def merge(frame):
            marks = np.array(frame["digest"].tolist(), dtype="S16")  # compares without trailing zeros, so a byte is put behind
            n = np.searchsorted(marks, marks, side="right") - np.searchsorted(marks, marks, side="left")
            hit = (n > 1) & (frame["kind"].to_numpy() == 1)
            return pa.RecordBatch.from_pandas(frame.loc[hit, ["_k1", "_k2", "first", "last"]], preserve_index=False)

        held = None
        for batch in batches:
            frame = batch.to_pandas()
            frame["digest"] = [d[:15] + b"\x01" if d[15] == 0 else d for d in frame["digest"]]
            frame = pd.concat([held, frame], ignore_index=True) if held is not None else frame
            if not len(frame):
                continue
            last = frame["digest"] == frame["digest"].iloc[-1]
            yield merge(frame[~last])
            held = frame[last]
        if held is not None and len(held):
            yield merge(held)

    ordered = windows.repartition("digest").sortWithinPartitions("digest")
    return ordered.mapInArrow(run, "_k1 long, _k2 long, first int, last int")


def cut_runs(data: bytes, runs: list, length: int, whole_characters: bool = False) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the windows of ``runs``, bytes removed, and maximal removed runs."""
    spans: list[list[int]] = []
    for first, last in sorted(runs):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    kept, at, removed, n = [], 0, 0, 0
    for a, b in spans:
        if whole_characters:  # bytes 10xxxxxx go on with a character
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            if a == b:
                continue
        kept.append(data[at:a])
        at = b
        removed += b - a
        n += 1
    kept.append(data[at:])
    return b"".join(kept), removed, n


def remove_repeats(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, split: int = SPLIT_SEGMENTS, whole_characters: bool = False
) -> DataFrame:
    """All columns, and ``n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every row.

    ``whole_characters`` leaves a character in place unless all its bytes repeat, so ``kept`` is UTF-8.
    """
    small_batches(df.sparkSession)
    base = df.drop(*HELPERS)
    docs = keyed(base, text, doc_id)
    shuffled = docs.repartition("_k1", "_k2")
    runs = repeated_runs(docs, shuffled, text, length, split)
    by_row = runs.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))
    joined = shuffled.join(by_row, ["_k1", "_k2"], "left")
    names = base.columns

    def run(batches):
        for batch in batches:
            at = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            bytes_, removed, spans, kept = [], [], [], []
            for t, found in zip(at[text].to_pylist(), at["_runs"].to_pylist()):
                data = (t or "").encode()
                left, n, k = cut_runs(data, [(r["first"], r["last"]) for r in found or ()], length, whole_characters)
                bytes_.append(len(data))
                removed.append(n)
                spans.append(k)
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [*(at[c] for c in names), *(pa.array(c, type=pa.int64()) for c in (bytes_, removed, spans)), pa.array(kept, type=pa.binary())],
                names=[*names, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    added = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary")
    return joined.mapInArrow(run, StructType([*base.schema.fields, *added.fields]))

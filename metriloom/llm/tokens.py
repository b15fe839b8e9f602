"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A text is first cut into the matches of the vocabulary's pattern. In each match every live position
holds the rank of the pair that starts there; the segment tree keeps the leftmost minimum at its root,
so a merge costs two or three point updates of logarithmic depth and a match of any length is encoded
in n log n.

Words repeat, so a worker keeps the ids of the chunks it has seen, for all its tasks (at most twice
``CACHE_CHUNKS``: when full, the older half goes). A chunk is a run of white space with the run of other characters behind it: no match of the pattern
crosses from a character into white space, and its look-ahead sees no further than the chunk.

Null texts are empty, an empty text has no ids, rows are kept one for one (repeated rows too), an empty
table gives an empty table, and an input column with the name of the output is replaced.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metriloom.llm.frames import add_arrow_column, kept_by_worker, texts

#: Unicode white space, as \\s of the pattern means it
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{SPACE}]+[^{SPACE}]*|[^{SPACE}]+")
#: chunks a worker remembers; longer ones than CACHE_CHARS are encoded each time
CACHE_CHUNKS = 400_000
CACHE_CHARS = 64
NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file (base64 and decimal id on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_match(word: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one match of the pattern.

    Leaf i of the tree holds ``rank * size + i`` of the pair starting at i, so that the minimum at the
    root names the lowest rank and, among equal ranks, the leftmost position.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2], -1)
        if rank >= 0:
            tree[size + i] = rank * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # next live position, which is also the end of the piece
    before = list(range(-1, n - 1))
    get = ranks.get
    while (at := tree[1]) != NONE:
        at %= size
        gone = after[at]
        after[at] = end = after[gone]
        tree[gone + size] = NONE
        rank = None
        if end < n:
            before[end] = at
            if after[end] - at <= longest:
                rank = get(word[at : after[end]])
        tree[at + size] = NONE if rank is None else rank * size + at
        left = before[at]
        if left >= 0:
            rank = get(word[left:end]) if end - left <= longest else None
            tree[left + size] = NONE if rank is None else rank * size + left
        # the three leaves are near each other, so their ways to the root soon join
        i, j, k = (gone + size) >> 1, (at + size) >> 1, (max(left, 0) + size) >> 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
            if j != i:
                a, b = tree[2 * j], tree[2 * j + 1]
                tree[j] = a if a < b else b
            if k != j:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
            i, j, k = i >> 1, j >> 1, k >> 1
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : after[at]]])
        at = after[at]
    return ids


class ChunkCache(dict):
    """Chunk -> its ids as little-endian 32-bit bytes, filled by ``encode`` on first sight."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            out = id_bytes(self.encode(chunk))
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


def id_bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def chunk_encoder(ranks: dict[bytes, int], pattern: str) -> ChunkCache:
    import regex

    find, longest = regex.compile(pattern).findall, max(map(len, ranks))

    def encode(chunk: str) -> list[int]:
        return [i for word in find(chunk) for i in encode_match(word.encode(), ranks, longest)]

    return ChunkCache(encode)


def id_lists(parts: list[bytes]) -> pa.Array:
    """One list of ids per element."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int64)
    values = pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the token ids of every whole text. The vocabulary (below 1 MB) is read by the driver."""
    ranks = read_ranks(ranks_path)
    key = f"tree {ranks_path} {pattern}"

    def make(batch):
        cache = kept_by_worker(key, lambda: chunk_encoder(ranks, pattern))
        return id_lists([cache.ids(t) for t in texts(batch.column(text))])

    return add_arrow_column(df, ids, "array<int>", make)


def decode_flat(ids: np.ndarray, table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids in a row, and the length of each id's bytes."""
    n = lengths[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.repeat(starts[ids] - (ends - n), n) + np.arange(total)], n


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the bytes that a list of ids stands for; a null list gives empty bytes."""
    ranks = read_ranks(ranks_path)

    def make(batch):
        words = [b""] * (max(ranks.values()) + 1)
        for word, i in ranks.items():
            words[i] = word
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        table = np.frombuffer(b"".join(words), dtype=np.uint8)
        column = batch.column(ids)
        counts = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
        data, n = decode_flat(np.asarray(column.flatten(), dtype=np.int64), table, starts, lengths)
        upto = np.concatenate([[0], np.cumsum(n)])
        ends = upto[np.concatenate([[0], np.cumsum(counts)])]
        return pa.Array.from_buffers(
            pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
        )

    return add_arrow_column(df, out, "binary", make)

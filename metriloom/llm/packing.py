"""Packing documents into training sequences by order-preserving dynamic programming.

The token stream keeps the order of the table. Window cuts may fall at document ends (free), at
sentence ends (``SENTENCE_PENALTY``) and, only inside stretches without either, between tokens
(``TOKEN_PENALTY``). With ``f`` the least cost up to a cut,

    f(j) = penalty(j) + min( min over cuts i within the window of f(i) + window - (p_j - p_i),
                             min over powers of two w of f(cut at p_j - w) )

where p is the position of a cut in tokens. The first minimum is that of ``f(i) + p_i`` over a sliding
window, kept in a monotone queue; the second holds because a sequence whose length is a power of two
needs no padding. So each cut costs constant time.

Every partition is packed on its own, in blocks of whole documents with about ``BLOCK_TOKENS`` tokens,
so memory is bounded by a block and the longest document; nothing is shuffled. A retried task reads
the same rows and gives the same sequence numbers.

Null texts are empty and give only the end token; an empty table gives no pieces; repeated rows are
packed as often as they come. Only ``doc_id`` and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from metriloom.llm.frames import kept_by_worker, small_batches, texts
from metriloom.llm.tokens import ChunkCache, id_bytes

WINDOW = 1024
#: the pattern of a byte-level pre-tokenizer
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SENTENCE_PENALTY = 4
TOKEN_PENALTY = 32
#: stretches without a boundary that are longer than this get cuts every that many tokens
FREE_RUN = 64
BLOCK_TOKENS = 1 << 20

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_cuts(positions: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """Cut positions of the cheapest packing of the stream [0, positions[-1]).

    ``positions`` are the allowed cuts in increasing order, at most ``window`` apart, without 0 and with
    the end. Of equal costs the earliest cut wins.
    """
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    cost_at = {0: 0}
    came_from = {}
    queue = deque([(0, 0)])  # (f(i) + p_i, p_i), increasing in both
    for at, penalty in zip(positions, penalties):
        low = at - window
        while queue[0][1] < low:
            queue.popleft()
        value, best = queue[0]
        value += window - at
        for w in powers:
            other = cost_at.get(at - w)
            if other is not None and other < value:
                value, best = other, at - w
        value += penalty
        cost_at[at] = value
        came_from[at] = best
        key = value + at
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, at))
    cuts, at = [], positions[-1] if positions else 0
    while at:
        cuts.append(at)
        at = came_from[at]
    return cuts[::-1]


def allowed_cuts(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions where a window may end, with their penalties."""
    natural = closes[ids]
    natural[doc_ends - 1] = True
    at = np.flatnonzero(natural) + 1
    before = np.concatenate([[0], at[:-1]])
    extra = np.maximum(0, (at - before - 1) // FREE_RUN)  # cuts inside long stretches
    first = np.repeat(np.cumsum(extra) - extra, extra)
    inside = np.repeat(before, extra) + FREE_RUN * (np.arange(extra.sum()) - first + 1)
    points = np.concatenate([at, inside])
    penalty = np.concatenate([np.full(len(at), SENTENCE_PENALTY), np.full(len(inside), TOKEN_PENALTY)])
    order = np.argsort(points, kind="stable")
    points, penalty = points[order], penalty[order]
    penalty[np.searchsorted(points, doc_ends)] = 0
    return points.tolist(), penalty.tolist()


def pack_block(doc_ids: list, parts: list[bytes], closes: np.ndarray, first_sequence: int, window: int) -> tuple[pd.DataFrame, int]:
    """Pieces of one block of documents, and the number of sequences made."""
    data = b"".join(parts)
    ids = np.frombuffer(data, dtype="<u4")
    ends = np.cumsum([len(p) // 4 for p in parts])
    cuts = np.array(best_cuts(*allowed_cuts(ids, ends, closes), window), dtype=np.int64)
    stops = np.union1d(cuts, ends)  # a piece ends where its document or its sequence ends
    starts = np.concatenate([[0], stops[:-1]])
    doc = np.searchsorted(ends, starts, side="right")
    sequence = np.searchsorted(cuts, starts, side="right")
    doc_start = np.concatenate([[0], ends[:-1]])[doc]
    sequence_start = np.concatenate([[0], cuts[:-1]])[sequence]
    frame = pd.DataFrame(
        {
            "doc_id": pd.array([doc_ids[i] for i in doc], dtype="Int64"),
            "start": starts - doc_start,
            "length": stops - starts,
            "doc_tokens": np.diff(ends, prepend=0)[doc],
            "sequence_id": first_sequence + sequence,
            "offset": starts - sequence_start,
            "ids": [data[4 * a : 4 * b] for a, b in zip(starts, stops)],
        }
    )
    return frame, len(cuts)


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``ids`` (little-endian 32-bit) lie in ``sequence_id`` from ``offset`` on.

    The tokenizer file (about 1.5 MB) is read by the driver. A sequence shorter than ``window`` is to be
    padded to it by the reader, unless its length is a power of two.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    small_batches(df.sparkSession)

    def run(batches):
        tokenizer, special, cache, closes = kept_by_worker(f"pack {tokenizer_path}", lambda: _tools(definition))
        closes = closes.copy()
        closes[end_id] = False
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = (TaskContext.get().partitionId()) << 40
        keys, parts, held = [], [], 0
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                if any(s in t for s in special):  # special tokens may join chunks
                    ids = id_bytes(tokenizer.encode(t, add_special_tokens=False).ids)
                else:
                    ids = cache.ids(t)
                keys.append(key)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= BLOCK_TOKENS:
                    frame, made = pack_block(keys, parts, closes, sequence, window)
                    yield from (_batch(frame))
                    sequence += made
                    keys, parts, held = [], [], 0
        if keys:
            yield from _batch(pack_block(keys, parts, closes, sequence, window)[0])

    return df.select(doc_id, text).mapInArrow(run, PIECES)


def _tools(definition: str):
    """The tokenizer, its special strings, a cache of chunks, and which ids close a sentence.

    Byte-level merges in the order of their ids are ranks, and ranks are faster on single chunks than a
    whole tokenizer; any other definition is left to the tokenizer itself.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    vocabulary = tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, i in vocabulary.items():
        closes[i] = token[-1:] in (".", "!", "?", "Ċ")  # Ċ stands for a line end
    ranks = byte_ranks(json.loads(definition))
    if ranks is None:
        return tokenizer, special, ChunkCache(lambda chunk: tokenizer.encode(chunk, add_special_tokens=False).ids), closes
    import tiktoken

    return tokenizer, special, ChunkCache(tiktoken.Encoding("pack", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary), closes


def byte_ranks(definition: dict) -> dict[bytes, int] | None:
    """Token bytes -> id of a plain byte-level definition whose merges are in the order of their ids."""
    model, cut = definition["model"], definition.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if definition.get("normalizer") or any(cut.get(k) != v for k, v in plain.items()) or model.get("type") != "BPE":
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    letter = {chr(b): b for b in visible}
    letter |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(set(made)) or len(made) + 256 != len(vocabulary):
        return None
    return {bytes(letter[c] for c in token): i for token, i in vocabulary.items()}


def _batch(frame: pd.DataFrame):
    import pyarrow as pa

    kinds = [pa.int64()] * 6 + [pa.binary()]
    for at in range(0, len(frame), 20_000):
        part = frame.iloc[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[c], type=k) for c, k in zip(part.columns, kinds)], names=list(part.columns))

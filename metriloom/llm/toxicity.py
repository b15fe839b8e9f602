"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit. Of the labelled rows, the ``per_class`` with the least hash of their id are taken from each class
(a bounded sample). Their terms, whole words and word beginnings of ``PREFIXES`` letters, are counted by
class; those whose chi-square with the label reaches ``CHI_SQUARE`` make the vocabulary. Document
frequencies of its terms are counted over all documents. All other words of a text with such terms are
one more term (``REST``), which every document holds. The examples become unit TF-IDF vectors, sorted
so that similar ones are neighbours, in blocks of ``BLOCK``; the inverted index keeps, per term, its
postings and its greatest weight in each block.

Score. A document's block bounds are the sums of its weights times the block maxima. Blocks are read
from the highest bound down, and reading stops when no further bound reaches the k-th best cosine, so the
neighbours are exact. The vote of a neighbour is its cosine times the share of its class that it stands
for. A text without any term of the vocabulary is at cosine 0 to all: its neighbours are the examples
without any term either, with equal votes. ``prior`` votes of the base rate steady small sums.

Null and empty texts get the score of a text without terms. Labels that are null, and labelled rows
without a document, are left out; a document labelled twice counts as toxic if either label says so.
Without examples of both classes every score is the share of toxic ones (0 if none are labelled).
Repeated rows are scored alike. Columns named like the results are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metriloom.llm.frames import forget_kept, small_batches, texts

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
PER_CLASS = 2_048
CHI_SQUARE = 30.0
VOCABULARY = 4_096
NEIGHBOURS = 25
#: stands for all words outside the vocabulary, so that a vector shows how dense its terms are
REST = ""
BLOCK = 64
PRIOR = 0.5


def terms_of(word: str) -> list[str]:
    """A word and its beginnings; a beginning ends in ``*``."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def word_counts(text: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for w in WORD.findall(text.lower()):
        counts[w] = counts.get(w, 0) + 1
    return counts


@dataclass
class Index:
    """Everything a worker needs to score: bounded by the sample and the vocabulary."""

    terms: dict[str, int]
    idf: np.ndarray
    toxic: np.ndarray  # label of each example, in index order
    votes: np.ndarray  # labelled rows of its class that an example stands for
    doc_ids: np.ndarray
    starts: np.ndarray  # postings of term t: starts[t] .. starts[t + 1]
    examples: np.ndarray
    weights: np.ndarray
    block_max: np.ndarray  # term x block
    blank: float  # score of a text without terms
    base: float
    k: int

    def vector(self, counts: dict[str, int], known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Unit TF-IDF vector as (terms, weights). ``known`` caches the terms of words."""
        tf: dict[int, int] = {}
        rest = 0
        for word, n in counts.items():
            found = known.get(word)
            if found is None:
                found = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
                if len(known) >= 500_000:
                    known.clear()
                known[word] = found
            rest += 0 if found else n
            for t in found:
                tf[t] = tf.get(t, 0) + n
        if tf and rest:
            tf[self.terms[REST]] = rest
        at = np.fromiter(tf, dtype=np.int64, count=len(tf))
        w = (1 + np.log(np.fromiter(tf.values(), dtype=np.float64, count=len(tf)))) * self.idf[at]
        return at, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, at: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (ties: lower index) among those that share a term."""
        bounds = w @ self.block_max[at]
        blocks = np.argsort(-bounds, kind="stable")
        found, cosines = np.empty(0, np.int64), np.empty(0)
        step, done = 4, 0
        while done < len(blocks):
            if len(cosines) >= self.k and bounds[blocks[done]] + 1e-12 < cosines[self.k - 1]:
                break
            take = blocks[done : done + step]
            take = take[bounds[take] > 0]
            done, step = done + step, step * 4
            if not len(take):
                break
            scores = np.zeros(len(self.toxic))
            chosen = np.zeros(self.block_max.shape[1], dtype=bool)
            chosen[take] = True
            for t, x in zip(at, w):
                a, b = self.starts[t], self.starts[t + 1]
                e = self.examples[a:b]
                inside = chosen[e // BLOCK]
                scores[e[inside]] += x * self.weights[a:b][inside]
            e = np.flatnonzero(scores > 0)
            found, cosines = np.concatenate([found, e]), np.concatenate([cosines, scores[e]])
            order = np.lexsort((found, -cosines))[: self.k]
            found, cosines = found[order], cosines[order]
        return found, cosines

    def score(self, text: str, known: dict) -> tuple[float, list[int], list[float]]:
        at, w = self.vector(word_counts(text), known)
        if not len(at) or not len(self.toxic):
            return self.blank, [], []
        found, cosines = self.nearest(at, w)
        if not len(found):
            return self.blank, [], []
        votes = cosines * self.votes[found]
        scale = PRIOR * self.votes[found].min()
        value = (votes[self.toxic[found] == 1].sum() + scale * self.base) / (votes.sum() + scale)
        return float(min(1.0, max(0.0, value))), self.doc_ids[found].tolist(), np.minimum(cosines, 1.0).tolist()


def _count_terms(rows: DataFrame, text: str) -> DataFrame:
    """``term, toxic, clean``: sampled documents of each class that hold the term."""

    def run(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for t, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                for term in {x for w in word_counts(t) for x in terms_of(w)}:
                    counts.setdefault(term, [0, 0])[0 if toxic else 1] += 1
        names = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([counts[n][i] for n in names], pa.int64()) for i in (0, 1))], names=["term", "toxic", "clean"]
        )

    partial = rows.select(text, "_toxic").mapInArrow(run, "term string, toxic long, clean long")
    return partial.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _document_frequencies(docs: DataFrame, text: str, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term of the vocabulary, and how many there are."""

    def run(batches):
        forget_kept()
        found, n, known = np.zeros(len(terms), dtype=np.int64), 0, {}
        for batch in batches:
            for t in texts(batch.column(0)):
                n += 1
                held: set[int] = set()
                for word in set(WORD.findall(t.lower())):
                    ids = known.get(word)
                    if ids is None:
                        ids = tuple(terms[x] for x in terms_of(word) if x in terms)
                        if len(known) >= 500_000:
                            known.clear()
                        known[word] = ids
                    held.update(ids)
                found[list(held)] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], names=["term", "n"])

    rows = docs.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per term
    df, total = np.zeros(len(terms), dtype=np.int64), 0
    for r in rows:
        if r["term"] < 0:
            total = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, total


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS, k: int = NEIGHBOURS) -> Index:
    """Index of a bounded sample of the labelled rows; see the module."""
    small_batches(docs.sparkSession)
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max((F.col(label) != 0).cast("int")).alias("_toxic"))
    sizes = {r["_toxic"]: r["n"] for r in marked.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = None
    for c in (0, 1):
        part = marked.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = chosen.sparkSession.createDataFrame([(r["_id"], r["_toxic"]) for r in chosen.collect()], "_id long, _toxic int")  # 2 * per_class ids
    sample = docs.select(doc_id, text).join(F.broadcast(picked), F.col(doc_id) == F.col("_id")).dropDuplicates(["_id"])
    taken = {c: min(per_class, sizes.get(c, 0)) for c in (0, 1)}
    counted = _count_terms(sample, text)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    n1, n0 = float(taken[1]), float(taken[0])
    n = n1 + n0
    chi = n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / (n1 * n0 * (a + b) * (n - a - b) + F.lit(1e-9))
    best = counted.withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE).orderBy(F.desc("chi"), "term").limit(VOCABULARY).select("term")
    names = sorted(r["term"] for r in best.collect()) if n1 and n0 else []
    terms = {t: i for i, t in enumerate([REST, *names] if names else [])}
    df, total = _document_frequencies(docs, text, terms) if terms else (np.zeros(0), 0)
    df[:1] = total
    idf = np.log((1 + total) / (1 + df)) + 1
    base = sizes.get(1, 0) / max(1, sum(sizes.values()))
    stands = {c: sizes.get(c, 0) / max(1, taken[c]) for c in (0, 1)}
    bare = Index(terms, idf, *(np.empty(0),) * 3, np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0), np.empty((len(terms), 0)), base, base, k)
    return _indexed(bare, _vectors(sample, text, bare), stands) if terms else bare


def _vectors(sample: DataFrame, text: str, index: Index) -> list:
    """(id, toxic, terms, weights) of the sampled examples: at most two classes of them reach the driver."""

    def run(batches):
        known: dict = {}
        for batch in batches:
            at, w = zip(*(index.vector(word_counts(t), known) for t in texts(batch.column(2)))) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.tolist() for x in at], pa.list_(pa.int64())), pa.array([x.tolist() for x in w], pa.list_(pa.float64()))],
                names=["id", "toxic", "at", "w"],
            )

    return sample.select("_id", "_toxic", text).mapInArrow(run, "id long, toxic int, at array<long>, w array<double>").collect()


def _indexed(bare: Index, rows: list, stands: dict[int, float]) -> Index:
    blank_votes = {c: stands[c] * sum(1 for r in rows if r["toxic"] == c and not r["at"]) for c in (0, 1)}
    blank = (blank_votes[1] + PRIOR * bare.base) / (blank_votes[0] + blank_votes[1] + PRIOR)
    # neighbours in the order share their strongest terms, so block maxima are sharp
    used = sorted((r for r in rows if r["at"]), key=lambda r: ([t for _, t in sorted(zip([-x for x in r["w"]], r["at"]))[:3]], r["id"]))
    blocks = -(-len(used) // BLOCK)
    examples = np.concatenate([np.full(len(r["at"]), i) for i, r in enumerate(used)]) if used else np.empty(0, np.int64)
    at = np.concatenate([r["at"] for r in used]).astype(np.int64) if used else np.empty(0, np.int64)
    w = np.concatenate([r["w"] for r in used]) if used else np.empty(0)
    block_max = np.zeros((len(bare.terms), blocks))
    np.maximum.at(block_max, (at, examples // BLOCK), w)
    order = np.argsort(at, kind="stable")
    toxic = np.array([r["toxic"] for r in used], dtype=np.int64)
    return Index(
        bare.terms, bare.idf, toxic, np.array([stands[r["toxic"]] for r in used]), np.array([r["id"] for r in used], dtype=np.int64),
        np.searchsorted(at[order], np.arange(len(bare.terms) + 1)), examples[order].astype(np.int64), w[order], block_max, blank, bare.base, bare.k,
    )


def score(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """All columns, and ``score``, ``predicted``, and as evidence ``neighbours`` (ids) with their ``cosines``."""
    base = docs.drop("score", "predicted", "neighbours", "cosines")
    small_batches(docs.sparkSession)

    def run(batches):
        forget_kept()
        known: dict = {}
        for batch in batches:
            found = [index.score(t, known) for t in texts(batch.column(batch.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([int(f[0] >= 0.5) for f in found], pa.int32()),
                    pa.array([f[1] for f in found], pa.list_(pa.int64())),
                    pa.array([f[2] for f in found], pa.list_(pa.float64())),
                ],
                names=[*batch.schema.names, "score", "predicted", "neighbours", "cosines"],
            )

    added = StructType.fromDDL("score double, predicted int, neighbours array<long>, cosines array<double>")
    return base.mapInArrow(run, StructType([*base.schema.fields, *added.fields]))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0

"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Learned from at most ``BOUND`` labelled rows. Every word of an example, lower-cased, is a term, told by
a 64-bit hash. It weighs its TF-IDF, times ``BASE`` and the strength of its tie to the labels: the phi
coefficient beyond what chance gives the strongest of so many terms. So all words of all texts span the vectors, and
those that tell the labels apart span them most. A block-max index finds the nearest ``K`` examples; their votes are weighted by distance and
calibrated by the share of label 1 that examples with such a vote, their own left out, turned out to have; a vote above
all that examples had counts itself.

Defined cases: null text counts as empty, and like every text without a word that an example has gets the share of label 1
among the examples; without labels of both kinds nothing is learned and every score is 0; rows with equal text have
equal scores; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.hashing import word_hashes
from cairn.llm.learning import labelled, remainder
from cairn.llm.neighbours import QUERIES, Index, Sparse
from cairn.llm.shared import read

BOUND = 12_000
K = 15
#: Votes are weighted by this power of the distance.
NEAR = 2
#: Weight of a term without a tie to the labels.
BASE = 0.05
CUT = 0.5
#: Texts scored at once.
SLICE = 512
_OTHER = re.compile(r"[\W\d_]+")


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of a text's words, rising, and how often it has each."""
    return np.unique(word_hashes(_OTHER.sub(" ", (text or "").lower()).encode("utf-8", "surrogatepass")), return_counts=True)


class Model:
    def __init__(self, rows: list[tuple[int, int, bytes, bytes]]):
        """``rows``: (id, label, hashes of the words, their counts) of the examples."""
        n, ones = len(rows), sum(r[1] for r in rows)
        self.rest = ones / n if 0 < ones < n else 0.0
        if not self.rest:
            rows = []
        start = np.cumsum([0, *(len(r[2]) // 8 for r in rows)])
        self.terms, at = np.unique(np.frombuffer(b"".join(r[2] for r in rows), np.uint64), return_inverse=True)
        at = at.astype(np.int32)
        y = np.array([r[1] for r in rows], np.int64)
        of, held = np.bincount(at, minlength=len(self.terms)), np.bincount(at, np.repeat(y, np.diff(start)), len(self.terms))
        chi = n * (held * (n - ones) - (of - held) * ones) ** 2 / np.maximum(of * (n - of) * float(ones * (n - ones)), 1e-9)
        tie = np.sqrt(np.maximum(0, chi - 2 * np.log(len(of) + 1)) / max(n, 1))
        self.scale = (np.log((n + 1) / (of + 1)) + 1) * (BASE + tie)
        self.unseen = (np.log(n + 1) + 1) * BASE
        weight = ((1 + np.log(np.frombuffer(b"".join(r[3] for r in rows), np.int32))) * self.scale[at]).astype(np.float32)
        ids = [r[0] for r in rows]
        del rows
        for lo, hi in zip(start, start[1:], strict=False):
            weight[lo:hi] /= np.sqrt(weight[lo:hi] @ weight[lo:hi]) or 1.0
        vector = lambda r: (at[start[r] : start[r + 1]], weight[start[r] : start[r + 1]])
        self.index = Index(map(vector, range(len(y))), y.tolist(), ids)
        votes = []
        for first in range(0, len(y), QUERIES):
            some = [r for r in range(first, min(first + QUERIES, len(y))) if r in self.index.entry]
            own = [self.index.entry[r] for r in some]
            for r, e, near in zip(some, own, self.index.search_all([vector(r) for r in some], K, own), strict=True):
                if (vote := self.index.weigh(near, K, e, int(y[r]), NEAR)) is not None:
                    votes.append((vote[0], int(y[r])))
        self.index.lists = None
        self.most = max((v for v, _ in votes), default=0.0)
        self.steps = _isotonic(votes)

    def vector(self, text: str | None) -> Sparse:
        """The terms and weights of a text's unit vector; words that no example has count in its length."""
        found, n = counted(text)
        at = np.searchsorted(self.terms, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.terms)
        known[inside] = self.terms[at[inside]] == found[inside]
        tf = 1 + np.log(n)
        w = tf[known] * self.scale[at[known]]
        return at[known], w / (np.sqrt(w @ w + (tf[~known] ** 2).sum() * self.unseen**2) or 1.0)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float]]]:
        """Calibrated score, and the evidence: (id of an example, cosine), nearest first."""
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """``score`` of each; equal texts are scored once."""
        distinct = list(dict.fromkeys(texts))
        out = {}
        for first in range(0, len(distinct), QUERIES):
            some = distinct[first : first + QUERIES]
            for text, near in zip(some, self.index.search_all([self.vector(t) for t in some], K), strict=True):
                out[text] = self._score(near)
        return [out[t] for t in texts]

    def _score(self, near: list[tuple[int, float]]) -> tuple[float, list[tuple[int, float]]]:
        if (vote := self.index.weigh(near, K, power=NEAR)) is None:
            return self.rest, []
        share = float(np.interp(vote[0], *self.steps)) if len(self.steps[0]) else vote[0]
        return max(share, vote[0]) if vote[0] > self.most else share, [(i, c) for e, c in near for i in self.index.ids[e]][:K]


def _isotonic(votes: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Votes and the rising share of label 1 at them, by pooling adjacent violators; shares are smoothed by half a row."""
    pools: list[list[float]] = []
    by: dict[float, list[int]] = {}
    for v, y in votes:
        by.setdefault(round(v, 3), []).append(y)
    for v in sorted(by):
        pools.append([v, float(sum(by[v])), float(len(by[v]))])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            v2, y2, n2 = pools.pop()
            v1, y1, n1 = pools[-1]
            pools[-1] = [(v1 * n1 + v2 * n2) / (n1 + n2), y1 + y2, n1 + n2]
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.25) / (p[2] + 0.5) for p in pools])


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counted(t.as_py()) for t in b.column("text")]
            packed = [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in ([h for h, _ in found], [n.astype(np.int32) for _, n in found])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *packed], ["doc_id", "y", "words", "counts"])

    rows = labelled(docs, labels, "toxic", 5, 0, bound).select("doc_id", "y", "text")
    found = rows.mapInArrow(each, "doc_id long, y int, words binary, counts binary").toArrow().to_pydict()
    return Model(sorted(zip(*found.values(), strict=True)))


def _sent(spark: SparkSession, model: Model) -> Broadcast:
    """The model, which a Python worker reads once for all its tasks; in a closure each task would have a model and its bytes."""
    return spark.sparkContext.broadcast(model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``evidence`` (ids of the nearest examples and cosines), in place of such columns."""
    docs = docs.drop("score", "evidence")
    schema = docs.select("*", F.lit(0.0).alias("score"), F.array(F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(0.0).alias("cosine"))).alias("evidence")).schema
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
    sent = _sent(docs.sparkSession, model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            got = sent.value.scores(b.column("text").to_pylist())
            evidence = [[{"doc_id": i, "cosine": c} for i, c in e] for _, e in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _ in got], pa.float64()), pa.array(evidence, kind)], [*b.schema.names, "score", "evidence"])

    return docs.mapInArrow(rows, schema)


def kept(docs: DataFrame, model: Model, at: float = CUT) -> DataFrame:
    """The rows of ``docs`` with a score below ``at``, as they are."""
    sent = _sent(docs.sparkSession, model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            yield b.filter(pa.array([s < at for s, _ in sent.value.scores(b.column("text").to_pylist())], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.transform("evidence", lambda x: x["doc_id"]).alias("evidence"))

"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Fitted on the driver on at most ``BOUND`` labelled rows, whose statistics are computed on the executors; every whole
text is then scored in Arrow batches with the flattened trees, which are a few thousand numbers.

Defined cases: null text counts as empty; an empty text has all statistics 0 and gets the score that those get; without
labels every score is the smoothed share of label 1; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.boosting import Trees, fit
from cairn.llm.hashing import mixed, word_hashes
from cairn.llm.learning import labelled, remainder
from cairn.llm.shared import read

BOUND = 20_000
CUT = 0.7
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "#*$%&<>", "|", "\"'()-:;@/\\_")
N_STATISTICS = len(_CLASSES) + 15


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_STATISTICS)
    if not data:
        return out
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    each = np.bincount(b, minlength=256)
    k = len(_CLASSES)
    out[:k] = [each[np.frombuffer(c.encode(), np.uint8)].sum() / n for c in _CLASSES]
    out[k] = each[128:].sum() / n
    out[k + 1] = np.log1p(n)
    w = word_hashes(data)
    if not len(w):
        return out
    out[k + 2] = np.log1p(len(w))
    out[k + 3] = (n - each[9:14].sum() - each[32]) / len(w)
    _, counts = np.unique(w, return_counts=True)
    out[k + 4] = len(counts) / len(w)
    out[k + 5] = counts.max() / len(w)
    out[k + 6] = (w[1:] == w[:-1]).sum() / len(w)
    p = counts / len(w)
    out[k + 7] = -(p * np.log(p)).sum()
    out[k + 8] = out[k + 7] / np.log(len(w) + 1)
    if len(w) > 2:
        _, counts = np.unique(mixed(w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7)), return_counts=True)
        out[k + 9] = counts[counts > 1].sum() / (len(w) - 2)
    lines = data.split(b"\n")
    full = [x for x in lines if x.strip()]
    out[k + 10] = np.log1p(len(full))
    out[k + 11] = 1 - len(set(full)) / len(full) if full else 0
    out[k + 12] = len(w) / len(full) if full else 0
    out[k + 13] = sum(x.rstrip()[-1:] in b".!?" for x in full) / len(full) if full else 0
    out[k + 14] = len(set(data)) / 256
    return out


def table(texts: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([statistics(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, N_STATISTICS))


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Trees:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(table(b.column("text"))), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = labelled(docs, labels, "quality", 4, 2, bound).mapInArrow(rows, "doc_id long, y int, x array<double>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    return fit(np.stack(got.x.to_list()) if len(got) else np.zeros((0, N_STATISTICS)), got.y.to_numpy(np.float64))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id, score`` of each row of ``docs`` (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(table(b.column("text"))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

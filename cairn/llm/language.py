"""Language identification by a bidirectional gated recurrent network over bytes.

Trained on the driver on the tokens of at most ``BOUND`` documents a language. Every position of every token of a
text gets label probabilities; a text's are their geometric mean over positions of letters, scaled to sum to one. The network sees a token and its
boundaries, so equal tokens have equal outputs and are run once for each worker, as long as its table of ``KNOWN``
tokens lasts; the table starts anew when full, which changes no result.

Defined cases: ``und`` with score 0 for a null text or one without a letter, and for every text if there is nothing
to learn from; null languages are not learned; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.learning import by_language, remainder
from cairn.llm.recurrent import PIECE, Network, padded
from cairn.llm.shared import read

BOUND = 400
KNOWN = 200_000
FLOOR = 1e-3
_LETTER = re.compile(r"[^\W\d_]")


def pieces(token: str) -> list[bytes]:
    """The bytes of a token, in pieces of whole characters."""
    data, out, at = token.encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and 128 <= data[end] < 192:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
            counts = Counter(text.as_py().split())
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "token", "n"])


def train(docs: DataFrame, bound: int = BOUND) -> tuple[list[str], Network | None]:
    """The languages and the network, from all tokens of the chosen documents, which executors count.

    A token weighs more the more often it is seen, and less in a language that has a small share of it, so texts with a
    wrong label do little harm.
    """
    found = by_language(docs, 4, 2, bound).select("lang", "text").mapInArrow(_tokens, "lang string, token string, n long")
    counts: dict[str, Counter] = {}
    for row in found.groupBy("lang", "token").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(row.lang, Counter())[row.token] = row.n
    langs = sorted(counts)
    if not langs:
        return [], None
    x, y, weight = [], [], []
    totals = {lang: counts[lang].total() for lang in langs}
    for k, lang in enumerate(langs):
        for token, n in sorted(counts[lang].items(), key=lambda c: (-c[1], c[0])):
            every = sum(counts[other].get(token, 0) / totals[other] for other in langs)
            for p in pieces(token):
                x.append(p), y.append(k), weight.append(n / totals[lang] / every * (1 + np.log(n)))
    net = Network(len(langs))
    net.train(x, np.array(y), np.array(weight))
    return langs, net


class Pooler:
    """Sums of log probabilities over a token's letters, and their number, remembered by token."""

    def __init__(self, net: Network):
        self.net, self.at, self.n = net, {}, 0
        self.sums = np.zeros((KNOWN, net.labels + 1), np.float32)

    def learn(self, tokens: list[str]) -> None:
        parts = [(self.at[t], p) for t in tokens for p in pieces(t)]
        parts.sort(key=lambda x: len(x[1]))
        for i in range(0, len(parts), 1024):
            some = parts[i : i + 1024]
            x, inside = padded([p for _, p in some])
            p = self.net.probabilities(x)
            rows = np.array([r for r, _ in some])
            np.add.at(self.sums, (rows, slice(0, self.net.labels)), np.einsum("tbl,tb->bl", np.log(p + FLOOR), inside))
            np.add.at(self.sums[:, -1], rows, inside.sum(axis=0))

    def pool(self, text: str) -> np.ndarray:
        """The pooled probabilities of one text."""
        total = np.zeros(self.net.labels + 1)
        tokens = text.split()
        for i in range(0, len(tokens), KNOWN // 2):
            counts = Counter(tokens[i : i + KNOWN // 2])
            new = [t for t in counts if t not in self.at]
            if len(self.at) + len(new) > KNOWN:
                self.at, new = {}, list(counts)
                self.sums[:] = 0
            if new:
                for t in new:
                    self.at[t] = len(self.at)
                self.learn(new)
            rows = np.fromiter(map(self.at.__getitem__, counts), np.int64, len(counts))
            total += np.fromiter(counts.values(), np.float64, len(counts)) @ self.sums[rows]
        mean = np.exp(total[:-1] / max(total[-1], 1e-9))
        return mean / mean.sum()

    def warm(self, texts: list[str]) -> None:
        """Learns the new tokens of several texts at once, which fills the network's batches."""
        new = dict.fromkeys(t for text in texts for t in set(text.split()) if t not in self.at)
        if len(new) <= KNOWN // 2:
            if len(self.at) + len(new) > KNOWN:
                self.at = {}
                self.sums[:] = 0
            for t in new:
                self.at[t] = len(self.at)
            self.learn(list(new))


def predict(docs: DataFrame, langs: list[str], net: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row of ``docs`` (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(net) if net else None
        for b in batches:
            texts = b.column("text").to_pylist()
            found = []
            for i in range(0, len(texts), 64):
                some = [t if t and pooler and _LETTER.search(t) else None for t in texts[i : i + 64]]
                if pooler:
                    pooler.warm([t for t in some if t])
                for t in some:
                    p = pooler.pool(t) if t else None
                    found.append(("und", 0.0) if p is None else (langs[int(p.argmax())], float(min(1.0, p.max()))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, *train(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")

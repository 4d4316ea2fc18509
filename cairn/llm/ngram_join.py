"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles. Candidates share a band of MinHash values; with 40 bands of 6, a pair at the
threshold of 0.8 goes unseen with a probability of 5e-6, and the more alike the less. A bucket links its members to
its least one, so linear in its size, and the components of those links are the groups in which pairs are compared:
MinHash values a few at a time, and a pair is dropped once the posterior probability of its similarity reaching the
threshold, under a uniform prior, falls below ``TOLERANCE``. Pairs that are left are verified exactly on the sets.

Exact copies are one representative from the start: one of them is sketched, and none are compared. A group of over
``BLOCK`` representatives or ``BLOCK_BYTES`` is compared block by block, each pair of blocks a group of its own, so a
member is sent once for each block of its own group; tasks return a count of links and one root for each document, not
pairs.

Defined cases: texts without words, null included, link to nothing and are a class each; a text of under five words
is one shingle; repeated rows are copies of each other; ``class_id`` is the least doc_id of a class (null if it has
none); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.components import components
from cairn.llm.hashing import groups, mixed, shingles
from cairn.llm.shared import cut, one_of_each, read, scratch, small, text_key

N = 5
THRESHOLD = 0.8
TOLERANCE = 1e-9
BANDS, ROWS = 40, 6
STEP = 24
BLOCK = 1024
BLOCK_BYTES = 4 << 20
#: Texts whose sets are held at once.
SLICE = 256


def minhash(sets: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """``k`` MinHash values of a set of 64-bit hashes."""
    seeds = mixed(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    turn, scale = seeds[:k, None], seeds[k:, None] | np.uint32(1)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    low = (sets >> np.uint64(16)).astype(np.uint32)
    for i in range(0, len(low), 1024):
        x = low[None, i : i + 1024] ^ turn
        x *= scale
        x ^= x >> np.uint32(15)
        np.minimum(out, x.min(axis=1), out=out)
    return out


@cache
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``n`` equal MinHash values that leave a posterior of ``tolerance`` for ``threshold``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail is a binomial sum.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def linked(sigs: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Pairs (i, j) of rows, i from ``left`` and j from ``right`` (or later in ``left``), at or above the threshold."""
    kept = []
    for at, i in enumerate(left):
        js = left[at + 1 :] if right is None else right
        equal = np.zeros(len(js), np.int32)
        for k in range(0, sigs.shape[1], STEP):
            if not len(js):
                break
            equal += (sigs[js, k : k + STEP] == sigs[i, k : k + STEP]).sum(axis=1, dtype=np.int32)
            alive = equal >= least_matches(min(k + STEP, sigs.shape[1]), threshold, tolerance)
            js, equal = js[alive], equal[alive]
        if len(js):
            kept.append(np.stack((np.full(len(js), i), js), axis=1))
    if not kept:
        return np.empty((0, 2), np.int64)
    pairs = np.concatenate(kept)
    size = np.array([len(s) for s in sets])
    if len(pairs) <= 8 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs])
    else:
        common = _common(sets, size)[pairs[:, 0], pairs[:, 1]]
    return pairs[common >= threshold * (size[pairs[:, 0]] + size[pairs[:, 1]] - common) - 1e-9]


def _common(sets: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over a few thousand shingles at a time."""
    values, which = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(which) > 1
    new = np.cumsum(often) - 1
    rows, cols = rows[often[which]], new[which[often[which]]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(often.sum()), 2048):
        lo, hi = np.searchsorted(cols, (a, a + 2048))
        m = np.zeros((len(sets), 2048), np.float32)
        m[rows[lo:hi], cols[lo:hi] - a] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        bands, counts = [], []
        for text in batch.column("text"):
            s = shingles(text.as_py(), n)
            counts.append(len(s))
            if not len(s):
                bands.append(None)
                continue
            h = salt.copy()
            for column in minhash(s).reshape(BANDS, ROWS).T:
                h = mixed(h * np.uint64(31) + column)
            bands.append(h.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["key", "n_shingles", "bands"])


def _prepared(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        sets = [shingles(t.as_py(), n) for t in batch.column("text")]
        sigs = [minhash(s).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), batch.column("component"), batch.column("blocks"), pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "copies", "component", "blocks", "sig", "shingles"])


def _compared(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {"id": [], "links": [], "root": []}
    for table in groups(batches, "component", "p", "q"):
        ids, first = np.unique(table.column("id").to_numpy(), return_index=True)
        table = table.take(first)
        sigs = np.stack([np.frombuffer(x.as_py(), np.uint32) for x in table.column("sig")])
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        block, p, q = (table.column(c).to_numpy() for c in ("block", "p", "q"))
        left, right = np.flatnonzero(block == p[0]), np.flatnonzero(block == q[0]) if p[0] != q[0] else None
        pairs = linked(sigs, sets, left, right, threshold, tolerance)
        if not len(pairs):
            continue
        copies = table.column("copies").to_numpy()
        links = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(ids)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(ids))
        root = np.arange(len(ids))
        while True:  # labels sink to the least row of a component
            new = root.copy()
            np.minimum.at(new, pairs[:, 0], root[pairs[:, 1]])
            np.minimum.at(new, pairs[:, 1], root[pairs[:, 0]])
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(links)
        out["id"] += ids[some].tolist()
        out["links"] += links[some].astype(np.int64).tolist()
        out["root"] += ids[root[some]].tolist()
        if len(out["id"]) > 10_000:
            yield pa.RecordBatch.from_pydict(out, pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))
            out = {k: [] for k in out}
    yield pa.RecordBatch.from_pydict(out, pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id, key, class, class_id, n_links, class_size`` of each document of ``docs`` (doc_id, text).

    ``n_links`` counts the other documents, copies included, whose similarity reaches ``threshold``; a class holds
    what links connect. ``key`` names the text, ``class`` the class, null for a text without words.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    with scratch(docs.sparkSession) as held:
        one, copies = one_of_each(docs)
        sketch = cut(one.mapInArrow(lambda b: _sketch(b, n), "key string, n_shingles long, bands array<long>"))
        reps = sketch.join(small(copies.select("key", "copies")), "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
        reps = cut(reps.withColumn("id", F.monotonically_increasing_id()))
        banded = reps.filter("n_shingles > 0").select("id", F.explode("bands").alias("h"))
        heads = banded.groupBy("h").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("h", "head")
        near = cut(components(banded.join(heads, "h").filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))))
        near = cut(near.join(reps.select("id", "key", "copies", "n_shingles"), "id"))
        size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("n_shingles") * 8 + 8 * BANDS * ROWS) / BLOCK_BYTES)).cast("long")
        members = cut(near.join(small(cut(near.groupBy("component").agg(size.alias("blocks")))), "component").select("id", "key", "copies", "component", "blocks"))
        texts = one.join(small(members), "key")
        ready = texts.select("id", "copies", "component", "blocks", "text").mapInArrow(lambda b: _prepared(b, n), "id long, copies long, component long, blocks long, sig binary, shingles binary")
        block = F.pmod(F.xxhash64("id"), F.col("blocks"))
        ready = ready.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        ready = ready.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
        dealt = ready.select("component", "p", "q", "block", "id", "copies", "sig", "shingles").repartition("component", "p", "q").sortWithinPartitions("component", "p", "q")
        found = cut(dealt.mapInArrow(lambda b: _compared(b, threshold, tolerance), "id long, links long, root long"))
        classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        labelled = reps.select("id", "key", "copies", "n_shingles").join(links, "id", "left").join(classes, "id", "left")
        labelled = cut(labelled.select("key", "n_shingles", F.coalesce("component", "id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        rows = held.keep(cut(keyed.join(small(labelled), "key", "left")))
        by = held.keep(cut(rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"))))
    out = rows.join(small(by), "class", "left")
    lone = F.coalesce(F.col("n_shingles"), F.lit(0)) == 0
    return out.select("doc_id", "key", F.when(~lone, F.col("class")).alias("class"), F.when(lone, F.col("doc_id")).otherwise(F.col("least")).alias("class_id"), F.when(lone, 0).otherwise(F.col("n_links")).alias("n_links"), F.when(lone, 1).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size")

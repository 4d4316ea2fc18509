"""Removal of repeated byte strings by sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too. Only suffixes that can have an
equal are sorted. Anchors find those: a string's anchor is the first of its positions whose hash of the next ``GRAM``
bytes is the least. Equal strings have their anchor at the same offset and with the same hash, so a string without an
anchor seen twice is not repeated; this loses nothing.

Strings come in pieces: those of one anchor, in at most ``WIDTHS[0]`` starts in a row. Equal pieces are one before they
are shuffled, within a text and by a partial aggregate; a piece that occurs twice is repeated whole, and what is common
is sorted once, however often it occurs. Pieces meet by the bytes that all their strings share. Where different pieces
meet, one of each kind brings its bytes, and the suffixes at each offset are put in order by deep-shallow sorting; equal
neighbours are repeated. More than ``GROUP`` kinds that share those bytes, as at the edges of a very common passage, are
dealt anew as narrower pieces, which share more bytes, down to single strings; so no task gathers a common passage, and
every piece is aggregated, dealt and sorted in the same way.

Exact copies of a text are set aside first: each is repeated whole if it has ``LENGTH`` bytes, and one stands for all.
The distinct texts are dealt out once, whatever their number; what is found out about them later goes to where they are.

Defined cases: null text is empty, with nothing removed; texts under ``LENGTH`` bytes keep all; repeated rows are copies;
periodic texts have one piece for each place in the period; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.hashing import _B, _B_INVERSE, mixed, powers
from cairn.llm.shared import beside, cut, dealt, one_of_each, read, scratch, small, text_key
from cairn.llm.suffixes import Sorter

LENGTH = 200
GRAM = 40
_GAP = LENGTH - GRAM
#: Starts of strings in a piece, where pieces that share bytes are dealt out and, where too many do, dealt anew.
WIDTHS = (_GAP + 1, 32, 4, 1)
GROUP = 2_048
_CHUNK = 1 << 20


def _sliding(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The best of each ``n`` neighbours of ``x``."""
    have = 1
    while have * 2 <= n:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors, their hashes, and the first and last start of the strings whose anchor each is."""
    n = len(data)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    b *= powers(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b, dtype=np.uint64)))
    h = mixed((total[GRAM:] - total[:-GRAM]) * powers(n, _B_INVERSE)[: n - GRAM + 1])
    least = _sliding(h, _GAP + 1, np.minimum)  # by start of a string
    wide = np.concatenate((np.zeros(_GAP, np.uint64), least, np.zeros(_GAP, np.uint64)))
    at = np.flatnonzero(_sliding(wide, _GAP + 1, np.maximum) == h)
    first, last = np.empty_like(at), np.empty_like(at)
    for i in range(0, len(at), 4096):
        p = at[i : i + 4096]
        own = wide[p[:, None] + np.arange(_GAP + 1)] == h[p, None]  # strings that start at p - _GAP to p
        first[i : i + 4096] = p - _GAP + own.argmax(axis=1)
        last[i : i + 4096] = p - own[:, ::-1].argmax(axis=1)
    # Of several places with the least hash, the first is the anchor.
    order = np.lexsort((at, h[at]))
    twin = order[1:][h[at[order[1:]]] == h[at[order[:-1]]]]
    before = order[:-1][h[at[order[1:]]] == h[at[order[:-1]]]]
    first[twin] = np.maximum(first[twin], at[before] + 1)
    first, last = np.maximum(first, 0), np.minimum(last, n - LENGTH)
    some = first <= last
    return at[some], h[at[some]], first[some], last[some]


def _bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct hashes of a text's anchors, and how often it has each."""
    for b in batches:
        hs, ns = [], []
        for t in b.column("text"):
            h, n = np.unique(anchors(_bytes(t))[1].view(np.int64), return_counts=True)
            hs.append(h), ns.append(n.astype(np.int32))
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(hs, pa.list_(pa.int64())), pa.array(ns, pa.list_(pa.int32()))], ["key", "h", "n"])


_PLACE = pa.struct([("at", pa.int32()), ("most", pa.int16()), ("least", pa.int16())])
_PIECE = pa.struct([*_PLACE, ("n", pa.int32()), *((k, pa.int64()) for k in ("c1", "c2", "s1", "s2"))])
_RUN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_PIECES = "id long, pieces array<struct<at:int,most:short,least:short,n:int,c1:long,c2:long,s1:long,s2:long>>, runs array<struct<start:int,end:int>>"


def _digest(data: bytes, *marks: int) -> tuple[int, int]:
    d = hashlib.blake2b(data + bytes(marks), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def pieces(data: bytes, places: Iterator[tuple[int, int, int]], width: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """The distinct pieces of a text, and runs of what it holds twice.

    ``places``: an anchor, and how far before it its first and last string start. A piece: such a place of at most
    ``width`` starts, how often the text has it, a digest of the bytes that all strings of pieces of this name share
    (c1, c2), and one of all its bytes (s1, s2).
    """
    seen: dict[tuple[int, int], list] = {}
    runs: list[tuple[int, int]] = []
    for at, most, least in places:
        for q in range(least // width, most // width + 1):
            m, n = min(most, q * width + width - 1), max(least, q * width)
            start, end = at - m, at - n + LENGTH
            s = _digest(data[start:end], m, n)
            if (had := seen.get(s)) is None:
                core = at - q * width
                seen[s] = [at, m, n, 1, *_digest(data[core : core - width + 1 + LENGTH], q), *s]
                continue
            if had[3] == 1:
                runs.append((had[0] - had[1], had[0] - had[2] + LENGTH))
            had[3] += 1
            if start <= runs[-1][1] and start >= runs[-1][0]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], end))
            else:
                runs.append((start, end))
    return [tuple(x) for x in seen.values()], merged(runs)


def _cut_up(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """From (id, text) and either hashes of anchors (h) or places: the text's pieces."""
    names = [f.name for f in _PIECE]
    for b in batches:
        for i in range(0, b.num_rows, 64):
            some = b.slice(i, 64)
            found, runs = [], []
            for k, t in enumerate(some.column("text")):
                data = _bytes(t)
                if "h" in b.schema.names:
                    at, h, first, last = anchors(data)
                    mine = np.isin(h.view(np.int64), some.column("h")[k].values.to_numpy())
                    places = zip(at[mine].tolist(), (at - first)[mine].tolist(), (at - last)[mine].tolist(), strict=True)
                else:
                    places = ((x["at"], x["most"], x["least"]) for x in some.column("places")[k].as_py())
                ps, rs = pieces(data, places, width)
                found.append([dict(zip(names, p, strict=True)) for p in ps])
                runs.append([{"start": s, "end": e} for s, e in rs])
            yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(found, pa.list_(_PIECE)), pa.array(runs, pa.list_(_RUN))], ["id", "pieces", "runs"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text, places): the bytes of all strings of each place."""
    for b in batches:
        out: dict[str, list] = {k: [] for k in _ABOUT.names}
        for row, t, places in zip(b.column("id").to_pylist(), b.column("text"), b.column("places"), strict=True):
            data = _bytes(t)
            for x in places.as_py():
                start = x["at"] - x["most"]
                out["h"].append(x["c1"]), out["id"].append(row), out["start"].append(start), out["left"].append(x["most"])
                out["about"].append(data[start : x["at"] - x["least"] + LENGTH])
            if len(out["h"]) > 10_000:
                yield pa.RecordBatch.from_pydict(out, _ABOUT)
                out = {k: [] for k in out}
        yield pa.RecordBatch.from_pydict(out, _ABOUT)


_ABOUT = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("left", pa.int16()), ("about", pa.binary())])
_RUNS = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_starts(h: list[int], left: list[int], about: list[bytes]) -> list[np.ndarray]:
    """For each place, which of its strings are repeated; ``left`` is how far before the anchor the first one starts.

    Places with one ``h`` lie together. A string is repeated if a place of the same ``h`` has it at the same offset.
    """
    same: dict[tuple[int, int, bytes], int] = {}
    counts: list[int] = []
    which = np.empty(len(h), np.int64)
    for i, k in enumerate(zip(h, left, about, strict=True)):
        which[i] = j = same.setdefault(k, len(same))
        if j == len(counts):
            counts.append(0)
        counts[j] += 1
    distinct = list(same)
    starts = [np.full(max(0, len(a) - LENGTH + 1), n > 1) for (_, _, a), n in zip(distinct, counts, strict=True)]
    groups = np.unique([k[0] for k in distinct], return_inverse=True)[1] if distinct else np.empty(0, np.int64)
    mixed_group = np.bincount(groups) > 1 if len(groups) else np.empty(0, bool)
    rows = [i for i in range(len(distinct)) if mixed_group[groups[i]] and len(starts[i])]
    if rows:
        data = b"".join(distinct[i][2] for i in rows)
        base = np.cumsum([0, *(len(distinct[i][2]) for i in rows)])[:-1]
        n = np.array([len(starts[i]) for i in rows])
        owner = np.repeat(np.arange(len(rows)), n)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        offset = within - np.array([distinct[i][1] for i in rows])[owner] + _GAP
        cell = groups[np.array(rows)][owner] * (_GAP + 1) + offset
        by = np.argsort(cell, kind="stable")
        cell, at = cell[by], (base[owner] + within)[by]
        alone = np.bincount(cell)[cell] == 1
        by, cell, at = by[~alone], cell[~alone], at[~alone]
        perm, classes = Sorter(data, LENGTH).order(at, cell)
        again = np.zeros(len(owner), bool)
        again[by[perm]] = np.bincount(classes)[classes] > 1 if len(classes) else False
        for i, found in zip(rows, np.split(again, np.cumsum(n)[:-1]), strict=True):
            starts[i] = starts[i] | found
    return [starts[j] for j in which]


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From surroundings sorted by ``h``: runs of repeated bytes. Works on whole groups, some megabytes at a time."""
    held: dict[str, list] = {k: [] for k in _ABOUT.names}
    size = 0

    def work(upto: int) -> pa.RecordBatch:
        out: dict[str, list] = {"id": [], "start": [], "end": []}
        flags = repeated_starts(held["h"][:upto], held["left"][:upto], held["about"][:upto])
        for row, start, f in zip(held["id"], held["start"], flags, strict=False):
            for a, z in _runs(f):
                out["id"].append(row), out["start"].append(start + a), out["end"].append(start + z - 1 + LENGTH)
        for k in held:
            del held[k][:upto]
        return pa.RecordBatch.from_pydict(out, _RUNS)

    for b in batches:
        for k, v in b.to_pydict().items():
            held[k] += v
        size += sum(map(len, held["about"][-b.num_rows :])) if b.num_rows else 0
        if size >= _CHUNK:
            last = held["h"][-1]
            upto = len(held["h"])
            while upto and held["h"][upto - 1] == last:
                upto -= 1
            if upto:
                yield work(upto)
            size = sum(map(len, held["about"]))
    if held["h"]:
        yield work(len(held["h"]))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _level(hold: DataFrame, texts: DataFrame, keys: DataFrame, width: int, deeper: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """Runs (id, start, end) of repeated strings among the pieces of ``hold``, and the places to be cut narrower, if any.

    ``hold``: id, text and anchors' hashes or places. ``texts``, ``keys``: the texts (key, text) as dealt, and the key of each id.
    """
    cut_up = cut(hold.mapInArrow(lambda b: _cut_up(b, width), _PIECES))
    own = cut_up.select("id", F.explode("runs").alias("r")).select("id", "r.start", "r.end")
    each = cut_up.select("id", F.explode("pieces").alias("p")).select("id", "p.*")
    kinds = cut(each.groupBy("c1", "c2", "s1", "s2").agg(F.sum("n").alias("n"), F.min("id").alias("id")))
    again = cut(kinds.filter("n > 1").select("s1", "s2"))
    whole = each.filter("n = 1").join(small(again), ["s1", "s2"]).select("id", (F.col("at") - F.col("most")).alias("start"), (F.col("at") - F.col("least") + LENGTH).alias("end"))
    meet = cut(kinds.groupBy("c1", "c2").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    first = cut(kinds.join(small(meet), ["c1", "c2"]).select("s1", "s2", "id", "kinds"))
    reps = cut(each.join(small(first), ["s1", "s2", "id"]).select("id", "at", "most", "least", "c1", "kinds"))

    def with_texts(some: DataFrame) -> DataFrame:
        places = some.groupBy("id").agg(F.collect_list(F.struct("at", "most", "least", "c1")).alias("places"))
        return texts.join(beside(cut(places.join(keys, "id"))), "key").select("id", "text", "places")

    about = with_texts(reps.filter(F.col("kinds") <= GROUP)).mapInArrow(_surroundings, "h long, id long, start int, left short, about binary")
    single = about.repartition("h").sortWithinPartitions("h").mapInArrow(_sorted, "id long, start int, end int")
    more = reps.filter(F.col("kinds") > GROUP)
    return [own, whole, single], with_texts(more) if deeper and not more.isEmpty() else None


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct texts as dealt (key, text, doc_id, copies), ``key, runs`` (start and end in bytes) of those that hold repeated strings, and ``key, copies``."""
    with scratch(docs.sparkSession) as s:
        one, copies = one_of_each(docs, "doc_id", "copies")
        s.keep(copies)
        texts = s.keep(dealt(one, "key"))
        found = texts.select("key", "text").mapInArrow(_anchored, "key string, h array<long>, n array<int>")
        found = cut(found.withColumn("id", F.monotonically_increasing_id()))
        each = found.select("id", F.explode(F.arrays_zip("h", "n")).alias("x")).select("id", "x.*")
        often = cut(each.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
        marked = cut(each.select("id", "h").join(small(often), "h").groupBy("id").agg(F.collect_list("h").alias("h")))
        keys = cut(marked.select("id").join(found.select("id", "key"), "id"))
        hold = texts.join(beside(cut(marked.join(keys, "id"))), "key").select("id", "text", "h")
        runs: list[DataFrame] = []
        for width in WIDTHS:
            some, hold = _level(hold, texts, keys, width, width > 1)
            runs += some
            if hold is None:
                break
        every = runs[0]
        for r in runs[1:]:
            every = every.unionByName(r)
        by_id = every.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
        return texts, s.keep(cut(keys.join(by_id, "id").select("key", "runs"))), copies


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for t, runs in zip(b.column("text"), b.column("runs").to_pylist(), strict=True):
            data = _bytes(t)
            spans = merged([(x["start"], x["end"]) for x in runs or []])
            parts, at = [], 0
            for s, e in spans:
                parts.append(data[at:s])
                at = e
            out["n_bytes"].append(len(data)), out["n_removed"].append(sum(e - s for s, e in spans)), out["n_spans"].append(len(spans)), out["kept"].append(b"".join([*parts, data[at:]]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())], ["doc_id", *out])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) of each row of ``docs`` (doc_id, text)."""
    texts, runs, copies = repeated(docs)
    alone = texts.filter("copies is null").join(beside(runs), "key", "left").select("doc_id", "text", "runs")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), size.alias("n_bytes"), F.when(size < LENGTH, F.col("text")).alias("short"))
    rest = rest.join(small(copies.select("key", "copies")), "key", "left").filter("key is null or copies is not null")
    whole = F.col("n_bytes") >= LENGTH
    copied = rest.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"), whole.cast("long").alias("n_spans"), F.coalesce("short", F.lit("")).cast("binary").alias("kept"))
    return alone.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").unionByName(copied)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

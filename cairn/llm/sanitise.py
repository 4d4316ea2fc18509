"""Personal data: base patterns, and information-theoretic sanitisation of terms that give them away.

The corpus says how strongly a term reveals an entity (an e-mail address, IP address, card or phone number): with
counts over distinct texts, PMI(t, e) = log2(n(t, e) N / (n(t) n(e))) is the information about e that t gives, and
IC(e) = log2(N / n(e)) all there is. A term whose share PMI / IC reaches ``DISCLOSES``, seen beside e in ``SUPPORT``
texts or more, is a span in every text that holds e: generalised, or removed from a share of ``REMOVES`` on.

Counts cover all texts. Pairs are aggregated before the shuffle, and only terms that can disclose, by the counts beside
entities, are counted through the corpus; each of a text's copies counts as its part of one. Terms reach a text by the entities it holds, in a join; nothing that grows is broadcast unchecked.

Defined cases: null and empty texts have no spans; copies of a text count once and get equal spans; an empty table
gives an empty result; other columns are kept by ``sanitised`` and ignored by the query.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import cut, read, scratch, small, text_key

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 8
#: Shorter words are no terms, so a name of two letters or characters never is.
LETTERS_LEAST = 3
SUPPORT = 3
DISCLOSES = 0.9
REMOVES = 0.98
LETTERS = "A-Za-zÀ-ɏͰ-῿぀-퟿"
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_EMAIL_REST = rf"{_LOCAL}++@{_HOST}+(?:\.{_HOST}+)+"
#: A local part only begins where its run of characters does, or where the last match ended; trying only there is linear.
_EMAIL, _EMAIL_HERE = re.compile(rf"(?<!{_LOCAL})" + _EMAIL_REST), re.compile(_EMAIL_REST)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_IP_HERE = re.compile(r"[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(f"[{LETTERS}]+")
_SPAN = "struct<kind:string,start:int,end:int>"
_PA_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _each(start: re.Pattern, here: re.Pattern, text: str) -> Iterator[re.Match]:
    at = 0
    while m := (here.match(text, at) if at else None) or start.search(text, at):
        yield m
        at = m.end()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    if not text:
        return []
    out = [("email", m.start(), m.end()) for m in _each(_EMAIL, _EMAIL_HERE, text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _each(_IP, _IP_HERE, text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(c for c in value if c.isdigit())}"


def _within(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Tells whether a stretch has a place in common with any span: the furthest end of those that begin before its end tells."""
    starts = sorted(spans)
    upto = list(accumulate((e for _, e in starts), max))

    def of(a: int, z: int) -> bool:
        k = bisect_left(starts, (z,))
        return k > 0 and upto[k - 1] > a

    return of


def beside(text: str, spans: list[tuple[str, int, int]], window: int = WINDOW) -> list[tuple[str, str]]:
    """(entity, term) for the words within ``window`` words of a span, however far, but spans themselves and short words."""
    within = _within([(s, e) for _, s, e in spans])
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    out = set()
    for kind, s, e in spans:
        name = entity(kind, text[s:e])
        last, first = bisect_right(ends, s), bisect_left(starts, e)
        for a, z in words[max(0, last - window) : last] + words[first : first + window]:
            if z - a >= LETTERS_LEAST and not within(a, z):
                out.add((name, text[a:z].lower()))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
    for b in batches:
        spans, entities, pairs = [], [], []
        for t in b.column("text"):
            text = t.as_py()
            found = base_spans(text)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            entities.append(sorted({entity(k, text[s:e]) for k, s, e in found}))
            pairs.append([{"entity": x, "term": y} for x, y in beside(text, found)] if found else [])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(spans, pa.list_(_PA_SPAN)), pa.array(entities, pa.list_(pa.string())), pa.array(pairs, pair)], ["doc_id", "key", "spans", "entities", "pairs"])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, key, spans, entities, pairs`` of each row of ``docs`` (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    return keyed.mapInArrow(_scan, f"doc_id long, key string, spans array<{_SPAN}>, entities array<string>, pairs array<struct<entity:string,term:string>>")


def disclosing(docs: DataFrame, scanned: DataFrame, support: int = SUPPORT, discloses: float = DISCLOSES) -> DataFrame:
    """``entity, term, share`` of the terms that disclose an entity, from all of ``docs``."""
    copies = cut(scanned.filter("key is not null").groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1"))
    total = cut(scanned.filter("key is not null").agg(F.countDistinct("key").cast("double").alias("n")))
    texts = scanned.filter("key is not null and size(entities) > 0")
    n_e = texts.select(F.explode("entities").alias("entity"), "key").groupBy("entity").agg(F.countDistinct("key").alias("n_e")).filter(F.col("n_e") >= support)
    each = texts.select(F.explode("pairs").alias("p"), "key").select("p.entity", "p.term", "key")
    pairs = each.groupBy("entity", "term").agg(F.countDistinct("key").alias("n_te")).filter(F.col("n_te") >= support)
    # A term is in at least the texts where it is beside any entity; most common words can't disclose by that alone.
    least = each.groupBy("term").agg(F.countDistinct("key").alias("n_least"))
    bound = F.col("n_te") * F.pow(F.col("n") / F.col("n_e"), 1 - discloses) * (1 + 1e-9)
    found = pairs.join(n_e, "entity").join(least, "term").crossJoin(F.broadcast(total))  # one row
    found = cut(found.filter(F.col("n_least") <= bound).drop("n_least"))
    terms = cut(found.select("term").distinct())
    ws = F.array_distinct(F.transform(F.split(F.col("text"), f"[^{LETTERS}]+"), F.lower))
    share_of = docs.select(text_key(F.col("text")).alias("key"), "text").join(small(copies), "key", "left")
    rows = share_of.select(F.coalesce(1.0 / F.col("copies"), F.lit(1.0)).alias("one"), F.explode(ws).alias("term"))
    n_t = rows.join(small(terms), "term").groupBy("term").agg(F.round(F.sum("one")).alias("n_t"))
    scored = found.join(n_t, "term")
    share = F.log2(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e"))) / F.log2(F.col("n") / F.col("n_e"))
    return scored.filter("n_e < n").select("entity", "term", share.alias("share")).filter(F.col("share") >= discloses)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, base, terms in zip(b.column("text"), b.column("spans").to_pylist(), b.column("terms").to_pylist(), strict=True):
            text, shares = t.as_py(), {}
            for x in terms:
                shares[x["term"]] = max(x["share"], shares.get(x["term"], 0))
            within = _within([(x["start"], x["end"]) for x in base])
            spans = []
            for m in _WORD.finditer(text):
                share = shares.get(m[0].lower())
                if share is not None and not within(m.start(), m.end()):
                    spans.append({"start": m.start(), "end": m.end(), "removed": share >= REMOVES})
            out.append(spans)
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("removed", pa.bool_())])))], ["key", "found"])


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scan, and ``key, found`` (spans of disclosing terms) of the texts that have any."""
    scanned = cut(scan(docs))
    shares = cut(disclosing(docs, scanned))
    held = scanned.filter("size(entities) > 0").select("key", "spans", F.explode("entities").alias("entity")).join(small(shares), "entity")
    wanted = cut(held.groupBy("key").agg(F.first("spans").alias("spans"), F.collect_set(F.struct("term", "share")).alias("terms")))
    texts = docs.select(text_key(F.col("text")).alias("key"), "text").join(small(wanted), "key")
    found = cut(texts.mapInArrow(_find, "key string, found array<struct<start:int,end:int,removed:boolean>>"))
    return scanned, found.dropDuplicates(["key"])


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, base, found in zip(b.column("text").to_pylist(), b.column("_cairn_spans").to_pylist(), b.column("_cairn_found").to_pylist(), strict=True):
            cuts = sorted([(x["start"], -x["end"], f"[{x['kind'].upper()}]") for x in base or []] + [(x["start"], -x["end"], "" if x["removed"] else "[TERM]") for x in found or []])
            if cuts:
                parts, at = [], 0
                for s, e, by in cuts:
                    if s >= at:
                        parts += [t[at:s], by]
                    at = max(at, -e)
                t = "".join([*parts, t[at:]])
            out.append(t)
        names = [n for n in b.schema.names if not n.startswith("_cairn_")]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else b.column(n) for n in names], names)


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind, and disclosing terms generalised or removed."""
    with scratch(docs.sparkSession) as held:
        scanned, found = spans(docs.select("doc_id", "text"))
        base = scanned.filter("size(spans) > 0").groupBy("key").agg(F.first("spans").alias("_cairn_spans"))
        cuts = held.keep(cut(base.join(found.select("key", F.col("found").alias("_cairn_found")), "key", "left").withColumnRenamed("key", "_cairn_key")))
    joined = docs.join(small(cuts), text_key(F.col("text")) == F.col("_cairn_key"), "left").drop("_cairn_key")
    return joined.mapInArrow(_replaced, docs.schema)


def op10_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, found = spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    both = scanned.select("doc_id", "key", "spans").join(small(found), "key", "left")
    written = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    terms = F.transform(F.coalesce("found", F.array()), lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return both.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(F.concat("spans", terms)).alias("spans"))

"""Benchmark decontamination by a distributed positional inverted index.

``Postings`` is the index: a row (text key, position, term, hash of the next term) for each training token that a test
phrase has, written once, from one tokenisation of each distinct text. ``phrase_hits`` starts from the list of each
phrase's rarest term that has a successor in the phrase, keeps the places where that follows, and intersects their
offset-adjusted list with those of all other terms. ``proximity_hits`` finds all of a phrase's terms, in any order, within
a given number of words of that term.

Scale: postings are made where the text is read and not shuffled; terms are counted with a partial aggregate. Lists are
intersected by (key, position), which no common term makes hot, and only those of texts that have a place left. The
shorter side is broadcast once its summed size fits a bound, and is otherwise joined by a shuffle. Copies of a text are indexed once.

Defined cases: null or empty texts and items have no words and hit nothing; an item of under ten words is one phrase;
an item without an id hits but is not named or counted;
rows are matched by their text, so repeated ids and rows each get their own result; empty tables give no hits; other
columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.shared import cut, let, one_of_each, read, scratch, small, text_key

WINDOW = 10
#: What lies between words: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(w: Column) -> Column:
    return F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, string.ascii_uppercase, string.ascii_lowercase))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``phrase`` (array of words) and ``item_ids`` of the distinct windows of ``items`` (item_id, text)."""
    ws = items.select("item_id", F.transform(tokens(F.col("text")), lower_ascii).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    each = ws.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("phrase"))
    return each.groupBy("phrase").agg(F.collect_set("item_id").alias("item_ids"))


def followed(ws: Column) -> Column:
    """Each of ``ws`` as ``term``, and as ``next`` a hash of the one after it; null for the last."""
    after = lambda w, i: F.when(i < F.size(w) - 1, F.hash(F.get(w, i + 1)))
    return let(ws, lambda w: F.transform(w, lambda x, i: F.struct(x.alias("term"), after(w, i).alias("next"))))


@dataclass
class Postings:
    """``lists``: key, pos, tid, next. ``phrases``: pid, n (words), item_ids. ``places``: pid, offset, tid, next, rank (0: the start)."""

    lists: DataFrame
    phrases: DataFrame
    places: DataFrame


def anchors(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> Postings:
    """The index of ``docs`` (doc_id, text) for the phrases of ``items``."""
    ps = cut(phrases(items, window).withColumn("pid", F.monotonically_increasing_id()))
    each = ps.select("pid", F.posexplode(followed(F.col("phrase"))).alias("offset", "x")).select("pid", "offset", "x.*")
    terms = cut(each.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    one, _ = one_of_each(docs)
    tokens_ = one.select("key", F.posexplode(followed(F.transform(tokens(F.col("text")), lower_ascii))).alias("pos", "x")).select("key", "pos", "x.*")
    lists = cut(tokens_.join(small(terms), "term").select("key", "pos", "tid", "next"))
    counted = cut(terms.join(small(cut(lists.groupBy("tid").agg(F.count("*").alias("n")))), "tid", "left").select("tid", "term", F.coalesce("n", F.lit(0)).alias("n")))
    rank = F.row_number().over(W.partitionBy("pid").orderBy(F.col("next").isNull(), "n", "offset")) - 1
    places = cut(each.join(small(counted), "term").select("pid", "offset", "tid", "next", rank.alias("rank")))
    return Postings(lists, cut(ps.select("pid", F.size("phrase").alias("n"), "item_ids")), places)


def rarest(index: Postings) -> DataFrame:
    """``pid, key, pos, start, next, follows``: the places of the term that each phrase starts from, where the phrase would
    start, and the hashes of what follows and should follow."""
    first = cut(index.places.filter("rank = 0").select("pid", "offset", "tid", F.col("next").alias("follows")))
    return index.lists.join(small(first), "tid").select("pid", "key", "pos", (F.col("pos") - F.col("offset")).alias("start"), "next", "follows")


def phrase_hits(docs: DataFrame, index: Postings) -> DataFrame:
    """``key, start, end, item_ids``: each occurrence of a phrase as consecutive words, ``end`` exclusive."""
    at = cut(rarest(index).filter("start >= 0 and (follows is null or next = follows)").select("pid", "key", "start"))
    texts = cut(at.select("key").distinct())
    others = cut(index.places.filter("rank > 0").select("pid", "offset", "tid"))
    want = cut(at.join(small(others), "pid").select("pid", "key", "start", (F.col("start") + F.col("offset")).alias("pos"), "tid"))
    lists = index.lists.select("key", "pos", "tid").join(small(texts), "key")
    met = lists.join(small(want), ["key", "pos", "tid"]).groupBy("pid", "key", "start").agg(F.count("*").alias("met"))
    phrases_ = small(index.phrases)
    alone = at.join(phrases_, "pid").filter("n = 1")
    whole = met.join(phrases_, "pid").filter("met = n - 1").drop("met")
    return alone.unionByName(whole).select("key", "start", (F.col("start") + F.col("n")).alias("end"), "item_ids")


def proximity_hits(docs: DataFrame, index: Postings, within: int) -> DataFrame:
    """``key, start, end, item_ids``: stretches about a rarest term with all terms of a phrase at most ``within`` words from it.

    ``start`` and ``end`` bound the terms found.
    """
    distinct = cut(index.places.select("pid", "tid").distinct())
    terms = distinct.groupBy("pid").agg(F.count("*").alias("terms"))
    at = cut(rarest(index).select("pid", "key", "pos").distinct().withColumnRenamed("pos", "at").join(small(distinct), "pid"))
    near = index.lists.join(small(at), ["key", "tid"]).filter(F.abs(F.col("pos") - F.col("at")) <= within)
    found = near.groupBy("pid", "key", "at").agg(F.count_distinct("tid").alias("met"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    whole = found.join(small(cut(terms)), "pid").filter("met = terms")
    return whole.join(small(index.phrases), "pid").select("key", "start", "end", "item_ids").distinct()


def covered(hits: DataFrame) -> DataFrame:
    """``_cairn_key, n_hit, items``: words of a text inside any hit, and the items that hit it, sorted as strings.

    Hits of a text are put in order to count overlaps once; their number is bounded by the text's own length.
    """
    spans = hits.groupBy("key", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(W.partitionBy("key").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    n = spans.select("key", fresh.alias("n")).groupBy("key").agg(F.sum("n").alias("n_hit"))
    who = hits.select("key", F.explode("item_ids").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    return n.join(who, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumnRenamed("key", "_cairn_key")


def hit_texts(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """What ``covered`` says of the texts of ``docs`` that have any hit."""
    with scratch(docs.sparkSession) as s:
        return s.keep(cut(covered(cut(phrase_hits(docs, anchors(docs, items, window))))))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``n_words, n_hit, items, contaminated``, in place of columns of those names."""
    docs = docs.drop("n_words", "n_hit", "items", "contaminated", "_cairn_key")
    found = hit_texts(docs, items, window)
    marked = docs.withColumn("n_words", F.size(tokens(F.col("text"))).cast("long")).join(small(found), text_key(F.col("text")) == F.col("_cairn_key"), "left").drop("_cairn_key")
    return marked.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>")), "contaminated": F.coalesce(F.col("n_hit") > 0, F.lit(False))})


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP5_SQL = f"""
WITH b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), p AS (
  SELECT item_id, list_slice(w, i, least(i + 9, len(w))) AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), lengths AS (SELECT DISTINCT len(phrase) AS n FROM p
), hits AS (
  SELECT r, i, n, item_id FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n) g
  JOIN p ON list_slice(g.w, g.i, g.i + g.n - 1) = p.phrase
), n AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r
), who AS (
  SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN who USING (r)
"""

"""Quality rules with thresholds that adapt to each language and source.

Every document gets counts, and from them rates in whole parts per million. A rate's distribution is sketched per
language and source as a histogram over log-spaced bins, whose bounds are integers of ``BITS`` leading bits: such
sketches are of bounded size, merge by adding counts, are built before the shuffle, and know each quantile to within
one part in 2 ** (``BITS`` - 1). A rule names the tail it judges by: the quantile of its group below which a rate is
usual. A document fails if its rate lies above ``SPREAD`` times that; there is no cutoff that all groups share. Sketches
of under ``LEAST`` documents are widened by merging: the language's sketch is used, then the whole corpus's.

The thresholds' table has a row for each language and source, and is broadcast only after its size was summed.

Defined cases: null text has no words and fails the base rules; null language or source forms a group of its own;
repeated rows count each; a rate of 0 never fails; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.shared import SPACE, cut, let, read, small, words

#: Rate: numerator, denominator, and the tail's quantile in thousandths.
RATES = {
    "symbols": ("n_symbols", "word_chars", 900),
    "shouting": ("n_exclaims", "word_chars", 990),
    "dup_lines": ("n_dup_lines", "n_lines", 995),
    "repeats": ("n_repeat_words", "n_words", 995),
}
BITS = 6
SPREAD = 1.5
LEAST = 200


def bin_of(rate: str) -> str:
    """SQL for the greatest rate in the bin of ``rate``, in Spark."""
    return f"({rate}) | (shiftleft(1L, greatest(0, length(bin({rate})) - {BITS})) - 1)"


def repeat_words(ws: Column) -> Column:
    """Words inside a 3-word window that the text has twice or more, the first time included.

    Windows are sorted by a 64-bit hash within the row, and equal neighbours kept: n log n for a text of n words.
    """
    n = F.size(ws)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(ws[i], ws[i + 1], ws[i + 2]).alias("h"), i.alias("i")))

    def count(s: Column) -> Column:
        twin = lambda i: ((i > 0) & (F.get(s, i - 1)["h"] == s[i]["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == s[i]["h"]))
        at = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(twin(i), F.lit(False))), lambda i: s[i]["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(F.array_sort(grams), count))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts that the rules need, in place of columns of those names."""
    docs = docs.drop("_w", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "base_failed", "failed", "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    with_words = docs.withColumn("_w", words(F.col("text")))
    return with_words.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^!]+", "")).cast("long").alias("n_exclaims"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(counted: DataFrame) -> DataFrame:
    """``counted`` with ``base_failed``, ``failed`` (names of the adaptive rules that fail) and ``kept``."""
    rated = counted
    for name, (over, under, _) in RATES.items():
        rated = rated.withColumn(f"_{name}", F.when(F.col(under) > 0, F.expr(f"{over} * 1000000 div {under}")).otherwise(0).cast("long"))
    long = rated.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.expr(bin_of(f"_{k}")).alias("bin")) for k in RATES])).alias("x"))
    sketch = cut(long.groupBy("lang", "source", "x.rule", "x.bin").agg(F.count("*").alias("n")))
    table = cut(thresholds(sketch))
    at = rated.join(small(table), F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    failed = F.filter(F.array(*[F.when(F.col(f"_{k}") > F.col(f"t_{k}"), F.lit(k)) for k in RATES]), lambda x: x.isNotNull())
    out = at.withColumn("base_failed", base_failed()).withColumn("failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select(*counted.columns, "base_failed", "failed", "kept")


def thresholds(sketch: DataFrame) -> DataFrame:
    """``t_lang, t_source`` and a threshold in parts per million for each rate, from mergeable sketches."""
    tail = F.create_map(*[x for k, (_, _, v) in RATES.items() for x in (F.lit(k), F.lit(v))])
    levels = []
    for k, keys in enumerate((["lang", "source", "rule"], ["lang", "rule"], ["rule"])):
        merged = sketch.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        w = W.partitionBy(*keys)
        ranked = merged.withColumn("through", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
        usual = F.min(F.when(F.col("through") * 1000 >= F.col("total") * tail[F.col("rule")], F.col("bin")))
        levels.append(ranked.groupBy(*keys).agg(usual.alias(f"q_{k}"), F.first("total").alias(f"n_{k}")))
    groups = levels[0]
    for k, keys in ((1, ["lang", "rule"]), (2, ["rule"])):
        wide = levels[k].select(*[F.col(x).alias(f"k{k}_{x}") for x in keys], f"q_{k}", f"n_{k}")
        cond = F.lit(True)
        for x in keys:
            cond = cond & F.col(x).eqNullSafe(F.col(f"k{k}_{x}"))
        groups = groups.join(wide, cond)
    pick = F.when(F.col("n_0") >= LEAST, F.col("q_0")).when(F.col("n_1") >= LEAST, F.col("q_1")).otherwise(F.col("q_2"))
    by = groups.select("lang", "source", "rule", (pick * SPREAD).alias("limit"))
    return by.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*[F.max(F.when(F.col("rule") == k, F.col("limit"))).alias(f"t_{k}") for k in RATES])


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = cut(counts(docs).drop("text"))
    return judge(counted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed").alias("failed"))


_TAILS = "CASE rule " + " ".join(f"WHEN '{k}' THEN {v}" for k, (_, _, v) in RATES.items()) + " END"
OP2_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g
), p AS (
  SELECT r, i + unnest([0, 1, 2]) AS j FROM h WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words FROM p GROUP BY r
), c AS (
  SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims
  FROM w LEFT JOIN rep USING (r)
), rates AS (
  {" UNION ALL ".join(f"SELECT r, lang, source, '{k}' AS rule, CASE WHEN {d} > 0 THEN {n} * 1000000 // {d} ELSE 0 END AS rate FROM c" for k, (n, d, _) in RATES.items())}
), ranked AS (
  SELECT *, rate | ((CAST(1 AS BIGINT) << greatest(0, length(bin(rate)) - {BITS})) - 1) AS bin, {_TAILS} AS tail,
         row_number() OVER a AS k0, count(*) OVER a0 AS n0, row_number() OVER b AS k1, count(*) OVER b0 AS n1, row_number() OVER e AS k2, count(*) OVER e0 AS n2
  FROM rates WINDOW a AS (PARTITION BY lang, source, rule ORDER BY rate), a0 AS (PARTITION BY lang, source, rule),
    b AS (PARTITION BY lang, rule ORDER BY rate), b0 AS (PARTITION BY lang, rule), e AS (PARTITION BY rule ORDER BY rate), e0 AS (PARTITION BY rule)
), q AS (
  SELECT *, min(CASE WHEN k0 * 1000 >= n0 * tail THEN bin END) OVER g0 AS q0, min(CASE WHEN k1 * 1000 >= n1 * tail THEN bin END) OVER g1 AS q1,
         min(CASE WHEN k2 * 1000 >= n2 * tail THEN bin END) OVER g2 AS q2
  FROM ranked WINDOW g0 AS (PARTITION BY lang, source, rule), g1 AS (PARTITION BY lang, rule), g2 AS (PARTITION BY rule)
), bad AS (
  SELECT r, rule FROM q WHERE rate > {SPREAD} * CASE WHEN n0 >= {LEAST} THEN q0 WHEN n1 >= {LEAST} THEN q1 ELSE q2 END
), fails AS (
  SELECT r, string_agg(rule, ',' ORDER BY CASE rule {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(RATES))} END) AS failed FROM bad GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND failed IS NULL AS kept, coalesce(failed, '') AS failed
FROM c LEFT JOIN fails USING (r)
"""

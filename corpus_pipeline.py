"""A training corpus from ``documents``: what is toxic goes, near duplicates are one, benchmark leaks go, personal data
is replaced, and sources are mixed to target weights.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of ``docs``; the last one
adds ``copy``, from 1, with a row for each copy in the mix. ``run`` writes and reads again what each stage returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontam, mixing, ngram_join, sanitise, toxicity
from cairn.llm.shared import cut, read, scratch, small, text_key


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score of ``toxicity.CUT`` or more go."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id, ties by text.

    Texts without words are no duplicates of each other. Of repeated rows one stays.
    """
    with scratch(spark) as held:
        classes = cut(ngram_join.join(docs))
        many = classes.filter("class_size > 1")
        least = cut(many.groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("least")))
        gone = many.join(small(least), "class").filter(~F.struct("doc_id", "key").eqNullSafe(F.col("least")))
        gone = held.keep(cut(gone.select(F.col("doc_id").alias("_cairn_id"), F.col("key").alias("_cairn_key")).distinct()))
        twice = classes.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1")
        twice = held.keep(cut(twice.select(F.col("doc_id").alias("_cairn_id"), F.col("key").alias("_cairn_key"))))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("_cairn_id")) & text_key(F.col("text")).eqNullSafe(F.col("_cairn_key"))
    kept = docs.join(small(gone), mine, "left_anti")
    once = kept.join(small(twice), mine, "left_anti")
    return once.unionByName(kept.join(small(twice), mine, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a shorter item whole, go."""
    hit = decontam.hit_texts(docs, read(spark, sf_dir, "benchmark")).select("_cairn_key")
    return docs.join(small(hit), text_key(F.col("text")) == F.col("_cairn_key"), "left_anti")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows."""
    clean = sanitise.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document."""
    plan = mixing.mix(docs).groupBy("doc_id", "source", "tie").agg(F.sum("copies").alias("_cairn_copies"), F.count("*").alias("_cairn_n"))
    plan = cut(plan.withColumnsRenamed({"doc_id": "_cairn_id", "source": "_cairn_source", "tie": "_cairn_tie"}).filter("_cairn_copies > 0"))
    mine = F.col("doc_id").eqNullSafe(F.col("_cairn_id")) & F.col("source").eqNullSafe(F.col("_cairn_source")) & F.md5("text").eqNullSafe(F.col("_cairn_tie"))
    taken = docs.join(small(plan), mine)
    once = taken.filter("_cairn_n = 1").unionByName(taken.filter("_cairn_n > 1").dropDuplicates(["doc_id", "source", "text"]))
    rest = [c for c in docs.columns if c != "copy"]
    return once.select(*rest, F.explode(F.sequence(F.lit(1), F.col("_cairn_copies").cast("int"))).alias("copy"))


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("decontamination", decontaminated), ("personal data", private), ("mixing", mixed)]
#: Nearest neighbours, MinHash and sanitisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as held:
            docs = held.keep(cut(stage(spark, docs, sf_dir)))
    return docs

"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest table, in bytes as counted, that an operator broadcasts.
BROADCAST_BYTES = 32 << 20
#: White space between words, as a character class.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs in one process."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_scratches: list[scratch] = []


class scratch:
    """While it is open, what ``cut`` writes is noted; at its end all of that is deleted but what ``keep`` was called on."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, as ``cut`` returned it, outlives this; a scratch around it has it next."""
        self.kept.add(df._cairn_at)
        return df

    def __enter__(self) -> scratch:
        _scratches.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scratches.remove(self)
        for at in self.made:
            if at not in self.kept:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            elif _scratches:
                _scratches[-1].made.append(at)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if _scratches:
        _scratches[-1].made.append(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._cairn_at = at
    return out


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` written to the shared folder in buckets by ``key`` and read again: a join by it moves the other side only.

    The rows of a key share a task, so keys should be distinct or nearly so.
    """
    spark = df.sparkSession
    name = f"cairn_{uuid.uuid4().hex}"
    at, n = f"{shared_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", at).saveAsTable(name)
    if _scratches:
        _scratches[-1].made.append(at)
    out = spark.table(name)
    out.schema  # resolved, so the name is not needed any more; the files stay
    spark.sql(f"DROP TABLE {name}")
    out._cairn_at = at
    return out


def beside(df: DataFrame) -> DataFrame:
    """``df`` to be joined to what ``dealt`` returned: broadcast if ``small``, else dealt alike and hashed, so texts are neither moved nor sorted."""
    out = small(df)
    return df.hint("shuffle_hash") if out is df else out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once for a row however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """The runs of characters other than white space; no words in null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, summed by their real sizes, fit in ``limit`` bytes; else as it is, for a shuffled join.

    ``df`` should be cheap to read twice, such as one that ``cut`` returned.
    """

    def width(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return 16 + F.coalesce(F.octet_length(field.name), F.lit(0))
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return 16 + F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0))
        return F.lit(8)

    size = df.agg(F.sum(sum((width(f) for f in df.schema), F.lit(32)).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df


def text_key(text: Column) -> Column:
    """Names a text by its content; null for null."""
    return F.md5(text)


def one_of_each(docs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """``key, text`` and of ``more`` what is asked of doc_id and copies (null if there is one), with a row for each text of ``docs`` (doc_id, text) that is not null, and ``key, copies, rep, most`` of those that come twice or more.

    The second is written, the first is lazy. Texts with copies are told by the least id; only rows repeated with their
    id are shuffled, and those as one row of a text from each task.
    """
    keyed = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    rows = keyed.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    copies = cut(rows.groupBy("key").agg(F.sum("n").alias("copies"), F.min("doc_id").alias("rep"), F.max("n").alias("most")).filter("copies > 1"))
    one = keyed.join(small(copies), "key", "left").filter("copies is null or doc_id <=> rep")
    if not copies.filter("most > 1").isEmpty():
        one = one.filter("most is null or most = 1").unionByName(one.filter("most > 1").dropDuplicates(["key"]))
    return one.select("key", "text", *more), copies

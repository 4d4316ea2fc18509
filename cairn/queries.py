"""Queries over the driver's tables, each with SQL that gives the same rows.

``a_`` queries apply operators to driver tables directly. ``b_`` queries build an image from ``documents`` (path
/lang/source/id.txt, content the text), read it back through the data source, and answer from it. The image is built
once for each folder of tables and variant.
"""

from __future__ import annotations

import functools
import hashlib
import os
import tarfile
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.fixtures import builder, spread
from cairn.functions import columns as fn
from cairn.operators import joins, tree, windows
from cairn.plans.cut import cut, shared_dir
from cairn.plans.image import ImageFrame
from cairn.sinks import export, extract


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- operators over driver tables

_MODE = "CASE o_orderkey % 8 WHEN 0 THEN 16877 WHEN 1 THEN 33188 WHEN 2 THEN 41471 WHEN 3 THEN 8576 WHEN 4 THEN 24960 WHEN 5 THEN 4480 WHEN 6 THEN 49645 ELSE 511 END"


def mode_kind(spark: SparkSession, d: str) -> DataFrame:
    modes = _read(spark, d, "orders").select(F.expr(_MODE).alias("mode"))
    return modes.groupBy(fn.mode_kind(F.col("mode")).alias("kind"), fn.permissions(F.col("mode")).cast("long").alias("perm")).agg(F.count("*").alias("n"))


def prefix_sum_u32(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "customer").select((F.col("c_custkey") - 1).alias("idx"), (F.col("c_custkey") * 7919 % 99991 * 40000).alias("delta"))
    low = rows.agg(F.min("idx").alias("low"))
    return windows.prefix_sum(rows.crossJoin(F.broadcast(low)).withColumn("idx", F.col("idx") - F.col("low")).drop("low"), "idx", "delta", "total", bucket=1024).select("idx", "total")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    lines = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("idx"), F.col("l_quantity").cast("long").alias("len"))
    return windows.chunk_ends(lines, "file", "idx", "len")


def chunk_ends(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).groupBy("file").agg(F.max("end").alias("size"), F.sum("start").alias("starts"), F.count("*").alias("chunks"))


def range_read(spark: SparkSession, d: str) -> DataFrame:
    met = windows.overlapping(_chunks(spark, d), F.lit(50), F.lit(100))
    return met.groupBy("file").agg(F.sum("take").alias("bytes"), F.sum("skip").alias("skipped"))


def hole_length(spark: SparkSession, d: str) -> DataFrame:
    p = _read(spark, d, "part")
    offset = F.when(F.col("p_partkey") % 5 == 0, F.lit(fn.U32)).otherwise(F.col("p_partkey") % 4096)
    block = (F.col("p_partkey") % 3).cast("long")
    length = fn.chunk_length(block, offset, F.col("p_size").cast("long"), F.lit(1).cast("long"), F.lit(65536), F.col("p_partkey") * 1000)
    return p.select(F.col("p_partkey").alias("idx"), block.alias("block"), length.alias("len"))


def rle_expand(spark: SparkSession, d: str) -> DataFrame:
    return windows.rle_expand(_read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), (F.col("n_nationkey") % 3).cast("long").alias("k")), "idx", "k", "slot", "group")


def dict_join(spark: SparkSession, d: str) -> DataFrame:
    nation = joins.looked_up(_read(spark, d, "nation"), "n_regionkey", _read(spark, d, "region"), "r_regionkey", "r_name", "region", "region out of range", "string")
    both = joins.looked_up(_read(spark, d, "customer"), "c_nationkey", nation, "n_nationkey", "region", "region", "nation out of range", "string")
    return both.groupBy("region").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def _by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    at = docs.select("source", "n", F.expr("cast(substring(source, 4) as long)").alias("inode"))
    return windows.prefix_sum(at, "inode", "n", "end", None).withColumn("first_entry", F.col("end") - F.col("n"))


def dir_extents(spark: SparkSession, d: str) -> DataFrame:
    dirs = _by_source(spark, d)
    total = _read(spark, d, "documents").count()
    return joins.extents(dirs.select("inode", "first_entry", "source"), total).select("source", "first_entry", "next_entry")


def walk_tree(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select(F.decode("path", "UTF-8").alias("path"), "kind", F.col("depth").cast("long").alias("depth"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    r, n, s = (_read(spark, d, t) for t in ("region", "nation", "supplier"))
    name = lambda c: F.encode(F.translate(F.col(c), "/ ", "__"), "UTF-8").alias("name")
    col = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")
    rows = r.select(col(0).alias("parent"), col(F.col("r_regionkey") + 1).alias("inode"), name("r_name"), F.lit("directory").alias("kind"))
    rows = rows.unionByName(n.select(col(F.col("n_regionkey") + 1).alias("parent"), col(F.col("n_nationkey") + 100).alias("inode"), name("n_name"), F.lit("directory").alias("kind")))
    rows = rows.unionByName(s.select(col(F.col("s_nationkey") + 100).alias("parent"), col(F.col("s_suppkey") + 1000).alias("inode"), name("s_name"), F.lit("regular").alias("kind")))
    root = spark.range(1).select(F.col("id").alias("inode"), F.lit("directory").alias("kind"))
    return tree.walk(rows.withColumn("entry", F.col("inode")), root, 200)


def lookup_paths(spark: SparkSession, d: str) -> DataFrame:
    asked = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wrong = F.when(F.col("n_nationkey") % 4 == 0, F.lit("x")).otherwise(F.lit(""))
    paths = asked.select(F.concat(F.lit("//"), F.translate("r_name", "/ ", "__"), F.lit("//"), F.translate("n_name", "/ ", "__"), wrong, F.lit("/")).alias("path"))
    clean = F.concat_ws("", F.transform(fn.path_parts(F.col("path")), lambda x: F.concat(F.lit("/"), x)))
    found = _places(spark, d).select(F.col("path").alias("p"), "inode")
    return paths.join(found, F.encode(clean, "UTF-8") == F.col("p"), "left").select("path", "inode")


GLOBS = ["en/[0-4]*", "*/?[05]", "[d-e]?/1*"]


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    pages = _read(spark, d, "pages").select("page_id", path.alias("path"))
    return pages.filter(fn.glob_matches(F.encode("path", "UTF-8"), GLOBS))


def content_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", F.md5("text").alias("content"))
    written = joins.first_writers(docs.withColumn("name", F.col("doc_id").cast("string")), "content", "doc_id", "name")
    return written.select("doc_id", "writer", "is_writer")


def first_offsets(spark: SparkSession, d: str) -> DataFrame:
    events = _read(spark, d, "events").select(F.col("event_id").alias("inode"), F.col("event_type").alias("kind"))
    return joins.offsets_by_kind(events, {"click": ["click"], "bought": ["purchase", "buy"], "none": ["absent"]}, F.lit(1 << 40))


def section_summary(spark: SparkSession, d: str) -> DataFrame:
    from cairn.sinks.export import section_summary as summed

    rows = _read(spark, d, "events").select(F.col("event_type").alias("type"), F.octet_length("props").cast("long").alias("payload_len"))
    return summed(rows)


def categories_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return joins.first_seen(_read(spark, d, "events"), "event_type", "event_id")


def readdir_page(spark: SparkSession, d: str) -> DataFrame:
    names = _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("entry"), F.col("n_name").alias("name"))
    dots = spark.createDataFrame([(-2, "."), (-1, "..")], "entry long, name string")
    return joins.page(dots.unionByName(names), "entry", 1, 7).select("name", F.col("cookie").cast("long").alias("cookie"))


def rising_index(spark: SparkSession, d: str) -> DataFrame:
    docs = _by_source(spark, d).select("inode", "end")
    return windows.rising(docs, "inode", "end")


def device_numbers(spark: SparkSession, d: str) -> DataFrame:
    rdev = F.shiftleft(F.col("s_nationkey").cast("long"), 32) + F.col("s_suppkey")
    return _read(spark, d, "supplier").select("s_suppkey", fn.device_major(rdev).alias("major"), fn.device_minor(rdev).alias("minor"), fn.makedev(fn.device_major(rdev), fn.device_minor(rdev)).alias("dev"), fn.blocks512(F.col("s_suppkey")).alias("blocks"))


def timestamps(spark: SparkSession, d: str) -> DataFrame:
    when = fn.timestamp(F.lit(1_700_000_000).cast("long"), F.col("event_id"), F.lit(2).cast("long"))
    return _read(spark, d, "events").groupBy("event_type").agg(F.max(when).alias("last"), F.min(when).alias("first"))


# --- an image of the documents

VARIANTS = {
    "plain": {}, "packed": {"packed": True, "codec": "zstd", "metadata_codec": "zstd", "fsst": True}, "links": {"codec": "lz4"},
    "lzma": {"codec": "lzma", "metadata_codec": "lzma", "aligned": True}, "lz4": {"codec": "lz4", "metadata_codec": "lz4hc", "compact": False, "index": False},
    "brotli": {"codec": "brotli", "metadata_codec": "brotli", "packed": True, "prefix": b"#!/bin/sh\n" * 20000},
    "small": {"block_size": 1 << 14, "codec": "zstd", "categories": ["text", "audio", "text", "other"], "minor": 6},
    "special": {"times": (1, 2, 3), "resolution": 10, "uid": 1234, "gid": 77}, "large_holes": {"packed": True, "fsst": True, "large_holes": True},
}


def _folder(spark: SparkSession) -> str:
    """The shared folder as a path: images and what is extracted from them are files that executors open too."""
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"the queries on images need a shared folder that can be mounted, not {folder}")
    os.makedirs(unquote(folder), exist_ok=True)
    return unquote(folder)


def _documents_files(spark: SparkSession, d: str) -> DataFrame:
    """``folder, name, content`` of a file for each document."""
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "none").otherwise(F.col(c))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")), F.lit(".txt"))
    return _read(spark, d, "documents").select(F.concat_ws("\0", named("lang"), named("source")).alias("folder"), name.alias("name"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))


def _chats_links(spark: SparkSession, d: str) -> DataFrame:
    """``folder, name, target`` of a link for each turn of a conversation; of equal turns the greatest role counts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    turns = _read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("role"))
    return turns.select(F.lit("chats").alias("folder"), F.concat(text("conv_id"), F.lit("-"), text("turn")).alias("name"), F.concat(F.lit("../"), text("role"), F.lit("/"), text("conv_id")).alias("target"))


def _special_tree(spark: SparkSession, d: str) -> dict:
    """A device for each supplier, a file with two holes for each part, a file for each region with a hard link and a pipe for each of its nations."""
    out: dict = {"dev": {}, "holes": {}, "links": {}, "pipes": {}, "regions": {}}
    for r in _read(spark, d, "supplier").select("s_suppkey", "s_nationkey").toLocalIterator():
        out["dev"][f"s{r.s_suppkey}"] = builder.Device(r.s_nationkey << 32 | r.s_suppkey, r.s_suppkey % 2 == 0)
    for r in _read(spark, d, "part").select("p_partkey", "p_size").toLocalIterator():
        out["holes"][f"p{r.p_partkey}"] = builder.Holes((r.p_size * 1000, f"mid{r.p_partkey}".encode(), 1 + r.p_partkey % 7 * 100))
    for r in _read(spark, d, "region").toLocalIterator():
        out["regions"][f"r{r.r_regionkey}"] = r.r_name.encode()
    for r in _read(spark, d, "nation").toLocalIterator():
        out["links"][f"n{r.n_nationkey}"] = builder.Same(f"/regions/r{r.n_regionkey}")
        out["pipes"][f"c{r.n_nationkey}"] = builder.Fifo()
    return out


@functools.cache
def _image(at: str, d: str, variant: str) -> str:
    """Path of the image. That of the documents is written by the executors; the small ones with devices and holes by the driver."""
    spark = SparkSession.active()
    options = builder.Options(**{"block_size": 1 << 20, **VARIANTS[variant]})
    handle, path = tempfile.mkstemp(suffix=f"-{variant}.img", dir=_folder(spark))
    os.close(handle)
    if variant in ("special", "large_holes"):
        with open(path, "wb") as f:
            f.write(builder.build(_special_tree(spark, d), options))
    else:
        spread.write(_documents_files(spark, d), _chats_links(spark, d) if variant == "links" else None, path, _folder(spark), options)
    return path


@functools.cache
def _frame(at: str, d: str, variant: str, session: int) -> ImageFrame:
    return ImageFrame(SparkSession.active(), _image(at, d, variant))


def image_of(spark: SparkSession, d: str, variant: str) -> ImageFrame:
    return _frame(shared_dir(spark), d, variant, id(spark))


def walk_stat(spark: SparkSession, d: str) -> DataFrame:
    f = image_of(spark, d, "packed")
    files = f.tree.filter("kind = 'regular'").join(f.inode_attr, "inode")
    return files.select(F.col("path_text").alias("path"), "size", "mode", "mtime", "nlink", F.col("depth").cast("long").alias("depth"))


def sha256_files(spark: SparkSession, d: str) -> DataFrame:
    f = image_of(spark, d, "packed")
    return f.tree.filter("kind = 'regular'").join(f.checksums("sha256"), "inode").select(F.col("path_text").alias("path"), "digest")


def read_at(spark: SparkSession, d: str) -> DataFrame:
    f = image_of(spark, d, "plain")
    return f.tree.filter("kind = 'regular'").join(f.read_ranges(10, 50), "inode").select(F.col("path_text").alias("path"), F.lower(F.hex("data")).alias("data"))


def dedup(spark: SparkSession, d: str) -> DataFrame:
    groups = image_of(spark, d, "packed").content_groups()
    return groups.agg(F.count("*").alias("contents"), F.sum("files").alias("files"), F.sum("size").cast("long").alias("bytes"))


def symlink(spark: SparkSession, d: str) -> DataFrame:
    f = image_of(spark, d, "links")
    return f.tree.filter("kind = 'symlink'").join(f.symlinks, "inode").select(F.col("path_text").alias("path"), fn.text(F.col("target")).alias("target"))


def verify(spark: SparkSession, d: str) -> DataFrame:
    return image_of(spark, d, "packed").verified(deep=True)


def list_dirs(spark: SparkSession, d: str) -> DataFrame:
    f = image_of(spark, d, "packed")
    return f.tree.filter("kind = 'directory'").select(F.col("path_text").alias("path"), F.col("depth").cast("long").alias("depth"))


def glob_extract(spark: SparkSession, d: str) -> DataFrame:
    from cairn.sinks.extract import selected

    return selected(image_of(spark, d, "plain"), ["en/*/1*.txt"]).filter("kind = 'regular'").select(F.col("path_text").alias("path"))


def ndjson(spark: SparkSession, d: str) -> DataFrame:
    from cairn.sinks.export import metadata_lines

    lines = metadata_lines(image_of(spark, d, "plain"))
    return lines.select(F.get_json_object("value", "$.path").alias("path"), F.get_json_object("value", "$.kind").alias("kind"), F.get_json_object("value", "$.size").cast("long").alias("size")).filter("kind = 'regular'")


# --- codecs, attributes, holes, categories, listings, sinks and damage, through images


def sha256_of(variant: str) -> Callable[[SparkSession, str], DataFrame]:
    def digests(spark: SparkSession, d: str) -> DataFrame:
        f = image_of(spark, d, variant)
        return f.tree.filter("kind = 'regular'").join(f.checksums("sha256"), "inode").select(F.col("path_text").alias("path"), "digest")

    return digests


def special_stat(spark: SparkSession, d: str) -> DataFrame:
    f = image_of(spark, d, "special")
    return f.tree.select("inode", F.col("path_text").alias("path")).join(f.inode_attr, "inode").select("path", "kind", "mode", "uid", "gid", "size", "atime", "mtime", "ctime", "nlink", "rdev")


def hole_reads(spark: SparkSession, d: str) -> DataFrame:
    """A range that meets holes, and the digest of the whole file, where long holes are in a table of their own."""
    f = image_of(spark, d, "large_holes")
    files = f.tree.filter("path_text like '/holes/%'").join(f.read_ranges(9_990, 40), "inode").join(f.checksums("sha256"), "inode")
    return files.select(F.col("path_text").alias("path"), F.lower(F.hex("data")).alias("data"), "digest")


def walk_order(spark: SparkSession, d: str) -> DataFrame:
    """Paths with their places in the walk, numbered by partition, so no task has all of them."""
    number = F.monotonically_increasing_id()
    rows = cut(image_of(spark, d, "packed").tree.orderBy("place").select(F.col("path_text").alias("path"), F.shiftright(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("k")))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"))
    starts = windows.prefix_sum(parts, "part", "n", "end", None).select("part", (F.col("end") - F.col("n")).alias("start"))
    return rows.join(F.broadcast(starts), "part").select("path", (F.col("start") + F.col("k")).alias("place"))


def image_sections(spark: SparkSession, d: str) -> DataFrame:
    return image_of(spark, d, "small").sections.groupBy("type", "compression").agg(F.count("*").alias("sections"), F.min("ordinal").alias("first"), F.min("minor").cast("long").alias("minor"))


def section_index(spark: SparkSession, d: str) -> DataFrame:
    """Sections whose place in the index is the one they are found at, behind a prefix, by type."""
    f = image_of(spark, d, "brotli")
    base = f.table("image").select("base_offset", F.octet_length("header").cast("long").alias("prefix"))
    both = f.sections.join(f.table("section_index"), ["ordinal", "type_id"]).crossJoin(F.broadcast(base))
    return both.groupBy("type", "prefix").agg(F.every(F.col("file_offset") - F.col("base_offset") == F.col("offset_from_base")).alias("agree"))


def block_categories(spark: SparkSession, d: str) -> DataFrame:
    f = image_of(spark, d, "small")
    return f.block_categories.join(f.table("blocks").select("block", "size"), "block").select("block", "category", "size")


def image_summary(spark: SparkSession, d: str) -> DataFrame:
    s = export.summary(image_of(spark, d, "packed"))
    names = ("block_size", "inode_count", "total_fs_size", "symlink_offset", "file_offset", "shared_file_offset", "device_offset")
    return spark.createDataFrame([tuple(s[k] for k in names) + (",".join(sorted(s["options"])),)], ", ".join(f"{k} long" for k in names) + ", options string")


def image_readdir(spark: SparkSession, d: str) -> DataFrame:
    f = image_of(spark, d, "lzma")
    return f.read_dir_page(0, 1, 4).select(F.decode("name", "UTF-8").alias("name"), "kind", F.col("cookie").cast("long").alias("cookie"))


def image_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Sizes by path, asked with empty components; a third of the paths do not exist."""
    f = image_of(spark, d, "lz4")
    wrong = F.when(F.col("doc_id") % 3 == 0, F.lit("x")).otherwise(F.lit(""))
    asked = _read(spark, d, "documents").select(F.concat(F.col("lang"), F.lit("//"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"), wrong).alias("path"))
    return f.lookup(asked).join(f.sizes.select("inode", "size"), "inode", "left").select("path", "kind", "size")


@functools.cache
def _extracted(at: str, d: str, hardlink: bool) -> tuple[str, extract.ExtractStats]:
    spark = SparkSession.active()
    dest = f"{_folder(spark)}/cairn-out-{uuid.uuid4().hex}"
    return dest, extract.extract_all(image_of(spark, d, "small"), dest, extract.ExtractOptions(hardlink_shared=hardlink))


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for folder in (f for frame in frames for f in frame["folder"]):
        names = os.listdir(folder)
        for i in range(0, len(names), 10_000):
            yield pd.DataFrame({"file": [f"{folder}/{n}" for n in names[i : i + 10_000]]})


def _file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def extracted(spark: SparkSession, d: str) -> DataFrame:
    """The files that extraction wrote, read back from the folder; it is listed a directory at a time, by executors."""
    dest, _ = _extracted(shared_dir(spark), d, False)
    folders = [(f.path,) for top in os.scandir(dest) for f in os.scandir(top.path)]
    files = spark.createDataFrame(folders, "folder string").repartition("folder").mapInPandas(_listed, "file string").repartition("file")
    hashed = files.mapInPandas(lambda frames: (f.assign(digest=f["file"].map(_file_digest)) for f in frames), "file string, digest string")
    return hashed.select(F.regexp_extract("file", r"(/[^/]+/[^/]+/[^/]+)$", 1).alias("path"), "digest")


def extract_stats(spark: SparkSession, d: str) -> DataFrame:
    _, s = _extracted(shared_dir(spark), d, True)
    names = ("directories", "files", "symlinks", "hardlinks", "skipped", "errors")
    return spark.createDataFrame([tuple(getattr(s, k) for k in names)], ", ".join(f"{k} long" for k in names))


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, rows = ["place", "path", "size", "mode", "uid", "gid", "mtime", "digest"], []
    for path in (p for f in frames for p in f["path"]):
        with tarfile.open(path) as tar:
            for place, m in enumerate(tar):
                digest = hashlib.file_digest(tar.extractfile(m), "sha256").hexdigest() if m.isfile() else None
                rows.append((place, "/" + m.name, m.size, m.mode, m.uid, m.gid, int(m.mtime), digest))
                tar.members.clear()  # else each stays in memory
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    yield pd.DataFrame(rows, columns=columns)


@functools.cache
def _tar(at: str, d: str) -> str:
    path = f"{_folder(SparkSession.active())}/cairn-{uuid.uuid4().hex}.tar"
    extract.write_tar(image_of(SparkSession.active(), d, "packed"), path)
    return path


def tar_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of the archive in their order, as a reader of archives finds them."""
    path = spark.createDataFrame([(_tar(shared_dir(spark), d),)], "path string")
    return path.mapInPandas(_members, "place long, path string, size long, mode long, uid long, gid long, mtime long, digest string")


#: What is flipped: byte in the section, ordinal of the section. Section 0 is a block, 1 the schema.
FLIPS = {"payload of 0": (64, 0), "payload of 1": (66, 1), "digest of 0": (8, 0), "quick hash of 1": (0x28, 1), "number of 1": (0x30, 1), "type of 0": (0x34, 0), "magic of 1": (0, 1), "magic of the last": (0, 3), "version of 1": (6, 1), "length of the last": (0x3F, 3)}


def verify_broken(spark: SparkSession, d: str) -> DataFrame:
    """What each level of verification says of an image with one flipped bit: ok and first failure, or the error."""
    rows = []
    data = builder.build({"a": b"some text", "b": {"c": b"more"}}, builder.Options())
    starts = [0]
    for _ in range(3):
        starts.append(starts[-1] + 64 + int.from_bytes(data[starts[-1] + 56 : starts[-1] + 64], "little"))
    for name, (byte, section) in FLIPS.items():
        bad = bytearray(data)
        bad[starts[section] + byte] ^= 1
        path = f"{_folder(spark)}/cairn-{uuid.uuid4().hex}.img"
        with open(path, "wb") as f:
            f.write(bad)
        for deep in (False, True):
            try:
                r = ImageFrame(spark, path, 0).verified(deep).first()
                rows.append((name, deep, r.ok, r.first_failure, None))
            except Exception as e:  # noqa: BLE001
                known = [x for x in ("BadMagic", "UnsupportedVersion", "TruncatedSection", "TruncatedHeader") if x in str(e) or x == type(e).__name__]
                rows.append((name, deep, None, None, known[0] if known else str(e)))
        os.unlink(path)
    return spark.createDataFrame(rows, "flip string, deep boolean, ok boolean, first_failure long, error string")


QUERIES = {
    "a_mode_kind": mode_kind, "a_prefix_sum_u32": prefix_sum_u32, "a_chunk_ends": chunk_ends, "a_range_read": range_read, "a_hole_length": hole_length,
    "a_rle_expand": rle_expand, "a_dict_join": dict_join, "a_dir_extents": dir_extents, "a_walk_tree": walk_tree, "a_lookup_paths": lookup_paths,
    "a_glob_filter": glob_filter, "a_content_groups": content_groups, "a_first_offsets": first_offsets, "a_section_summary": section_summary,
    "a_categories_first_seen": categories_first_seen, "a_readdir_page": readdir_page, "a_rising_index": rising_index, "a_device_numbers": device_numbers,
    "a_timestamps": timestamps, "b_walk_stat": walk_stat, "b_sha256": sha256_files, "b_read_at": read_at, "b_dedup": dedup, "b_symlink": symlink,
    "b_verify": verify, "b_list_dirs": list_dirs, "b_glob_extract": glob_extract, "b_ndjson": ndjson,
    "b_sha256_lzma": sha256_of("lzma"), "b_sha256_lz4": sha256_of("lz4"), "b_sha256_brotli": sha256_of("brotli"), "b_special_stat": special_stat, "b_hole_reads": hole_reads,
    "b_walk_order": walk_order, "b_sections": image_sections, "b_section_index": section_index, "b_block_categories": block_categories, "b_summary": image_summary,
    "b_readdir": image_readdir, "b_lookup": image_lookup, "b_extract": extracted, "b_extract_stats": extract_stats, "b_tar": tar_members, "b_verify_broken": verify_broken,
}

_PATH = "'/' || lang || '/' || source || '/' || doc_id || '.txt'"
_PLACES = """
WITH RECURSIVE c AS (
  SELECT 0 AS parent, r_regionkey + 1 AS inode, translate(r_name, '/ ', '__') AS name, 'directory' AS kind FROM region
  UNION ALL SELECT n_regionkey + 1, n_nationkey + 100, translate(n_name, '/ ', '__'), 'directory' FROM nation
  UNION ALL SELECT s_nationkey + 100, s_suppkey + 1000, translate(s_name, '/ ', '__'), 'regular' FROM supplier
), t AS (
  SELECT CAST(0 AS BIGINT) AS inode, '' AS path, 'directory' AS kind, CAST(0 AS BIGINT) AS depth
  UNION ALL SELECT CAST(c.inode AS BIGINT), t.path || '/' || c.name, c.kind, t.depth + 1 FROM t JOIN c ON c.parent = t.inode
)
"""
_CHUNKS = """
WITH c AS (SELECT l_orderkey AS file, CAST(l_quantity AS BIGINT) AS len, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM lineitem)
"""
_DIRS = "SELECT '' AS path UNION SELECT '/' || lang FROM documents UNION SELECT '/' || lang || '/' || source FROM documents"
_DIGESTS = f"SELECT {_PATH} AS path, sha256(text) AS digest FROM documents"
_BLOCKS = "SELECT unnest(range(CAST(ceil(n / 16384) AS BIGINT))) AS block, n FROM (SELECT CAST(sum(strlen(t)) AS BIGINT) AS n FROM (SELECT DISTINCT text AS t FROM documents))"
_SPECIAL_KINDS = "(VALUES ('dev'), ('holes'), ('links'), ('pipes'), ('regions')) v(x)"
_HOLE_HEX = "repeat('00', p_size * 1000) || lower(hex(encode('mid' || p_partkey))) || repeat('00', CAST(1 + p_partkey % 7 * 100 AS INT))"
_TIMES = "CAST(1234 AS BIGINT) AS uid, CAST(77 AS BIGINT) AS gid, CAST(1700000010 AS BIGINT) AS atime, CAST(1700000020 AS BIGINT) AS mtime, CAST(1700000030 AS BIGINT) AS ctime"
_BY_SOURCE = "SELECT source, CAST(substr(source, 4) AS BIGINT) AS inode, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source"
SQL = {
    "a_mode_kind": f"SELECT CASE m & 61440 WHEN 16384 THEN 'directory' WHEN 40960 THEN 'symlink' WHEN 32768 THEN 'regular' WHEN 8192 THEN 'char-device' WHEN 24576 THEN 'block-device' WHEN 4096 THEN 'fifo' WHEN 49152 THEN 'socket' ELSE 'unknown' END AS kind, CAST(m & 4095 AS BIGINT) AS perm, count(*) AS n FROM (SELECT {_MODE} AS m FROM orders) GROUP BY ALL",
    "a_prefix_sum_u32": "SELECT c_custkey - 1 - (SELECT min(c_custkey - 1) FROM customer) AS idx, CAST(sum(c_custkey * 7919 % 99991 * 40000) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) % 4294967296 AS BIGINT) AS total FROM customer",
    "a_chunk_ends": _CHUNKS + "SELECT file, max(e) AS size, CAST(sum(e - len) AS BIGINT) AS starts, count(*) AS chunks FROM c GROUP BY file",
    "a_range_read": _CHUNKS + "SELECT file, CAST(sum(least(e, 150) - greatest(e - len, 50)) AS BIGINT) AS bytes, CAST(sum(greatest(50 - (e - len), 0)) AS BIGINT) AS skipped FROM c WHERE e > 50 AND e - len < 150 AND len > 0 GROUP BY file",
    "a_hole_length": "SELECT p_partkey AS idx, p_partkey % 3 AS block, CASE WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 1000 ELSE CAST(p_size AS BIGINT) * 65536 + p_partkey % 4096 END ELSE CAST(p_size AS BIGINT) END AS len FROM part",
    "a_rle_expand": "SELECT CAST(row_number() OVER (ORDER BY n_nationkey, i) - 1 AS BIGINT) AS slot, CAST(n_nationkey AS BIGINT) AS \"group\" FROM (SELECT n_nationkey, unnest(range(n_nationkey % 3 + 2)) AS i FROM nation)",
    "a_dict_join": "SELECT r_name AS region, count(*) AS n, min(c_custkey) AS first FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "a_dir_extents": f"SELECT source, CAST(e - n AS BIGINT) AS first_entry, CAST(e AS BIGINT) AS next_entry FROM (SELECT *, sum(n) OVER (ORDER BY inode ROWS UNBOUNDED PRECEDING) AS e FROM ({_BY_SOURCE}))",
    "a_walk_tree": _PLACES + "SELECT path, kind, depth FROM t",
    "a_lookup_paths": _PLACES + ", q AS (SELECT '//' || translate(r_name, '/ ', '__') || '//' || translate(n_name, '/ ', '__') || CASE WHEN n_nationkey % 4 = 0 THEN 'x' ELSE '' END || '/' AS path FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT q.path, t.inode FROM q LEFT JOIN t ON rtrim(replace(q.path, '//', '/'), '/') = t.path",
    "a_glob_filter": r"SELECT * FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages) WHERE regexp_full_match(path, 'en/[0-4][^/]*') OR regexp_full_match(path, '[^/]*/[^/][05]') OR regexp_full_match(path, '[d-e][^/]/1[^/]*')",
    "a_content_groups": "SELECT doc_id, CAST(min(doc_id) OVER (PARTITION BY md5(text)) AS VARCHAR) AS writer, doc_id = min(doc_id) OVER (PARTITION BY md5(text)) AS is_writer FROM documents",
    "a_first_offsets": "SELECT coalesce(min(event_id) FILTER (event_type = 'click'), 1099511627776) AS click, coalesce(min(event_id) FILTER (event_type IN ('purchase', 'buy')), 1099511627776) AS bought, coalesce(min(event_id) FILTER (event_type = 'absent'), 1099511627776) AS \"none\" FROM events",
    "a_section_summary": "SELECT event_type AS type, count(*) AS sections, CAST(sum(strlen(props)) AS BIGINT) AS payload_bytes FROM events GROUP BY event_type",
    "a_categories_first_seen": "SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type",
    "a_readdir_page": "SELECT name, cookie FROM (SELECT name, row_number() OVER (ORDER BY entry) AS cookie FROM (SELECT -2 AS entry, '.' AS name UNION ALL SELECT -1, '..' UNION ALL SELECT n_nationkey, n_name FROM nation)) WHERE cookie > 1 AND cookie <= 8",
    "a_rising_index": f"SELECT bool_and(coalesce(nxt > e, true)) AS rising FROM (SELECT e, lead(e) OVER (ORDER BY inode) AS nxt FROM (SELECT inode, sum(n) OVER (ORDER BY inode) AS e FROM ({_BY_SOURCE})))",
    "a_device_numbers": "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS major, s_suppkey AS minor, (s_suppkey & 255) | ((s_nationkey & 4095) << 8) | ((s_suppkey >> 8) << 20) AS dev, (s_suppkey + 511) // 512 AS blocks FROM supplier",
    "a_timestamps": "SELECT event_type, max(1700000000 + event_id * 2) AS last, min(1700000000 + event_id * 2) AS first FROM events GROUP BY event_type",
    "b_walk_stat": f"SELECT {_PATH} AS path, CAST(strlen(text) AS BIGINT) AS size, CAST(33188 AS BIGINT) AS mode, CAST(1700000000 AS BIGINT) AS mtime, CAST(1 AS BIGINT) AS nlink, CAST(3 AS BIGINT) AS depth FROM documents",
    "b_sha256": f"SELECT {_PATH} AS path, sha256(text) AS digest FROM documents",
    "b_read_at": f"SELECT {_PATH} AS path, substr(lower(hex(encode(text))), 21, 100) AS data FROM documents",
    "b_dedup": "SELECT count(DISTINCT text) AS contents, count(*) AS files, (SELECT CAST(sum(strlen(t)) AS BIGINT) FROM (SELECT DISTINCT text AS t FROM documents)) AS bytes FROM documents",
    "b_symlink": "SELECT DISTINCT '/chats/' || conv_id || '-' || turn AS path, '../' || last(role ORDER BY role) || '/' || conv_id AS target FROM conversations GROUP BY conv_id, turn",
    "b_verify": "SELECT true AS ok, CAST(NULL AS BIGINT) AS first_failure",
    "b_list_dirs": "SELECT '' AS path, CAST(0 AS BIGINT) AS depth UNION SELECT '/' || lang, 1 FROM documents UNION SELECT '/' || lang || '/' || source, 2 FROM documents",
    "b_glob_extract": f"SELECT {_PATH} AS path FROM documents WHERE lang = 'en' AND CAST(doc_id AS VARCHAR) LIKE '1%'",
    "b_ndjson": f"SELECT {_PATH} AS path, 'regular' AS kind, CAST(strlen(text) AS BIGINT) AS size FROM documents",
    "b_sha256_lzma": _DIGESTS,
    "b_sha256_lz4": _DIGESTS,
    "b_sha256_brotli": _DIGESTS,
    "b_special_stat": f"""SELECT path, kind, CAST(mode AS BIGINT) AS mode, {_TIMES}, CAST(size AS BIGINT) AS size, CAST(nlink AS BIGINT) AS nlink, CAST(rdev AS BIGINT) AS rdev FROM (
      SELECT '' AS path, 'directory' AS kind, 16877 AS mode, 0 AS size, 1 AS nlink, 0 AS rdev UNION ALL SELECT '/' || x, 'directory', 16877, 0, 1, 0 FROM {_SPECIAL_KINDS}
      UNION ALL SELECT '/dev/s' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'block-device' ELSE 'char-device' END, CASE WHEN s_suppkey % 2 = 0 THEN 24960 ELSE 8576 END, 0, 1, CAST(s_nationkey AS BIGINT) * 4294967296 + s_suppkey FROM supplier
      UNION ALL SELECT '/holes/p' || p_partkey, 'regular', 33188, p_size * 1000 + strlen('mid' || p_partkey) + 1 + p_partkey % 7 * 100, 1, 0 FROM part
      UNION ALL SELECT '/pipes/c' || n_nationkey, 'fifo', 4480, 0, 1, 0 FROM nation
      UNION ALL SELECT '/regions/r' || r_regionkey, 'regular', 33188, strlen(r_name), 1 + (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey), 0 FROM region
      UNION ALL SELECT '/links/n' || n_nationkey, 'regular', 33188, strlen(r_name), 1 + count(*) OVER (PARTITION BY n_regionkey), 0 FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "b_hole_reads": f"SELECT '/holes/p' || p_partkey AS path, substr(h, 19981, 80) AS data, sha256(unhex(h)) AS digest FROM (SELECT p_partkey, {_HOLE_HEX} AS h FROM part)",
    "b_walk_order": f"SELECT path, CAST(row_number() OVER (ORDER BY replace(path, '/', chr(1))) - 1 AS BIGINT) AS place FROM (SELECT {_PATH} AS path FROM documents UNION ALL SELECT * FROM ({_DIRS}))",
    "b_sections": f"SELECT type, compression, CAST(sections AS BIGINT) AS sections, CAST(first AS BIGINT) AS first, CAST(6 AS BIGINT) AS minor FROM (SELECT 'block' AS type, 'zstd' AS compression, count(*) AS sections, 0 AS first FROM ({_BLOCKS}) UNION ALL SELECT 'metadata_v2_schema', 'none', 1, count(*) FROM ({_BLOCKS}) UNION ALL SELECT 'metadata_v2', 'none', 1, count(*) + 1 FROM ({_BLOCKS}) UNION ALL SELECT 'section_index', 'none', 1, count(*) + 2 FROM ({_BLOCKS}))",
    "b_section_index": "SELECT type, CAST(200000 AS BIGINT) AS prefix, true AS agree FROM (VALUES ('block'), ('metadata_v2_schema'), ('metadata_v2'), ('section_index')) v(type)",
    "b_block_categories": f"SELECT block, CASE block % 4 WHEN 1 THEN 'audio' WHEN 3 THEN 'other' ELSE 'text' END AS category, least(16384, n - block * 16384) AS size FROM ({_BLOCKS})",
    "b_summary": f"""SELECT CAST(1048576 AS BIGINT) AS block_size, CAST(d + f AS BIGINT) AS inode_count, CAST(bytes AS BIGINT) AS total_fs_size, CAST(d AS BIGINT) AS symlink_offset, CAST(d AS BIGINT) AS file_offset, CAST(d + u AS BIGINT) AS shared_file_offset, CAST(d + f AS BIGINT) AS device_offset, 'inodes_have_nlink,mtime_only,packed_chunk_table,packed_directories,packed_shared_files_table' AS options
      FROM (SELECT (SELECT count(*) FROM ({_DIRS})) AS d, (SELECT count(*) FROM documents) AS f, (SELECT sum(strlen(text)) FROM documents) AS bytes, (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) = 1)) AS u)""",
    "b_readdir": "SELECT name, 'directory' AS kind, cookie FROM (SELECT name, row_number() OVER (ORDER BY k, name) AS cookie FROM (SELECT 0 AS k, '.' AS name UNION ALL SELECT 1, '..' UNION ALL SELECT DISTINCT 2, lang FROM documents)) WHERE cookie > 1 AND cookie <= 5",
    "b_lookup": "SELECT lang || '//' || source || '/' || doc_id || '.txt' || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END AS path, CASE WHEN doc_id % 3 <> 0 THEN 'regular' END AS kind, CASE WHEN doc_id % 3 <> 0 THEN CAST(strlen(text) AS BIGINT) END AS size FROM documents",
    "b_extract": _DIGESTS,
    "b_extract_stats": f"SELECT (SELECT count(*) FROM ({_DIRS})) AS directories, count(DISTINCT text) AS files, CAST(0 AS BIGINT) AS symlinks, count(*) - count(DISTINCT text) AS hardlinks, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS errors FROM documents",
    "b_tar": f"""SELECT CAST(row_number() OVER (ORDER BY replace(path, '/', chr(1))) - 1 AS BIGINT) AS place, path, CAST(size AS BIGINT) AS size, CAST(CASE WHEN digest IS NULL THEN 493 ELSE 420 END AS BIGINT) AS mode, CAST(1000 AS BIGINT) AS uid, CAST(100 AS BIGINT) AS gid, CAST(1700000000 AS BIGINT) AS mtime, digest
      FROM (SELECT {_PATH} AS path, strlen(text) AS size, sha256(text) AS digest FROM documents UNION ALL SELECT path, 0, NULL FROM ({_DIRS}) WHERE path <> '')""",
    "b_verify_broken": """SELECT flip, deep, CASE WHEN error IS NULL THEN deep_only AND NOT deep END AS ok, CASE WHEN error IS NULL AND (deep OR NOT deep_only) THEN CAST(section AS BIGINT) END AS first_failure, error
      FROM (VALUES ('payload of 0', 0, false, NULL), ('payload of 1', 1, false, NULL), ('digest of 0', 0, true, NULL), ('quick hash of 1', 1, false, NULL), ('number of 1', 1, false, NULL), ('type of 0', 0, false, NULL),
        ('magic of 1', 1, false, 'BadMagic'), ('magic of the last', 3, false, 'BadMagic'), ('version of 1', 1, false, 'UnsupportedVersion'), ('length of the last', 3, false, 'TruncatedSection')) v(flip, section, deep_only, error), (VALUES (false), (true)) w(deep)""",
}

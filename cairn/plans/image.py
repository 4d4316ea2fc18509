"""An image as DataFrames: its tables, the views that make them relational, and the questions asked of them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import DecodeError
from cairn.functions import columns as fn
from cairn.operators import content, joins, tree, windows
from cairn.plans.cut import cut
from cairn.sources import datasource

_OFFSETS = {"symlink_offset": ["symlink"], "file_offset": ["regular"], "device_offset": ["char-device", "block-device"], "special_offset": ["fifo", "socket", "unknown"]}


class ImageFrame:
    """Lazily built views of the image at ``path``, which starts at ``offset`` and ends after ``size`` bytes if given."""

    def __init__(self, spark: SparkSession, path: str, offset: str | int = "auto", size: int | None = None):
        datasource.register(spark)
        self.spark = spark
        self.options = {"path": path, "imageOffset": str(offset)} | ({"imageSize": str(size)} if size is not None else {})

    def table(self, name: str, **options: str) -> DataFrame:
        """A table as stored; see ``datasource.SCHEMAS``."""
        if name in datasource.METADATA:
            options["rows"] = str(self.counts[name])
        if self.spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
            return self.spark.read.format("fsimage").options(**self.options, table=name, pushFilters="true", **options).load()
        return datasource.scan(self.spark, self.options | options, name)

    def register(self, prefix: str = "") -> None:
        """Every table and view as a temporary view, for SQL."""
        for name in datasource.SCHEMAS:
            self.table(name).createOrReplaceTempView(prefix + name)
        for name in ("inode_attr", "tree", "file_chunks"):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    # --- sections

    @property
    def sections(self) -> DataFrame:
        return self.table("sections")

    def find_section(self, kind: int) -> DataFrame:
        return self.sections.filter(F.col("type_id") == kind).orderBy("ordinal").limit(1)

    def verify(self, level: str = "decode") -> DataFrame:
        """Each section with whether its hashes hold and it decodes; null is what ``level`` leaves out.

        Level "quick" is the 64-bit hash, "deep" also the digest, "decode" also decodes. A section is read once.
        """
        return self.table("verify", level=level)

    def verified(self, deep: bool = False) -> DataFrame:
        """One row: ``ok`` and ``first_failure`` (ordinal). Nothing is decoded, so unknown codecs pass."""
        good = F.col("xxh3_ok") & (F.col("sha_ok") if deep else F.lit(True))
        return self.verify("deep" if deep else "quick").agg(F.coalesce(F.every(good), F.lit(True)).alias("ok"), F.min(F.when(~good, F.col("ordinal"))).alias("first_failure"))

    # --- metadata

    @cached_property
    def counts(self) -> dict[str, int]:
        """How many elements each table of the metadata has; an executor counts them, so that no plan has to."""
        return {r.table: r.entries for r in self.table("counts").collect()}

    @cached_property
    def superblock(self):
        """The one row of scalars."""
        return self.table("superblock").first()

    @cached_property
    def n_inodes(self) -> int:
        return self.counts["inodes"]

    @cached_property
    def chunk_table(self) -> DataFrame:
        raw = self.table("chunk_table")
        return windows.prefix_sum(raw, "slot", "first_chunk", "first_chunk") if self.superblock.packed_chunk_table else raw

    @cached_property
    def shared_files(self) -> DataFrame:
        raw = self.table("shared_files")
        return windows.rle_expand(raw, "slot", "value", "slot_", "group").withColumnRenamed("slot_", "slot") if self.superblock.packed_shared_files_table else raw.withColumnRenamed("value", "group")

    @cached_property
    def directories(self) -> DataFrame:
        """Inode, parent_entry, first_entry, self_entry, next_entry; the sentinel row is left out."""
        raw = self.table("directories")
        entries = self.table("dir_entries")
        n, last = self.counts["dir_entries"], self.counts["directories"] - 1
        if self.superblock.packed_directories:
            raw = windows.prefix_sum(raw.select("inode", "first_entry"), "inode", "first_entry", "first_entry")
            held = joins.extents(raw, n).filter(F.col("inode") < last)
            return held.join(tree.rebuilt_links(joins.members(held), entries, last), "inode", "left")
        return joins.extents(raw, n).filter(F.col("inode") < last)

    @cached_property
    def inode_kinds(self) -> DataFrame:
        return joins.looked_up(self.table("inodes"), "mode_index", self.table("modes"), "idx", "value", "mode", "mode index out of range").withColumn("kind", fn.mode_kind(F.col("mode")))

    @cached_property
    def offsets(self):
        """First inode of each kind, and of shared files."""
        total = self.n_inodes
        row = joins.offsets_by_kind(self.inode_kinds.select("inode", "kind"), _OFFSETS, F.lit(total)).first().asDict()
        after = min(row["device_offset"], row["special_offset"])
        row["symlink_offset"] = min(row["symlink_offset"], row["file_offset"], after)
        row["file_offset"] = min(row["file_offset"], after)
        shared = self.shared_files.count()
        if shared > after - row["file_offset"]:
            raise DecodeError("more shared files than regular ones")
        return {"dir_offset": 0, **row, "shared_file_offset": after - shared, "end_of_files": after}

    @cached_property
    def children(self) -> DataFrame:
        """Parent, entry, inode, name, kind of each directory entry."""
        named = joins.looked_up(self.table("dir_entries"), "name_index", self.table("names"), "idx", "bytes", "name", "name index out of range", "binary")
        kinds = joins.looked_up(named, "inode", self.inode_kinds, "inode", "kind", "kind", "inode out of range", "string")
        return joins.members(self.directories).join(kinds.select("entry", "inode", "name", "kind"), "entry")

    @cached_property
    def tree(self) -> DataFrame:
        """Every path in the image; see ``operators.tree.walk``."""
        root = self.inode_kinds.filter("inode = 0").select("inode", "kind")
        walked = tree.walk(cut(self.children), root, self.counts["directories"])
        return cut(walked.withColumn("path_text", fn.text(F.col("path"))))

    def walk(self) -> DataFrame:
        """The tree in pre-order."""
        return self.tree.select("path", "inode", "kind", "place").orderBy("place").drop("place")

    @cached_property
    def symlinks(self) -> DataFrame:
        """``inode, target``."""
        at = self.table("symlink_table").select((F.col("slot") + self.offsets["symlink_offset"]).alias("inode"), "symlink_index")
        return joins.looked_up(at, "symlink_index", self.table("symlinks"), "idx", "bytes", "target", "symlink index out of range", "binary").select("inode", "target")

    @cached_property
    def devices(self) -> DataFrame:
        """``inode, rdev``."""
        return self.table("devices").select((F.col("idx") + self.offsets["device_offset"]).alias("inode"), "rdev")

    # --- contents

    @cached_property
    def slots(self) -> DataFrame:
        """``inode, slot`` of each regular file; equal slots have equal contents, and ``slot`` is the content's id."""
        o = self.offsets
        unique = o["shared_file_offset"] - o["file_offset"]
        own = self.spark.range(o["file_offset"], o["shared_file_offset"]).select(F.col("id").alias("inode"), (F.col("id") - o["file_offset"]).alias("slot"))
        shared = self.shared_files.select((F.col("slot") + o["shared_file_offset"]).alias("inode"), (F.col("group") + unique).alias("slot"))
        return own.unionByName(shared)

    @cached_property
    def slot_chunks(self) -> DataFrame:
        """``slot, idx, block, offset, len, is_hole, start, end`` of the chunks of each content."""
        sb = self.superblock
        ends = windows.following(self.chunk_table, "slot", "first_chunk", "next_chunk").filter("next_chunk > first_chunk")
        idx = ends.select("slot", F.explode(F.sequence(F.col("first_chunk"), F.col("next_chunk") - 1)).alias("idx"))
        chunks = idx.join(self.table("chunks"), "idx", "left").withColumn("block", joins.required(F.col("block"), "chunk index out of range"))
        hole = F.lit(sb.hole_block_index).cast("long")
        is_hole = F.coalesce(F.col("block") == hole, F.lit(False))
        if sb.hole_block_index is not None:
            large = self.table("large_holes").select(F.col("idx").alias("size"), F.col("bytes").alias("large"))
            chunks = chunks.join(large, "size", "left")
            length = F.when(is_hole & (F.col("offset") == fn.U32), joins.required(F.col("large"), "large hole out of range")).otherwise(fn.chunk_length(F.col("block"), F.col("offset"), F.col("size"), hole, F.lit(sb.block_size), F.col("large")))
        else:
            length = F.col("size")
        sized = chunks.select("slot", "idx", "block", "offset", length.alias("len"), is_hole.alias("is_hole"))
        return windows.chunk_ends(sized, "slot", "idx", "len")

    @cached_property
    def slot_sizes(self) -> DataFrame:
        return self.slot_chunks.groupBy("slot").agg(F.sum("len").alias("size"), F.min_by("block", "idx").alias("first_block"))

    @cached_property
    def sizes(self) -> DataFrame:
        """``inode, slot, size, first_block`` of each regular file."""
        return self.slots.join(self.slot_sizes, "slot", "left").select("inode", "slot", F.coalesce("size", F.lit(0)).cast("long").alias("size"), "first_block")

    @cached_property
    def file_chunks(self) -> DataFrame:
        """``inode`` and the columns of ``slot_chunks``."""
        return self.slots.join(self.slot_chunks, "slot")

    @cached_property
    def inode_attr(self) -> DataFrame:
        """What stat() of an inode says: inode, kind, mode, uid, gid, size, atime, mtime, ctime, nlink, rdev."""
        sb = self.superblock
        out = self.inode_kinds
        for index, table, name in (("owner_index", "uids", "uid"), ("group_index", "gids", "gid")):
            out = joins.looked_up(out, index, self.table(table), "idx", "value", name, f"{name} index out of range")
        out = out.join(self.sizes.select("inode", "size"), "inode", "left").join(self.devices, "inode", "left")
        when = lambda c: fn.timestamp(F.lit(sb.timestamp_base), F.col(c), F.lit(sb.time_resolution_sec).cast("long"))
        mtime = when("mtime_offset")
        regular, device = F.col("kind") == "regular", F.col("kind").isin("char-device", "block-device")
        return out.select(
            "inode", "kind", "mode", "uid", "gid",
            F.when(regular, F.coalesce("size", F.lit(0))).otherwise(0).cast("long").alias("size"),
            *[(mtime if sb.mtime_only else when(f"{c}_offset")).alias(c) for c in ("atime", "mtime", "ctime")],
            (F.col("nlink_minus_one") + 1 if sb.inodes_have_nlink else F.lit(1)).cast("long").alias("nlink"),
            F.when(device, F.coalesce("rdev", F.lit(0))).otherwise(0).cast("long").alias("rdev"),
        )

    def stat(self, inode: int | Column) -> DataFrame:
        return self.inode_attr.filter(F.col("inode") == inode)

    def read_dir(self, inode: int) -> DataFrame:
        """``name, inode, kind`` by entry."""
        return self.children.filter(F.col("parent") == inode).orderBy("entry").select("name", "inode", "kind")

    def read_dir_page(self, inode: int, offset: int, limit: int) -> DataFrame:
        """A directory's listing from a cookie on, with ``.`` and ``..`` first."""
        up = self.parent(inode).first()
        dots = self.spark.createDataFrame([(-2, bytearray(b"."), inode, "directory"), (-1, bytearray(b".."), up.parent if up else inode, "directory")], "entry long, name binary, inode long, kind string")
        return joins.page(dots.unionByName(self.children.filter(F.col("parent") == inode).select("entry", "name", "inode", "kind")), "entry", offset, limit)

    def lookup_child(self, inode: int, name: bytes) -> DataFrame:
        return self.children.filter((F.col("parent") == inode) & (F.col("name") == F.lit(name))).select("inode", "kind")

    def lookup(self, paths: DataFrame) -> DataFrame:
        """``paths`` (path: text) with ``inode`` and ``kind``, null where there is none. Empty components don't count."""
        clean = F.concat_ws("", F.transform(fn.path_parts(F.col("path")), lambda x: F.concat(F.lit("/"), x)))
        found = self.tree.select(F.col("path").alias("_p"), "inode", "kind")
        return paths.join(found, F.encode(clean, "UTF-8") == F.col("_p"), "left").drop("_p")

    def lookup_one(self, path: str | bytes) -> int:
        parts = [x for x in (path.encode() if isinstance(path, str) else path).split(b"/") if x]
        row = self.tree.filter(F.col("path") == F.lit(b"".join(b"/" + x for x in parts))).select("inode").first()
        if row is None:
            raise FileNotFoundError(path)
        return row.inode

    def parent(self, inode: int) -> DataFrame:
        """``parent``: the inode that the directory's parent entry names; the root is its own."""
        above = self.directories.filter(F.col("inode") == inode).select(F.col("parent_entry").alias("entry"))
        return above.join(self.table("dir_entries"), "entry").select(F.when(F.lit(inode) == 0, 0).otherwise(F.col("inode")).cast("long").alias("parent"))

    def read_link(self, inode: int) -> bytes:
        row = self.symlinks.filter(F.col("inode") == inode).first()
        if row is None:
            raise DecodeError(f"inode {inode} is no symlink")
        return bytes(row.target)

    def device_rdev(self, inode: int) -> int:
        row = self.devices.filter(F.col("inode") == inode).first()
        if row is None:
            raise DecodeError(f"inode {inode} is no device")
        return row.rdev

    def parts(self, chunks: DataFrame | None = None, offset: int = 0, size: int | None = None) -> DataFrame:
        """Slices of the bytes [offset, offset + size) of each file of ``chunks`` (by ``inode``; all files if none)."""
        chunks = self.file_chunks if chunks is None else chunks
        met = windows.overlapping(chunks, F.lit(offset), F.lit(size if size is not None else (1 << 62) - offset))
        return content.slices(met.withColumnRenamed("inode", "file"), self.options)

    def read_ranges(self, offset: int, size: int, inodes: DataFrame | None = None) -> DataFrame:
        """``inode, data``: the bytes [offset, offset + size) of each regular file, fewer at its end; empty beyond."""
        files = self.slots if inodes is None else self.slots.join(inodes.select("inode").distinct(), "inode")
        chunks = files.join(self.slot_chunks, "slot")
        read = content.joined(self.parts(chunks, offset, size)).withColumnRenamed("file", "inode")
        return files.select("inode").join(read, "inode", "left").withColumn("data", F.coalesce("data", F.lit(b"")))

    def read_at(self, inode: int, offset: int, size: int) -> bytes:
        row = self.read_ranges(offset, size, self.spark.range(inode, inode + 1).select(F.col("id").alias("inode"))).first()
        if row is None:
            raise DecodeError(f"inode {inode} is no regular file")
        return bytes(row.data)

    def read_file(self, inode: int) -> bytes:
        row = self.sizes.filter(F.col("inode") == inode).first()
        if row is None:
            raise DecodeError(f"inode {inode} is no regular file")
        if row.size >= 1 << 31:
            raise DecodeError("a file of 2 GiB or more does not fit a row; use parts()")
        return self.read_at(inode, 0, row.size)

    def read_single_chunk(self, inode: int, offset: int, size: int) -> bytes | None:
        """The range if one chunk that is no hole holds all of it, else None."""
        held = self.file_chunks.filter((F.col("inode") == inode) & ~F.col("is_hole") & (F.col("start") <= offset) & (F.col("end") >= offset + size))
        return None if held.isEmpty() else self.read_at(inode, offset, size)

    def checksums(self, algorithm: str = "sha256") -> DataFrame:
        """``inode, digest`` of each regular file. Each content is read and hashed once, however many files share it."""
        chunks = self.slot_chunks.withColumnRenamed("slot", "inode")
        found = content.digests(self.parts(chunks), algorithm).select(F.col("file").alias("slot"), "digest")
        empty = content.new_digest(algorithm).hexdigest()
        return self.slots.join(found, "slot", "left").select("inode", F.coalesce("digest", F.lit(empty)).alias("digest"))

    def checksum_paths(self, algorithm: str = "sha256") -> DataFrame:
        """``digest, path`` of each regular file, in walk order."""
        files = self.tree.filter("kind = 'regular' and depth > 0")
        return files.join(self.checksums(algorithm), "inode").orderBy("place").select("digest", fn.relative_path(F.col("path_text")).alias("path"))

    def content_groups(self) -> DataFrame:
        """``slot, files, size`` of each distinct content."""
        return self.sizes.groupBy("slot").agg(F.count("*").alias("files"), F.first("size").alias("size"))

    # --- categories

    @cached_property
    def block_categories(self) -> DataFrame:
        """``block, category`` (name)."""
        names = self.table("category_names")
        return joins.looked_up(self.table("block_categories"), "category", names, "idx", "name", "category_name", "category out of range", "string").select("block", F.col("category_name").alias("category"))

    def category_names(self) -> list[str]:
        """Distinct, in the order their first blocks are in."""
        return [r.category for r in joins.first_seen(self.block_categories, "category", "block").orderBy("first_seen").collect()]

"""The ``fsimage`` data source: the tables of an image, by the option ``table``.

``sections`` and what comes with them (``section_payload``, ``verify``, ``blocks``) have a partition for each
``TOGETHER`` bytes of the source, with the sections that begin there; metadata tables have one for each ``ROWS``
elements. Plans are made on the driver, so they take the source's size and the option ``rows``, the number of a metadata
table's elements as ``counts`` has it; only without it is the metadata decoded to plan. Filters on a section's or
block's number, by equality or IN, choose sections by their headers, before any payload is read; where the session does
not push filters into Python sources, the option ``blocks`` does the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.conversion import LocalDataToArrowConversion
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from cairn.errors import ImageError, SourceError
from cairn.sources import codecs, container, history
from cairn.sources.bytesource import open_source
from cairn.sources.container import HEADER_LEN, Image, Section
from cairn.sources.metadata import INTEGERS, ROOT, STRINGS, STRUCTS, Metadata

ROWS = 1 << 20
#: Bytes of the source whose sections share a partition.
TOGETHER = 64 << 20
_HISTORY_CAP = 16 << 20
_VERSION = "struct<major:int,minor:int,patch:int,is_release:boolean,git_rev:string,git_branch:string,git_desc:string>"
_SECTION = "ordinal long, file_offset long, major int, minor int, number long, type_id int, type string, compression_id int, compression string, payload_len long, xxh3 string, sha512_256 binary"


def _struct_ddl(table: str) -> str:
    key = "inode" if table in ("inodes", "directories") else "entry" if table == "dir_entries" else "idx"
    return ", ".join(f"{c} long" for c in (key, *STRUCTS[table]))


SCHEMAS = {
    "sections": _SECTION,
    "section_payload": "ordinal long, type_id int, payload binary",
    "verify": "ordinal long, number long, xxh3_ok boolean, sha_ok boolean, decodes boolean, error string",
    "section_index": "ordinal long, type_id int, offset_from_base long",
    "blocks": "block long, size long, bytes binary",
    "history": f"section long, entry long, version {_VERSION}, system_id string, compiler_id string, arguments array<string>, timestamp long, library_versions array<string>",
    "superblock": "timestamp_base long, block_size long, total_fs_size long, preferred_path_separator long, hole_block_index long, total_allocated_fs_size long, features array<string>, mtime_only boolean, packed_chunk_table boolean, packed_directories boolean, packed_shared_files_table boolean, has_btime boolean, inodes_have_nlink boolean, time_resolution_sec long, subsecond_resolution long",
    "layouts": "table string, entries long, element_bits long, bytes long",
    "counts": "table string, entries long",
    "image": "base_offset long, length long, sections long, has_index boolean, header binary",
    "category_names": "idx long, name string",
    **{t: _struct_ddl(t) for t in STRUCTS},
    **{t: f"{k} long, {v} long" for t, (k, v) in INTEGERS.items()},
    **{t: "idx long, bytes binary" for t in STRINGS},
}
_BY_SECTION = ("section_payload", "verify", "blocks")
#: Tables of the metadata.
METADATA = {*ROOT, *STRINGS}


def section_name(kind: int) -> str:
    return container.SECTION_NAMES.get(kind, f"unknown({kind})")


@dataclass
class Part(InputPartition):
    numbers: tuple[int, ...] = ()  # ordinals of sections, or blocks
    first: int = 0
    last: int = 0

    def __init__(self, numbers: tuple[int, ...] = (), first: int = 0, last: int = 0):
        super().__init__(None)
        self.numbers, self.first, self.last = numbers, first, last


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], table: str):
        self.options, self.table = options, table
        self.wanted: set[int] | None = {int(x) for x in options["blocks"].split(",") if x.strip()} if "blocks" in options else None

    def image(self) -> Image:
        size = self.options.get("imagesize")
        return Image.open(self.options["path"], self.options.get("imageoffset", "auto"), int(size) if size is not None else None)

    def _numbered(self, image: Image) -> list[tuple[int, Section]]:
        some = [s for s in image.sections if s.header.kind == container.BLOCK] if self.table == "blocks" else image.sections
        return [(i, s) for i, s in enumerate(some) if self.wanted is None or i in self.wanted]

    def ranges(self) -> list[tuple[int, int]]:
        """Where the parts of the table begin and end: in bytes of the source, or in elements."""
        if self.table in _BY_SECTION:
            size = self.options.get("imagesize")
            ends = open_source(self.options["path"]).size if size is None else int(size)
            return [(at, at + TOGETHER) for at in range(0, max(1, ends), TOGETHER)]
        if self.table in METADATA:
            n = int(self.options["rows"]) if "rows" in self.options else Metadata(self.image()).count(self.table)
            return [(i, min(n, i + ROWS)) for i in range(0, n, ROWS)] or [(0, 0)]
        return [(0, 0)]

    def partitions(self) -> list[InputPartition]:
        if self.table not in _BY_SECTION or self.wanted is None:
            return [Part((), *x) for x in self.ranges()]
        out: list[Part] = []
        held: list[int] = []
        size = 0
        for i, s in self._numbered(self.image()):
            if held and size + s.header.payload_len > TOGETHER:
                out.append(Part(tuple(held)))
                held, size = [], 0
            held.append(i)
            size += s.header.payload_len
        return [*out, Part(tuple(held))] if held else out or [Part()]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch | tuple]:
        image = self.image()
        if self.table in METADATA:
            batch = Metadata(image).batch(self.table, partition.first, partition.last)
            for i in range(0, batch.num_rows, 1 << 16):
                yield batch.slice(i, 1 << 16)
        elif self.table in _BY_SECTION:
            sections = dict(self._numbered(image))
            cap = Metadata(image).superblock()["block_size"] if self.table == "blocks" else 0
            for n in partition.numbers or [i for i, s in sections.items() if partition.first <= s.offset < partition.last]:
                yield self._of_section(image, n, sections[n], cap)
        else:
            yield from self._rows(image)

    def _of_section(self, image: Image, n: int, s: Section, cap: int) -> tuple:
        if self.table == "section_payload":
            return n, s.header.kind, image.payload(s)
        if self.table == "blocks":
            data = image.decompressed(s, cap)
            return n, len(data), data
        level, whole = self.options.get("level", "decode"), image.section_bytes(s)
        xxh, error = image.xxh3_ok(s, whole), None
        sha = image.sha_ok(s, whole) if level != "quick" else None
        if level != "decode":
            return n, s.header.number, xxh, sha, None, None
        try:
            if not xxh:
                raise ImageError("xxh3")
            codecs.decompress(s.header.compression, whole[HEADER_LEN:], 1 << 30)
        except ImageError as e:
            error = f"{type(e).__name__}: {e}"
        return n, s.header.number, xxh, sha, error is None, error

    def _rows(self, image: Image) -> Iterator[tuple]:
        columns = [c.split()[0] for c in SCHEMAS[self.table].split(", ")]
        if self.table == "sections":
            for s in image.sections:
                h = s.header
                yield s.ordinal, s.offset, h.major, h.minor, h.number, h.kind, section_name(h.kind), h.compression, codecs.codec_name(h.compression), h.payload_len, f"{h.xxh3:016x}", h.sha512_256
        elif self.table == "section_index":
            for i, (kind, offset) in enumerate(image.index() or []):
                yield i, kind, offset
        elif self.table == "image":
            yield image.base, image.source.size, len(image.sections), image.index() is not None, image.source.read(0, image.base)
        elif self.table == "superblock":
            row = Metadata(image).superblock()
            yield tuple(row[c] for c in columns)
        elif self.table == "counts":
            metadata = Metadata(image)
            for table in sorted(METADATA):
                yield table, metadata.count(table)
        elif self.table == "layouts":
            for row in Metadata(image).layouts():
                yield tuple(row[c] for c in columns)
        elif self.table == "history":
            for k, s in enumerate(x for x in image.sections if x.header.kind == container.HISTORY):
                try:
                    entries = history.parse(image.decompressed(s, _HISTORY_CAP))
                except ImageError:
                    continue  # history is for people; an image is whole without it
                for i, e in enumerate(entries):
                    v = e["version"]
                    yield k, i, tuple(v[x] for x in ("major", "minor", "patch", "is_release", "git_rev", "git_branch", "git_desc")), e["system_id"], e["compiler_id"], e["arguments"], e["timestamp"], e["library_versions"]


class FilteringReader(ImageReader):
    """For sessions that push filters into Python sources; others refuse a reader that can take them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        key = {"blocks": "block", "section_payload": "ordinal", "verify": "ordinal"}.get(self.table)
        for f in filters:
            if key and isinstance(f, EqualTo | In) and f.attribute == (key,):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fsimage"

    def schema(self) -> str:
        table = self.options.get("table", "sections")
        if table not in SCHEMAS:
            raise SourceError(f"no table {table}; there are {', '.join(sorted(SCHEMAS))}")
        return SCHEMAS[table]

    def reader(self, schema) -> ImageReader:
        options = {k.lower(): v for k, v in dict(self.options).items()}
        kind = FilteringReader if options.get("pushfilters") == "true" else ImageReader
        return kind(options, options.get("table", "sections"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageSource)


def scan(spark: SparkSession, options: dict[str, str], table: str) -> DataFrame:
    """A table as the data source has it, by tasks alone.

    To plan a Python source Spark starts Python processes beside the driver, some for each table, and keeps them.
    """
    if table not in SCHEMAS:
        raise SourceError(f"no table {table}; there are {', '.join(sorted(SCHEMAS))}")
    reader = ImageReader({k.lower(): v for k, v in options.items()}, table)
    ranges, schema = reader.ranges(), StructType.fromDDL(SCHEMAS[table])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column("id").to_pylist()):
            found = reader.read(Part((), *ranges[i]))
            if table in METADATA:
                yield from found
            else:
                for some in batched(found, 1 if table in _BY_SECTION else 1 << 12):
                    yield from LocalDataToArrowConversion.convert(list(some), schema, False).to_batches()

    # As an RDD, of which the planner knows no size: it would take a range's few bytes for those of the table.
    ids = spark.range(0, len(ranges), 1, len(ranges)).toDF("id")._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(ids.toJavaRDD(), ids.schema()), spark).mapInArrow(read, schema)

"""Sections of the images that appear in a folder, as a stream. Headers are read on executors, payloads are not."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.errors import ImageError
from cairn.sources import codecs
from cairn.sources.container import Image
from cairn.sources.datasource import section_name

_FILE = "path string, modificationTime timestamp, length long, content binary"
_OUT = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("type", pa.string()), ("compression", pa.string()), ("payload_len", pa.int64()), ("error", pa.string())])


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path in b.column("path").to_pylist():
            try:
                out += [{"path": path, "ordinal": s.ordinal, "type": section_name(s.header.kind), "compression": codecs.codec_name(s.header.compression), "payload_len": s.header.payload_len, "error": None} for s in Image.open(path).sections]
            except ImageError as e:
                out.append({"path": path, "ordinal": None, "type": None, "compression": None, "payload_len": None, "error": f"{type(e).__name__}: {e}"})
        yield pa.RecordBatch.from_pylist(out, _OUT)


def sections(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame: path, ordinal, type, compression, payload_len, and an error for a file that is no image."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select("path").mapInArrow(_sections, "path string, ordinal long, type string, compression string, payload_len long, error string")

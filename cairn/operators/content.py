"""Contents of files: slices of blocks, reads, digests.

Slices are cut where blocks are decoded. Chunks are dealt by block and sorted, so each block is decoded once in the
whole cluster and only the bytes asked for leave the task; holes stay lengths until something needs their zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.errors import DecodeError
from cairn.sources import container
from cairn.sources.container import Image
from cairn.sources.metadata import Metadata

ALGORITHMS = ("sha256", "sha512", "xxh3-64", "xxh3-128")
#: A slice is handed on in parts of so many bytes; so are zeros of holes.
PART = 1 << 20
#: Whole-payload decoding is skipped if so little of a block is needed, in a codec that can stop early.
PREFIX_STEP, PREFIX_MOST = 1 << 20, 4 << 20
_SLICE = pa.schema([("file", pa.int64()), ("idx", pa.int64()), ("start", pa.int64()), ("take", pa.int64()), ("bytes", pa.binary())])


class Blocks:
    """Decodes the blocks of one image; holds the last one."""

    def __init__(self, options: dict[str, str]):
        size = options.get("imageSize")
        self.image = Image.open(options["path"], options.get("imageOffset", "auto"), int(size) if size is not None else None)
        self.sections = [s for s in self.image.sections if s.header.kind == container.BLOCK]
        self.cap = Metadata(self.image).superblock()["block_size"]
        self.number, self.data = -1, b""

    def read(self, block: int, offset: int, length: int, most: int) -> bytes:
        """``length`` bytes at ``offset``; ``most``: how far anyone will read into the block."""
        if block >= len(self.sections):
            raise DecodeError(f"block {block} of {len(self.sections)}")
        if block != self.number:
            need = -(-most // PREFIX_STEP) * PREFIX_STEP
            head = self.image.decompressed_prefix(self.sections[block], need) if need <= PREFIX_MOST and need < self.cap else None
            self.data = self.image.decompressed(self.sections[block], self.cap) if head is None else head
            self.number = block
        if offset + length > len(self.data):
            raise DecodeError(f"{length} bytes at {offset} of block {block}, which has {len(self.data)}")
        return self.data[offset : offset + length]


def _slices(batches: Iterator[pa.RecordBatch], options: dict[str, str]) -> Iterator[pa.RecordBatch]:
    blocks = None
    for b in batches:
        rows = b.to_pylist()
        most: dict[int, int] = {}
        for r in rows:
            if not r["is_hole"]:
                most[r["block"]] = max(most.get(r["block"], 0), r["offset"] + r["skip"] + r["take"])
        out: list[tuple] = []
        size = 0
        for r in rows:
            start = r["start"] + r["skip"]
            if r["is_hole"]:
                out.append((r["file"], r["idx"], start, r["take"], None))
                continue
            blocks = blocks or Blocks(options)
            if r["block"] == blocks.number and r["offset"] + r["skip"] + r["take"] > len(blocks.data):
                blocks.number = -1  # the batch before needed less of it
            data = blocks.read(r["block"], r["offset"] + r["skip"], r["take"], most[r["block"]])
            for at in range(0, len(data), PART):
                part = data[at : at + PART]
                out.append((r["file"], r["idx"], start + at, len(part), part))
                size += len(part)
                if size >= 8 * PART:
                    yield pa.RecordBatch.from_pylist([dict(zip(_SLICE.names, x, strict=True)) for x in out], _SLICE)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(_SLICE.names, x, strict=True)) for x in out], _SLICE)


def slices(chunks: DataFrame, options: dict[str, str]) -> DataFrame:
    """``file, idx, start, take, bytes`` for ``chunks`` (file, idx, block, offset, start, skip, take, is_hole).

    ``bytes`` is null for a hole.
    """
    cols = chunks.select("file", "idx", "block", "offset", "start", "skip", "take", "is_hole").filter("take > 0")
    dealt = cols.repartition("block").sortWithinPartitions("block", "offset")
    return dealt.mapInArrow(lambda b: _slices(b, options), "file long, idx long, start long, take long, bytes binary")


def joined(parts: DataFrame) -> DataFrame:
    """``file, data``: the bytes of each file or range in one row. For what fits a row."""
    filled = F.coalesce("bytes", F.unhex(F.repeat(F.lit("00"), F.col("take").cast("int"))))
    each = parts.select("file", F.struct("idx", "start", filled.alias("bytes")).alias("p")).groupBy("file").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return each.select("file", F.aggregate("ps", F.lit(b""), lambda a, p: F.concat(a, p["bytes"])).alias("data"))


def new_digest(algorithm: str):
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}; there are {', '.join(ALGORITHMS)}")
    if algorithm.startswith("sha"):
        return hashlib.new(algorithm)
    import xxhash

    return xxhash.xxh3_64() if algorithm == "xxh3-64" else xxhash.xxh3_128()


def digests(parts: DataFrame, algorithm: str) -> DataFrame:
    """``file, digest`` (lower-case hex) of each file with any slice.

    A file's slices come sorted to one task and are hashed as they pass, so a file of any size takes the memory of one.
    """
    new_digest(algorithm)
    dealt = parts.repartition("file").sortWithinPartitions("file", "idx", "start")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = state = None
        for b in batches:
            files, found = [], []
            for file, take, data in zip(b.column("file").to_pylist(), b.column("take").to_pylist(), b.column("bytes"), strict=True):
                if file != last:
                    if state is not None:
                        files.append(last), found.append(state.hexdigest())
                    last, state = file, new_digest(algorithm)
                if data.is_valid:
                    state.update(data.as_buffer())
                else:
                    for at in range(0, take, PART):
                        state.update(bytes(min(PART, take - at)))
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(found, pa.string())], ["file", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["file", "digest"])

    return dealt.mapInArrow(hashed, "file long, digest string")

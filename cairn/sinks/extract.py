"""Writing an image's tree to a folder that driver and executors share, or to a tar archive."""

from __future__ import annotations

import io
import os
import shutil
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.errors import DecodeError
from cairn.functions import columns as fn
from cairn.operators import content
from cairn.plans.cut import cut
from cairn.plans.image import ImageFrame


@dataclass
class ExtractOptions:
    continue_on_error: bool = False
    hardlink_shared: bool = True
    include_patterns: list[str] = field(default_factory=list)


@dataclass
class ExtractStats:
    directories: int = 0
    files: int = 0
    symlinks: int = 0
    hardlinks: int = 0
    skipped: int = 0
    errors: int = 0


def _at(dest: str, path: bytes) -> bytes:
    parts = [x for x in path.split(b"/") if x]
    if any(x in (b".", b"..") or b"\0" in x for x in parts):
        raise DecodeError(f"a path that leaves the tree: {path!r}")
    return os.path.join(os.fsencode(dest), *parts)


def _write(batches: Iterator[pa.RecordBatch], dest: str) -> Iterator[pa.RecordBatch]:
    """Writes slices sorted by file and place; yields (file, error). A file is written to its end before the next."""
    for_file, out, error = None, None, None
    done: list[tuple[int, str | None]] = []

    def close() -> None:
        if out:
            out.close()
        if for_file is not None:
            done.append((for_file, error))

    for b in batches:
        for r in b.to_pylist():
            if r["file"] != for_file:
                close()
                for_file, out, error = r["file"], None, None
                try:
                    out = open(_at(dest, r["path"]), "wb")  # noqa: SIM115
                except (OSError, DecodeError) as e:
                    error = str(e)
            if out and not error and r["take"]:
                try:
                    out.seek(r["start"])
                    if r["bytes"] is not None:
                        out.write(r["bytes"])
                    else:
                        out.truncate(r["start"] + r["take"])
                except OSError as e:
                    error = str(e)
    close()
    yield pa.RecordBatch.from_pydict({"file": [f for f, _ in done], "error": [e for _, e in done]}, pa.schema([("file", pa.int64()), ("error", pa.string())]))


def selected(frame: ImageFrame, patterns: list[str]) -> DataFrame:
    return frame.tree.filter(fn.selected(F.col("path"), F.col("kind"), patterns))


def extract_all(frame: ImageFrame, dest: str, options: ExtractOptions | None = None) -> ExtractStats:
    """Directories on the driver, each distinct content once on the executors, then links on the driver.

    Modes, times and owners are not restored. Without ``continue_on_error`` the first error is raised; with it, an
    error that sums them up is raised at the end.
    """
    o, stats = options or ExtractOptions(), ExtractStats()
    os.makedirs(dest, exist_ok=True)
    chosen = selected(frame, o.include_patterns)

    def failed(what: object, e: Exception | str) -> None:
        if not o.continue_on_error:
            raise e if isinstance(e, Exception) else DecodeError(f"{what}: {e}")
        stats.errors += 1

    for r in chosen.filter("kind = 'directory'").orderBy("place").select("path").toLocalIterator():
        try:
            os.makedirs(_at(dest, bytes(r.path)), exist_ok=True)
            stats.directories += 1
        except (OSError, DecodeError) as e:
            failed(bytes(r.path), e)

    files = chosen.filter("kind = 'regular'").join(frame.sizes.select("inode", "slot"), "inode")
    first = files.groupBy("slot").agg(F.min_by("path", "place").alias("path"), F.min("place").alias("place"))
    pieces = frame.parts(first.join(frame.slot_chunks, "slot").withColumnRenamed("slot", "inode"))
    empty = first.select(F.col("slot").alias("file"), F.lit(-1).cast("long").alias("idx"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("take"), F.lit(None).cast("binary").alias("bytes"))
    rows = pieces.unionByName(empty).join(first.select(F.col("slot").alias("file"), "path"), "file")
    dealt = rows.repartition("file").sortWithinPartitions("file", "idx", "start")
    written = cut(dealt.mapInArrow(lambda b: _write(b, dest), "file long, error string"))
    for r in written.filter("error is not null").toLocalIterator():
        failed(r.file, r.error)
    stats.files += written.filter("error is null").count()

    links = files.join(first.select("slot", F.col("path").alias("writer")), "slot").filter("path <> writer").select("place", "path", "kind", "writer", "slot", F.lit(None).cast("binary").alias("target"))
    syms = chosen.filter("kind = 'symlink'").join(frame.symlinks, "inode", "left").select("place", "path", "kind", F.lit(None).cast("binary").alias("writer"), F.lit(None).cast("long").alias("slot"), "target")
    rest = chosen.filter("kind not in ('directory', 'regular', 'symlink')").select("place", "path", "kind", F.lit(None).cast("binary").alias("writer"), F.lit(None).cast("long").alias("slot"), F.lit(None).cast("binary").alias("target"))
    for r in links.unionByName(syms).unionByName(rest).orderBy("place").toLocalIterator():
        try:
            if r.kind == "regular":
                here, writer = _at(dest, bytes(r.path)), _at(dest, bytes(r.writer))
                _clear(here)
                if o.hardlink_shared:
                    os.link(writer, here)
                    stats.hardlinks += 1
                else:
                    shutil.copyfile(writer, here)
                    stats.files += 1
            elif r.kind == "symlink":
                here = _at(dest, bytes(r.path))
                _clear(here)
                os.symlink(bytes(r.target), here)
                stats.symlinks += 1
            else:
                stats.skipped += 1
        except (OSError, DecodeError) as e:
            failed(bytes(r.path), e)
    if stats.errors:
        raise DecodeError(f"{stats.errors} entries could not be extracted")
    return stats


def _clear(path: bytes) -> None:
    if os.path.lexists(path):
        os.unlink(path)


class _Parts(io.RawIOBase):
    """The bytes of one file, from an iterator of slices of all files in order."""

    def __init__(self, take):
        self.take, self.held = take, b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held:
            part = self.take()
            if part is None:
                return 0
            self.held = part
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


def write_tar(frame: ImageFrame, out: str | BinaryIO) -> int:
    """A USTAR archive in walk order; returns the number of members. The root and special files are left out.

    Slices come to the driver sorted, a partition at a time.
    """
    entries = frame.tree.filter("depth > 0 and kind in ('directory', 'regular', 'symlink')").select("inode", "path", "place").join(frame.inode_attr, "inode").join(frame.symlinks, "inode", "left")
    files = frame.tree.filter("kind = 'regular'").select("inode", "place").join(frame.sizes.select("inode", "slot"), "inode").select("slot", "place")
    pieces = content_by_place(frame, files)
    slices = iter(pieces.toLocalIterator())
    held: list = [next(slices, None)]
    members = 0
    with tarfile.open(out, "w", format=tarfile.USTAR_FORMAT) if isinstance(out, str) else tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT) as tar:
        for r in entries.orderBy("place").toLocalIterator():
            info = tarfile.TarInfo(bytes(r.path).decode("utf-8", "replace").lstrip("/"))
            info.mode, info.uid, info.gid, info.mtime = r.mode & 0o7777, r.uid, r.gid, r.mtime
            members += 1
            tar.members.clear()  # else each stays in memory
            if r.kind == "directory":
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            elif r.kind == "symlink":
                info.type = tarfile.SYMTYPE
                try:
                    info.linkname = bytes(r.target).decode("utf-8")
                except UnicodeDecodeError:
                    info.linkname = ""
                tar.addfile(info)
            else:
                place = list(r.place)

                def take(place=place):
                    row = held[0]
                    if row is None or list(row.place) != place:
                        return None
                    held[0] = next(slices, None)
                    return bytes(row.bytes) if row.bytes is not None else bytes(row.take)

                info.size = r.size
                tar.addfile(info, io.BufferedReader(_Parts(take), 1 << 20))
    return members


def content_by_place(frame: ImageFrame, files: DataFrame) -> DataFrame:
    """``place, take, bytes`` of the slices of ``files`` (slot, place), in order; holes in parts of ``PART`` bytes."""
    chunks = files.select("slot").distinct().join(frame.slot_chunks, "slot").withColumnRenamed("slot", "inode")
    parts = frame.parts(chunks)
    n = F.when(F.col("bytes").isNull(), F.ceil(F.col("take") / content.PART)).otherwise(1).cast("int")
    parts = parts.withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    take = F.when(F.col("bytes").isNull(), F.least(F.lit(content.PART), F.col("take") - F.col("_k") * content.PART)).otherwise(F.col("take"))
    parts = parts.withColumn("take", take)
    return files.join(parts.withColumnRenamed("file", "slot"), "slot").orderBy("place", "idx", "start", "_k").select("place", "take", "bytes")

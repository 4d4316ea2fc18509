"""The writer of images for trees whose contents are rows of a DataFrame.

Contents are laid out, packed and sealed on executors, a run of blocks to a file of the shared folder. One task makes the
metadata, which the format has in one section, of names, sizes and digests; the driver holds the lengths of blocks and
copies the files one after another. The bytes are those of ``builder.build`` for the same tree.
"""

from __future__ import annotations

import os
import shutil
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.fixtures import builder
from cairn.fixtures.builder import Columns, Options, Tables

#: Bytes of blocks that one file of the shared folder has; a piece of content is handed on in batches of as many.
PART = 16 << 20
_PIECES = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])
_SEALED = pa.schema([("block", pa.int64()), ("sealed", pa.int64()), ("stored", pa.int64())])


def write(files: DataFrame, links: DataFrame | None, path: str, shared: str, options: Options | None = None) -> None:
    """Writes the image of ``files`` (folder, name, content) and ``links`` (folder, name, target) to ``path``.

    A ``folder`` is the names on the way to it, joined by NUL. ``shared`` is a folder that driver and executors mount.
    Of rows with one path, one counts.
    """
    o = options or Options()
    spark = files.sparkSession
    work = f"{shared}/cairn-{uuid.uuid4().hex}"
    os.makedirs(f"{work}/parts")
    try:
        keyed = files.withColumn("digest", F.unhex(F.sha2("content", 256)))
        found = keyed.select("folder", "name", "digest", F.octet_length("content").cast("long").alias("size"))
        found.write.parquet(f"file://{work}/files")
        if links is not None:
            links.select("folder", "name", "target").write.parquet(f"file://{work}/links")
        linked = links is not None
        planned = spark.range(1, numPartitions=1).mapInArrow(lambda b: _planned(b, work, linked, o), "blocks long, stored long, kinds array<long>, lengths array<long>").first()
        starts = spark.read.parquet(f"file://{work}/layout.parquet")
        each = max(1, PART // o.block_size)
        placed = keyed.join(starts, ["folder", "name", "digest"]).select("start", "content")
        pieces = placed.mapInArrow(lambda b: _pieces(b, o.block_size, each), "part long, block long, at long, bytes binary")
        dealt = pieces.repartition("part").sortWithinPartitions("block", "at")
        to, codec, minor = f"{work}/parts", o.codec, o.minor
        done = dealt.mapInArrow(lambda b: _assembled(b, to, codec, minor, each), "block long, sealed long, stored long").toArrow()
        order = np.argsort(done["block"].to_numpy())
        if not np.array_equal(done["block"].to_numpy()[order], np.arange(planned.blocks)) or done["stored"].to_numpy().sum() != planned.stored:
            raise OSError(f"{done.num_rows} blocks of {planned.blocks} were written")
        with open(path, "wb") as out:
            out.write(o.prefix)
            for part in range(-(-planned.blocks // each)):
                with open(f"{to}/{part}", "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
                os.unlink(f"{to}/{part}")
            with open(f"{work}/last", "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
            lengths = chain(((0, n) for n in done["sealed"].to_numpy()[order].tolist()), zip(planned.kinds, planned.lengths, strict=True))
            for section in builder.sealed([], o.index, o.minor, lengths):
                out.write(section)
    finally:
        shutil.rmtree(work, ignore_errors=True)


# --- in one task


def _planned(batches: Iterator[pa.RecordBatch], work: str, linked: bool, o: Options) -> Iterator[pa.RecordBatch]:
    """Writes the layout of the contents and the sealed sections after the blocks, but the index.

    Yields how many blocks there are, the bytes they hold, and the types and lengths of the sections.
    A task that runs twice writes the same files; they get their names when they are whole.
    """
    for _ in batches:
        tables, layout = _tables(pq.read_table(f"{work}/files"), pq.read_table(f"{work}/links") if linked else None, o)
        part = f"{work}/{uuid.uuid4().hex}.part"
        pq.write_table(layout, part)
        os.replace(part, f"{work}/layout.parquet")
        blocks, stored = tables.blocks, tables.stored
        del layout
        with open(part, "wb") as f:
            sections = builder.last_sections(*builder.metadata_of(tables, o), o)
            lengths = [f.write(builder.seal(blocks + i, *x, o.minor)) for i, x in enumerate(sections)]
        os.replace(part, f"{work}/last")
        yield pa.RecordBatch.from_pylist([{"blocks": blocks, "stored": stored, "kinds": [x[0] for x in sections], "lengths": lengths}])


def _texts(column: pa.ChunkedArray) -> np.ndarray:
    """A column of texts as an array of as wide ones, without an object for each."""
    out = np.zeros((len(column), max([int(pa.compute.max(pa.compute.binary_length(column)).as_py() or 0), 1])), np.uint8)
    at = 0
    for chunk in filter(len, column.chunks):
        chunk = chunk.cast(pa.large_binary())
        ends = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        held = np.arange(out.shape[1]) < np.diff(ends)[:, None]
        out[at : at + len(chunk)][held] = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        at += len(chunk)
    return out.view(f"S{out.shape[1]}").ravel()


def _names(table: pa.Table | None) -> np.ndarray:
    return np.zeros(0, "S1") if table is None or not table.num_rows else _texts(table["name"])


def _folders(table: pa.Table | None) -> tuple[np.ndarray, list[tuple[bytes, ...]]]:
    """Of each row the position of its folder, and the folders."""
    if table is None or not table.num_rows:
        return np.zeros(0, np.int64), []
    coded = table["folder"].cast(pa.large_string()).combine_chunks().dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), [tuple(x for x in f.encode().split(b"\0") if x) for f in coded.dictionary.to_pylist()]


def _merged(files: np.ndarray, others: set[bytes]) -> tuple[list[bytes], np.ndarray, dict[bytes, int]]:
    """All names sorted, and where the sorted ``files`` and the others are among them."""
    held = files.tolist()
    extra = sorted(x for x in others if (i := bisect_left(held, x)) == len(held) or held[i] != x)
    before = np.array([bisect_left(held, x) for x in extra], np.int64)
    at = np.arange(len(held)) + np.searchsorted(before, np.arange(len(held)), "right")
    where = {x: int(at[i]) for x in others if (i := bisect_left(held, x)) < len(held) and held[i] == x}
    return sorted(held + extra), at, where | {x: int(before[i]) + i for i, x in enumerate(extra)}


def _tables(files: pa.Table, links: pa.Table | None, o: Options) -> tuple[Tables, pa.Table]:
    """The metadata, and where the bytes of each content start: folder, name, digest, start of its first file."""
    (file_folder, file_folders), (link_folder, link_folders) = _folders(files), _folders(links)
    dirs = sorted({f[:n] for f in file_folders + link_folders for n in range(len(f) + 1)} | {()})
    number = {f: i for i, f in enumerate(dirs)}

    file_names, link_names = _names(files), _names(links)
    distinct, which = np.unique(np.concatenate([file_names, link_names]), return_inverse=True)
    names, at, name_of = _merged(distinct, {f[-1] for f in dirs if f})
    file_name, link_name = at[which[: len(file_names)]], at[which[len(file_names) :]]
    del file_names, link_names, distinct, which
    file_dir = np.array([number[f] for f in file_folders], np.int64)[file_folder]
    link_dir = np.array([number[f] for f in link_folders], np.int64)[link_folder]

    # files and links in order of their paths; one of each path
    digests = np.frombuffer(files["digest"].cast(pa.binary(32)).combine_chunks().buffers()[1] or b"", "S32", files.num_rows) if files.num_rows else np.zeros(0, "S32")
    order = np.lexsort((digests, file_name, file_dir))
    order = order[_last(file_dir[order], file_name[order])]
    file_dir, file_name, digests, size = file_dir[order], file_name[order], digests[order], files["size"].to_numpy()[order]
    link_order = np.lexsort((link_name, link_dir))
    link_order = link_order[_last(link_dir[link_order], link_name[link_order])]
    link_dir, link_name = link_dir[link_order], link_name[link_order]

    # contents: first those of one file, then those of several, each by its first file
    _, first, content, copies = np.unique(digests, return_index=True, return_inverse=True, return_counts=True)
    by_place = np.lexsort((first, copies > 1))
    slot = np.empty(len(first), np.int64)
    slot[by_place] = np.arange(len(first))
    slot, first, copies = slot[content], first[by_place], copies[by_place]
    unique, length = int((copies == 1).sum()), size[first]
    end = np.cumsum(length)
    start = end - length
    stored = int(end[-1]) if len(end) else 0

    # chunks: where the ends of blocks cut the contents
    block = start // o.block_size
    n = np.where(length > 0, (end - 1) // o.block_size - block + 1, 0)
    firsts = np.concatenate([[0], np.cumsum(n)])
    step = np.arange(firsts[-1]) - np.repeat(firsts[:-1], n)
    chunk = np.repeat(block, n) + step
    from_, to = np.maximum(np.repeat(start, n), chunk * o.block_size), np.minimum(np.repeat(end, n), (chunk + 1) * o.block_size)
    chunks = Columns([chunk, from_ - chunk * o.block_size, to - from_])

    # inodes: directories, links, files of contents of their own, files of shared ones
    inode = len(dirs) + len(link_dir) + slot
    shared = np.flatnonzero(copies[slot] > 1)
    shared = shared[np.argsort(slot[shared], kind="stable")]
    inode[shared] = len(dirs) + len(link_dir) + unique + np.arange(len(shared))
    modes = [0o040755, 0o100644, 0o120777]
    a, m, c = o.times or (0, 0, 0)
    mode = np.repeat(np.array([0, 2, 1], np.uint8), [len(dirs), len(link_dir), len(slot)])
    inodes = Columns([mode, *(np.broadcast_to(np.uint64(x), len(mode)) for x in (0, 0, a, m, c, 0))])

    # entries: by directory and name; the root's own before them
    below = [f for f in dirs if f]
    entry_dir = np.concatenate([file_dir, link_dir, np.array([number[f[:-1]] for f in below], np.int64)])
    entry_name = np.concatenate([file_name, link_name, np.array([name_of[f[-1]] for f in below], np.int64)])
    entry_inode = np.concatenate([inode, len(dirs) + np.arange(len(link_dir)), np.array([number[f] for f in below], np.int64)])
    order_ = np.lexsort((entry_name, entry_dir))
    entries = Columns([np.concatenate([[0], x[order_]]) for x in (entry_name, entry_inode)])
    first_entry = 1 + np.searchsorted(entry_dir[order_], np.arange(len(dirs) + 1))
    own = np.flatnonzero(entries.columns[1] < len(dirs))
    self_entry = np.zeros(len(dirs), np.int64)
    self_entry[entries.columns[1][own]] = own
    rows = [(int(self_entry[number[f[:-1]]]) if f else 0, int(first_entry[i]), int(self_entry[i])) for i, f in enumerate(dirs)] + [(0, int(first_entry[-1]), 0)]

    targets, link_targets = [], []
    if len(link_order):
        held, which = np.unique(_texts(links["target"])[link_order], return_inverse=True)
        targets, link_targets = held.tolist(), which
    tables = Tables(chunks, rows, inodes, firsts, modes, names, entries, link_targets, targets, slot[shared] - unique, [], [], int(size.sum()), stored, -(-stored // o.block_size))
    where = pa.array(order[first[length > 0]])
    layout = pa.table({k: files[k].take(where) for k in ("folder", "name", "digest")} | {"start": start[length > 0]}, pa.schema([("folder", pa.string()), ("name", pa.string()), ("digest", pa.binary()), ("start", pa.int64())]))
    return tables, layout


def _last(*keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the next one, in sorted columns."""
    out = np.ones(len(keys[0]), bool)
    out[:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


# --- on executors


def _pieces(batches: Iterator[pa.RecordBatch], block_size: int, each: int) -> Iterator[pa.RecordBatch]:
    """Contents (start, content) cut where blocks end; ``each``: blocks of a part."""
    out: list[tuple[int, int, int, bytes]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t.type) for x, t in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    for b in batches:
        for start, content in zip(b.column("start").to_pylist(), b.column("content"), strict=True):
            data, at = memoryview(content.as_buffer()), 0
            while at < len(data):
                block, inside = divmod(start + at, block_size)
                part = data[at : at + block_size - inside]
                out.append((block // each, block, inside, bytes(part)))
                at += len(part)
                held += len(part)
                if held >= PART:
                    yield batch()
                    out, held = [], 0
    if out:
        yield batch()


def _assembled(batches: Iterator[pa.RecordBatch], to: str, codec: str, minor: int, each: int) -> Iterator[pa.RecordBatch]:
    """Sorted pieces put together, sealed and written; yields the length of each sealed block and of what it holds.

    A part's file gets its name when it is whole, so a task that runs twice leaves the same file.
    """
    number, data, out, part, done = -1, bytearray(), None, f"{to}/{uuid.uuid4().hex}.part", []

    def flush() -> None:
        nonlocal data
        if number >= 0:
            sealed = builder.seal(number, 0, builder._CODECS[codec], builder.pack(codec, bytes(data)), minor)
            out.write(sealed)
            done.append((number, len(sealed), len(data)))
            data = bytearray()

    def close() -> None:
        if out:
            out.close()
            os.replace(part, f"{to}/{number // each}")

    for b in batches:
        for block, at, piece in zip(b.column("block").to_pylist(), b.column("at").to_pylist(), b.column("bytes"), strict=True):
            if block != number:
                flush()
                if number < 0 or block // each != number // each:
                    close()
                    out = open(part, "wb")  # noqa: SIM115
                number = block
            if at > len(data):
                raise OSError(f"nothing at {len(data)} of block {block}")
            if at == len(data):  # else a row that is there twice
                data += memoryview(piece.as_buffer())
    flush()
    close()
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64()) for k in range(3)], schema=_SEALED)

"""The tables of an image's metadata, as Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cairn.errors import DecodeError, NotAnImage, UnsupportedFeature
from cairn.sources import container
from cairn.sources.container import Image
from cairn.sources.frozen import Schema, Value
from cairn.sources.fsst import Symbols
from cairn.sources.thrift import text

SCHEMA_CAP = 1 << 20
METADATA_CAP = 64 << 20
FEATURES = {"sparsefiles"}
# Field ids of the root and of the structs in its lists.
ROOT = {"chunks": 1, "directories": 2, "inodes": 3, "chunk_table": 4, "symlink_table": 6, "uids": 7, "gids": 8, "modes": 9, "devices": 17, "dir_entries": 19, "shared_files": 20, "category_names": 28, "block_categories": 29, "large_holes": 35}
STRUCTS = {
    "chunks": {"block": 1, "offset": 2, "size": 3},
    "directories": {"parent_entry": 1, "first_entry": 2, "self_entry": 3},
    "inodes": {"mode_index": 2, "owner_index": 4, "group_index": 5, "atime_offset": 6, "mtime_offset": 7, "ctime_offset": 8, "btime_offset": 9, "atime_subsec": 10, "mtime_subsec": 11, "ctime_subsec": 12, "btime_subsec": 13, "nlink_minus_one": 14},
    "dir_entries": {"name_index": 1, "inode": 2},
}
#: Name of the position, and of the value in lists of plain integers.
INTEGERS = {"chunk_table": ("slot", "first_chunk"), "symlink_table": ("slot", "symlink_index"), "uids": ("idx", "value"), "gids": ("idx", "value"), "modes": ("idx", "value"), "devices": ("idx", "rdev"), "shared_files": ("slot", "value"), "block_categories": ("block", "category"), "large_holes": ("idx", "bytes")}
STRINGS = {"names": (24, 10), "symlinks": (25, 11)}
_FLAGS = {"mtime_only": 1, "packed_chunk_table": 3, "packed_directories": 4, "packed_shared_files_table": 5, "has_btime": 7, "inodes_have_nlink": 8}


def signed(x: np.ndarray) -> np.ndarray:
    if len(x) and int(x.max()) >> 63:
        raise DecodeError("a value of 2^63 or more")
    return x.astype(np.int64)


class Metadata:
    def __init__(self, image: Image, schema_cap: int = SCHEMA_CAP, cap: int = METADATA_CAP):
        found = image.find(container.SCHEMA), image.find(container.METADATA)
        if None in found:
            raise NotAnImage("no metadata")
        self.schema = Schema.parse(image.decompressed(found[0], schema_cap))
        self.data = image.decompressed(found[1], cap)
        self.root = Value.root(self.schema, self.data)
        if unknown := sorted(set(self.features()) - FEATURES):
            raise UnsupportedFeature(", ".join(unknown))

    def list(self, table: str) -> Value:
        return self.root[ROOT[table]].unwrapped() or Value(self.schema, self.root.data, None)

    def features(self) -> list[str]:
        held = self.root[27].unwrapped()
        return [text(x) for x in held.strings()] if held else []

    def _optional(self, fid: int) -> int | None:
        held = self.root[fid].unwrapped()
        return None if held is None else held.integer()

    def superblock(self) -> dict:
        for fid, name in ((12, "timestamp_base"), (15, "block_size"), (16, "total_fs_size")):
            if self.root[fid].layout is None:
                raise DecodeError(f"metadata: no {name}")
        options = self.root[18].unwrapped()
        resolution = options[2].unwrapped() if options else None
        subsecond = options[6].unwrapped() if options else None
        out = {"timestamp_base": self.root[12].integer(), "block_size": self.root[15].integer(), "total_fs_size": self.root[16].integer(), "preferred_path_separator": self._optional(26), "hole_block_index": self._optional(34), "total_allocated_fs_size": self._optional(36), "features": self.features()}
        out |= {k: bool(options[fid].integer()) if options else False for k, fid in _FLAGS.items()}
        return out | {"time_resolution_sec": resolution.integer() if resolution else None, "subsecond_resolution": subsecond.integer() if subsecond else None}

    def count(self, table: str) -> int:
        if table in STRINGS:
            return len(self._strings(table)[0]) - 1
        return len(self.list(table))

    def batch(self, table: str, first: int = 0, last: int | None = None) -> pa.RecordBatch:
        """Rows ``first`` to ``last`` of a table."""
        n = self.count(table)
        last = n if last is None else min(last, n)
        at = np.arange(first, max(first, last), dtype=np.int64)
        if table in STRINGS:
            offsets, read = self._strings(table)
            return pa.RecordBatch.from_pydict({"idx": at, "bytes": pa.array([read(int(offsets[i]), int(offsets[i + 1])) for i in at], pa.binary())})
        held = self.list(table)
        if table == "category_names":
            return pa.RecordBatch.from_pydict({"idx": at, "name": pa.array([text(held.element(int(i)).string()) for i in at], pa.string())})
        if table in STRUCTS:
            key = "inode" if table in ("inodes", "directories") else "entry" if table == "dir_entries" else "idx"
            return pa.RecordBatch.from_pydict({key: at} | {k: signed(held.column(fid, first=first, last=last)) for k, fid in STRUCTS[table].items()})
        key, value = INTEGERS[table]
        return pa.RecordBatch.from_pydict({key: at, value: signed(held.column(first=first, last=last))})

    def _strings(self, table: str):
        """Offsets of a table's strings, and a function that reads one between two of them."""
        compact, plain = STRINGS[table]
        held = self.root[compact].unwrapped()
        if held is None:
            items = self.root[plain].unwrapped()
            n = len(items) if items else 0
            return np.arange(n + 1), lambda a, b: items.element(a).string()
        index = signed(held[3].column())
        if held[4].integer():
            index = np.concatenate(([0], np.cumsum(index) & 0xFFFFFFFF))
        if len(index) < 2:
            index = np.zeros(1, np.int64)
        symbols = held[2].unwrapped()
        table_ = Symbols(symbols.string()) if symbols is not None and len(symbols) else None
        data = held[1].string()

        def read(a: int, b: int) -> bytes:
            if not a <= b <= len(data):
                raise DecodeError("string table: an offset past its end")
            return table_.decode(data[a:b]) if table_ else data[a:b]

        return index, read

    def layouts(self) -> list[dict]:
        """Tables with rows: count, bits of an element, bytes that all take."""
        out = []
        names = {**{v: k for k, v in ROOT.items()}, 10: "names", 11: "symlinks"}
        for fid in sorted(names):
            held = self.root[fid].unwrapped()
            if held is None or held.kind() != "array" or not len(held):
                continue
            bits = max(1, self.schema.of(held.layout, 3).bits)
            out.append({"table": names[fid], "entries": len(held), "element_bits": bits, "bytes": -(-len(held) * bits // 8)})
        return out

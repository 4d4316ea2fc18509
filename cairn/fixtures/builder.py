"""A deterministic writer of image bytes from a tree, for tests and queries. Shares no code with the reader.

A tree is a dict from names to nodes: bytes (a regular file), a dict (a directory), ``Link`` (a symbolic link),
``Same`` (a hard link to another path), ``Holes`` (a file with holes), ``Device`` or ``Fifo``.
"""

from __future__ import annotations

import functools
import hashlib
import lzma
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard


@dataclass(frozen=True)
class Link:
    target: bytes


@dataclass(frozen=True)
class Same:
    path: str


@dataclass(frozen=True)
class Holes:
    """Parts in order: bytes, or the length of a hole."""

    parts: tuple


@dataclass(frozen=True)
class Device:
    rdev: int
    block: bool = False


@dataclass(frozen=True)
class Fifo:
    pass


@dataclass
class Options:
    block_size: int = 1 << 16
    codec: str = "none"
    metadata_codec: str = "none"
    packed: bool = False
    compact: bool = True
    fsst: bool = False
    index: bool = True
    minor: int = 5
    history: list[dict] | None = None
    categories: list[str] | None = None
    mtime: int = 1_700_000_000
    times: tuple[int, int, int] | None = None  # offsets of atime, mtime, ctime; None: mtime only
    resolution: int | None = None
    uid: int = 1000
    gid: int = 100
    aligned: bool = False  # byte-aligned list elements
    features: tuple[str, ...] = ()
    prefix: bytes = b""
    large_holes: bool = False
    extra: list[tuple[int, int, bytes]] = field(default_factory=list)  # more sections: type, codec, payload


_CODECS = {"none": 0, "lzma": 1, "zstd": 2, "lz4": 3, "lz4hc": 4, "brotli": 5}


def _leb(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def pack(codec: str, data: bytes) -> bytes:
    if codec == "zstd":
        return zstandard.ZstdCompressor(level=3).compress(data)
    if codec == "lzma":
        return lzma.compress(data, format=lzma.FORMAT_XZ, preset=1)
    if codec in ("lz4", "lz4hc"):
        return struct.pack("<I", len(data)) + (pa.Codec("lz4_raw").compress(data, asbytes=True) if data else b"")
    if codec == "brotli":
        return _leb(len(data)) + pa.Codec("brotli").compress(data, asbytes=True)
    return data


def seal(number: int, kind: int, codec: int, payload: bytes, minor: int = 5) -> bytes:
    """A section with both hashes."""
    head = struct.pack("<IHHQ", number, kind, codec, len(payload))
    quick, whole = xxhash.xxh3_64(head), hashlib.new("sha512_256")
    quick.update(payload)
    head = struct.pack("<Q", quick.intdigest()) + head
    whole.update(head)
    whole.update(payload)
    return b"".join([b"DWARFS", bytes([2, minor]), whole.digest(), head, payload])


# --- compact protocol


def _zig(n: int) -> bytes:
    return _leb((n << 1) ^ (n >> 63) if n >= 0 else (-n << 1) - 1)


def _field(last: int, fid: int, kind: int) -> bytes:
    return bytes([(fid - last) << 4 | kind]) if 0 < fid - last < 16 else bytes([kind]) + _zig(fid)


def record(fields: list[tuple[int, int, bytes]]) -> bytes:
    """A struct of (id, type, encoded value)."""
    out, last = b"", 0
    for fid, kind, data in fields:
        out += _field(last, fid, kind) + data
        last = fid
    return out + b"\0"


def _text(s: str | bytes) -> bytes:
    s = s.encode() if isinstance(s, str) else s
    return _leb(len(s)) + s


def _many(kind: int, items: list[bytes]) -> bytes:
    return (bytes([len(items) << 4 | kind]) if len(items) < 15 else bytes([0xF0 | kind]) + _leb(len(items))) + b"".join(items)


def history_payload(entries: list[dict]) -> bytes:
    out = []
    for e in entries:
        v = e.get("version", {})
        fields = [(i, 4, _zig(v.get(n, 0))) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]
        fields += [(4, 1 if v.get("is_release") else 2, b"")] + [(i, 8, _text(v[n])) for i, n in ((5, "git_rev"), (6, "git_branch"), (7, "git_desc")) if n in v]
        rows = [(1, 12, record(fields)), (2, 8, _text(e.get("system_id", ""))), (3, 8, _text(e.get("compiler_id", "")))]
        rows += [(4, 9, _many(8, [_text(x) for x in e["arguments"]]))] if "arguments" in e else []
        rows += [(5, 6, _zig(e["timestamp"]))] if "timestamp" in e else []
        rows += [(6, 10, _many(8, [_text(x) for x in e["library_versions"]]))] if "library_versions" in e else []
        out.append(record(rows))
    return record([(1, 9, _many(12, out))])


# --- bit-packed metadata


@dataclass
class Columns:
    """Rows of integers as an array for each column."""

    columns: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.columns[0])


class _Writer:
    """Lays out a root struct of 8-byte-aligned fields; what lists hold comes after it."""

    def __init__(self, aligned: bool):
        self.layouts: list[bytes] = []
        self.root: list[tuple[int, int, int]] = []  # id, layout, byte
        self.cells: list[tuple[int, int]] = []  # byte, 64-bit value
        self.blobs: list[tuple[int, int, bytes, int]] = []  # byte of the range, byte of its distance, data, count
        self.at = 0
        self.aligned = aligned

    def layout(self, size: int, bits: int, fields: list[tuple[int, int, int]] = ()) -> int:
        """``fields``: id, layout, offset."""
        f = b"" if not fields else _leb(len(fields)) + bytes([4 << 4 | 12]) + b"".join(_zig(i) + record([(1, 4, _zig(k)), (2, 4, _zig(o))]) for i, k, o in fields)
        self.layouts.append(record([(1, 5, _zig(size)), (2, 4, _zig(bits))] + ([(3, 11, f)] if fields else [])))
        return len(self.layouts) - 1

    def put(self, n: int) -> int:
        at = self.at
        self.at += n
        return at

    def number(self, fid: int, value: int) -> None:
        self.root.append((fid, self.layout(8, 64), at := self.put(8)))
        self.cells.append((at, value))

    def range_layout(self, item: int | None) -> int:
        return self.layout(16, 128, [(1, self.layout(8, 64), 0), (2, self.layout(8, 64), 8)] + ([(3, item, 0)] if item is not None else []))

    def _range(self, at: int, data: bytes, count: int) -> None:
        self.blobs.append((at, at, data, count))

    def numbers(self, values: Sequence[int]) -> tuple[int, bytes]:
        """Item layout and data."""
        column = np.asarray(values, np.uint64)
        bits = _width(column)
        if self.aligned and bits:
            size = -(-bits // 8)
            return self.layout(size, bits), _bytes([column], [size])
        return self.layout(0, bits), _bits([column], [bits])

    def structs(self, ids: list[int], rows: Sequence[tuple] | Columns) -> tuple[int, bytes]:
        columns = [np.asarray(c) for c in rows.columns] if isinstance(rows, Columns) else list(np.asarray(rows, np.uint64).reshape(-1, len(ids)).T)
        widths = [_width(c) for c in columns]
        if self.aligned:
            sizes, at, fields = [-(-w // 8) for w in widths], 0, []
            for fid, w, s in zip(ids, widths, sizes, strict=True):
                fields.append((fid, self.layout(s, w), at))
                at += s
            return self.layout(at, at * 8, fields), _bytes(columns, sizes)
        fields, at = [], 0
        for fid, w in zip(ids, widths, strict=True):
            fields.append((fid, self.layout(0, w), -at if at else 0))
            at += w
        return self.layout(0, at, fields), _bits(columns, widths)

    def list(self, fid: int, item: int, data: bytes, count: int) -> None:
        self.root.append((fid, self.range_layout(item), at := self.put(16)))
        self._range(at, data, count)

    def optional(self, fid: int, inner: int, size: int) -> int:
        """A set optional; returns where its value goes."""
        flag = self.layout(0, 1)
        self.root.append((fid, self.layout(8 + size, 64 + size * 8, [(1, flag, 0), (2, inner, 8)]), at := self.put(8 + size)))
        self.cells.append((at, 1))
        return at + 8

    def optional_list(self, fid: int, item: int, data: bytes, count: int) -> None:
        self._range(self.optional(fid, self.range_layout(item), 16), data, count)

    def texts(self, items: list[bytes]) -> tuple[int, bytes]:
        """Item layout and data of a plain list of strings: distances are from each element."""
        lengths = np.array([len(s) for s in items], np.int64)
        starts = 16 * len(items) + np.cumsum(lengths) - lengths - 16 * np.arange(len(items))
        return self.range_layout(None), np.stack([starts, lengths], 1).astype("<u8").tobytes() + b"".join(items)

    def string_table(self, fid: int, items: list[bytes], packed: bool, symbols: list[bytes] | None) -> None:
        coded = [fsst_encode(symbols, s) for s in items] if symbols else items
        lengths = np.array([len(s) for s in coded], np.int64)
        item, index = self.numbers(lengths if packed else np.cumsum([0, *lengths]))
        flag, text, rng = self.layout(0, 1), self.range_layout(None), self.range_layout(item)
        opt = self.layout(24, 192, [(1, flag, 0), (2, text, 8)])
        table = self.layout(72, 576, [(1, text, 0), (2, opt, 16), (3, rng, 40), (4, flag, 56)])
        at = self.optional(fid, table, 72)
        self._range(at, b"".join(coded), sum(map(len, coded)))
        if symbols:
            self.cells.append((at + 16, 1))
            self._range(at + 24, raw := fsst_table(symbols), len(raw))
        self._range(at + 40, index, len(items) + (not packed))
        self.cells.append((at + 56, int(packed)))

    def finish(self) -> tuple[bytes, bytes]:
        """Schema and data."""
        root = self.layout(self.at, self.at * 8, [(i, k, o) for i, k, o in sorted(self.root)])
        head, size = bytearray(self.at), self.at
        for at, v in self.cells:
            head[at : at + 8] = struct.pack("<Q", v)
        for at, cell, blob, count in self.blobs:
            head[cell : cell + 16] = struct.pack("<QQ", size - at if count else 0, count)
            size += len(blob)
        schema = record([(2, 11, _leb(len(self.layouts)) + bytes([4 << 4 | 12]) + b"".join(_zig(i) + x for i, x in enumerate(self.layouts))), (3, 4, _zig(root)), (4, 5, _zig(1))])
        return schema, b"".join([head, *(blob for _, _, blob, _ in self.blobs)])


def _width(column: np.ndarray) -> int:
    return int(column.max()).bit_length() if len(column) else 0


def _octets(column: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(column, "<u8").view(np.uint8).reshape(-1, 8)


def _bytes(columns: list[np.ndarray], sizes: list[int]) -> bytes:
    return np.hstack([_octets(c)[:, :n] for c, n in zip(columns, sizes, strict=True)]).tobytes()


def _bits(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """Rows of integers of so many bits each, one after another; a step of rows ends at a byte."""
    out, step = [], 1 << 14
    for i in range(0, len(columns[0]) if any(widths) else 0, step):
        bits = [np.unpackbits(_octets(c[i : i + step]), axis=1, bitorder="little")[:, :w] for c, w in zip(columns, widths, strict=True)]
        out.append(np.packbits(np.hstack(bits).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def fsst_table(symbols: list[bytes]) -> bytes:
    """``symbols`` must be in the order of their codes: lengths 2 to 8, then 1."""
    counts = [sum(len(s) == k for s in symbols) for k in range(1, 9)]
    return struct.pack("<QB8B", 20190218 << 32, 0, *counts) + b"".join(symbols)


@functools.lru_cache(4)
def _fsst_codes(symbols: tuple[bytes, ...]) -> tuple[re.Pattern, dict[bytes, bytes]]:
    """What finds the longest symbol or a byte, and the code of each."""
    longest = sorted(symbols, key=lambda s: -len(s))
    codes = {bytes([x]): bytes([255, x]) for x in range(256)}
    return re.compile(b"|".join([*map(re.escape, longest), b"."]), re.DOTALL), codes | {s: bytes([i]) for i, s in reversed(list(enumerate(symbols)))}


def fsst_encode(symbols: list[bytes], text: bytes) -> bytes:
    find, codes = _fsst_codes(tuple(symbols))
    return b"".join([codes[s] for s in find.findall(text)])


# --- images


@dataclass
class Tables:
    """What the metadata of an image says, as lists or arrays."""

    chunks: Sequence[tuple]  # block, offset, size
    directories: Sequence[tuple]  # parent_entry, first_entry, self_entry
    inodes: Sequence[tuple]  # mode, owner, group, atime, mtime, ctime, nlink - 1
    firsts: Sequence[int]
    modes: Sequence[int]
    names: list[bytes]
    entries: Sequence[tuple]  # name, inode
    link_targets: Sequence[int]
    targets: list[bytes]
    groups: Sequence[int]
    devices: Sequence[int]
    large: Sequence[int]
    total: int  # bytes of all files
    stored: int  # bytes in blocks
    blocks: int
    hole_block: int | None = None


def metadata_of(t: Tables, o: Options) -> tuple[bytes, bytes]:
    """Schema and data."""
    w = _Writer(o.aligned)
    w.list(1, *w.structs([1, 2, 3], t.chunks), len(t.chunks))
    if o.packed:
        w.list(2, *w.structs([2], np.diff([r[1] for r in t.directories], prepend=0)), len(t.directories))
    else:
        w.list(2, *w.structs([1, 2, 3], t.directories), len(t.directories))
    w.list(3, *w.structs([2, 4, 5, 6, 7, 8, 14], t.inodes), len(t.inodes))
    w.list(4, *w.numbers(np.diff(t.firsts, prepend=0) if o.packed else t.firsts), len(t.firsts))
    w.list(6, *w.numbers(t.link_targets), len(t.link_targets))
    for fid, values in ((7, [o.uid]), (8, [o.gid]), (9, t.modes)):
        w.list(fid, *w.numbers(values), len(values))
    if o.compact:
        table = [b"th", b"in", b".txt", *(bytes([x]) for x in b"aeiorst/")] if o.fsst else None
        table = sorted(table, key=lambda s: (len(s) == 1, len(s))) if table else None
        w.string_table(24, t.names, o.packed, table)
        w.string_table(25, t.targets, o.packed, table)
    else:
        w.list(10, *w.texts(t.names), len(t.names))
        w.list(11, *w.texts(t.targets), len(t.targets))
    w.number(12, o.mtime)
    w.number(15, o.block_size)
    w.number(16, t.total)
    if len(t.devices):
        w.optional_list(17, *w.numbers(t.devices), len(t.devices))
    flag = w.layout(0, 1)
    wide = w.layout(8, 64)
    res = w.layout(16, 128, [(1, flag, 0), (2, wide, 8)])
    where = w.optional(18, w.layout(64, 512, [(1, flag, 0), (2, res, 8), (3, flag, 24), (4, flag, 32), (5, flag, 40), (8, flag, 48)]), 64)
    for off, v in ((0, o.times is None), (8, o.resolution is not None), (16, o.resolution or 0), (24, o.packed), (32, o.packed), (40, o.packed), (48, 1)):
        w.cells.append((where + off, int(v)))
    w.list(19, *w.structs([1, 2], t.entries), len(t.entries))
    if len(t.groups):
        values = np.bincount(t.groups) - 2 if o.packed else t.groups
        w.optional_list(20, *w.numbers(values), len(values))
    w.cells.append((w.optional(26, wide, 8), 47))
    features = [*o.features, *(["sparsefiles"] if t.hole_block is not None else [])]
    if features:
        w.optional_list(27, *w.texts([f.encode() for f in features]), len(features))
    if o.categories:
        distinct = sorted(set(o.categories))
        w.optional_list(28, *w.texts([x.encode() for x in distinct]), len(distinct))
        w.optional_list(29, *w.numbers([distinct.index(o.categories[i % len(o.categories)]) for i in range(t.blocks)]), t.blocks)
    if t.hole_block is not None:
        w.cells.append((w.optional(34, wide, 8), t.hole_block))
    if len(t.large):
        w.optional_list(35, *w.numbers(t.large), len(t.large))
    w.cells.append((w.optional(36, wide, 8), t.stored))
    return w.finish()


def build(root: dict, options: Options | None = None) -> bytes:
    """The image of a tree."""
    o = options or Options()
    dirs: list[tuple[dict, int]] = []  # contents, inode of the parent
    links: list[Link] = []
    files: dict[bytes | Holes, list[str]] = {}
    special: list[Device | Fifo] = []
    paths: dict[str, object] = {}
    counts: dict[str, int] = {}

    def visit(node: dict, parent: int, at: str) -> None:
        me = len(dirs)
        dirs.append((node, parent))
        for name in sorted(node, key=lambda n: n.encode() if isinstance(n, str) else n):
            child, path = node[name], f"{at}/{name}"
            if isinstance(child, dict):
                continue
            paths[path] = child
            if isinstance(child, Link):
                links.append(child)
            elif isinstance(child, bytes | Holes):
                files.setdefault(child, []).append(path)
            elif isinstance(child, Device | Fifo):
                special.append(child)
            elif isinstance(child, Same):
                counts[child.path] = counts.get(child.path, 1) + 1
        for name in sorted(node, key=lambda n: n.encode() if isinstance(n, str) else n):
            if isinstance(node[name], dict):
                visit(node[name], me, f"{at}/{name}")

    visit(root, 0, "")
    unique = [(c, p[0]) for c, p in files.items() if len(p) == 1]
    shared = [(c, p) for c, p in files.items() if len(p) > 1]
    inode: dict[str, int] = {}
    n = len(dirs)
    link_at = n
    seen_links = 0
    link_paths = [p for p, c in paths.items() if isinstance(c, Link)]
    for p in link_paths:
        inode[p] = link_at + seen_links
        seen_links += 1
    n = link_at + len(link_paths)
    for _, p in unique:
        inode[p] = n
        n += 1
    groups: list[int] = []
    for g, (_, ps) in enumerate(shared):
        for p in ps:
            inode[p] = n
            n += 1
            groups.append(g)
    specials = [p for p, c in paths.items() if isinstance(c, Device)] + [p for p, c in paths.items() if isinstance(c, Fifo)]
    for p in specials:
        inode[p] = n
        n += 1

    # blocks and chunks
    blocks, current = [], bytearray()
    hole_block = None
    chunks: list[tuple[int, int, int]] = []
    firsts: list[int] = []
    large: list[int] = []
    holes = any(isinstance(c, Holes) for c in files)
    for content in [c for c, _ in unique] + [c for c, _ in shared]:
        firsts.append(len(chunks))
        for part in content.parts if isinstance(content, Holes) else (content,):
            if isinstance(part, int):
                if o.large_holes:
                    chunks.append((-1, 0xFFFFFFFF, len(large)))
                    large.append(part)
                else:
                    chunks.append((-1, part % o.block_size, part // o.block_size))
                continue
            at = 0
            while at < len(part):
                if len(current) == o.block_size:
                    blocks.append(bytes(current))
                    current = bytearray()
                take = min(len(part) - at, o.block_size - len(current))
                chunks.append((len(blocks), len(current), take))
                current += part[at : at + take]
                at += take
    firsts.append(len(chunks))
    if current:
        blocks.append(bytes(current))
    if holes:
        hole_block = len(blocks)
        chunks = [(hole_block if b < 0 else b, off, s) for b, off, s in chunks]

    # directories
    names: dict[bytes, int] = {}
    for node, _ in dirs:
        for name in node:
            names.setdefault(name.encode() if isinstance(name, str) else name, 0)
    names = {k: i for i, k in enumerate(sorted(names))}
    dir_number = {id(node): i for i, (node, _) in enumerate(dirs)}
    entries: list[tuple[int, int]] = [(0, 0)]
    first_entry: list[int] = []
    self_entry = [0] * len(dirs)
    at_path = {id(root): ""}
    for node, _ in dirs:
        first_entry.append(len(entries))
        for name in sorted(node, key=lambda k: k.encode() if isinstance(k, str) else k):
            child, path = node[name], f"{at_path[id(node)]}/{name}"
            if isinstance(child, dict):
                at_path[id(child)] = path
                number = dir_number[id(child)]
                self_entry[number] = len(entries)
            else:
                number = inode[child.path] if isinstance(child, Same) else inode[path]
            entries.append((names[name.encode() if isinstance(name, str) else name], number))
    first_entry.append(len(entries))
    rows = [(self_entry[p], f, s) for (_, p), f, s in zip(dirs, first_entry, self_entry, strict=False)] + [(0, first_entry[-1], 0)]

    # inodes
    modes = sorted({0o040755, 0o120777, 0o100644, *(0o060600 if c.block else 0o020600 for c in special if isinstance(c, Device)), *(0o010600 for c in special if isinstance(c, Fifo))})
    kinds = [0o040755] * len(dirs) + [0o120777] * len(link_paths) + [0o100644] * (len(unique) + len(groups))
    kinds += [0o010600 if isinstance(paths[p], Fifo) else 0o060600 if paths[p].block else 0o020600 for p in specials]
    by_inode = {v: k for k, v in inode.items()}
    a, m, c = o.times or (0, 0, 0)
    inodes = [(modes.index(k), 0, 0, a, m, c, counts.get(by_inode.get(i, ""), 1) - 1) for i, k in enumerate(kinds)]

    target_at = {t: i for i, t in enumerate(sorted({x.target for x in links}))}
    sizes = [sum(p if isinstance(p, int) else len(p) for p in (x.parts if isinstance(x, Holes) else (x,))) for x in [c for c, _ in unique] + [c for c, ps in shared for _ in ps]]
    devices = [paths[p].rdev for p in specials if isinstance(paths[p], Device)]
    tables = Tables(chunks, rows, inodes, firsts, modes, list(names), entries, [target_at[paths[p].target] for p in link_paths], list(target_at), groups, devices, large, sum(sizes), sum(map(len, blocks)), len(blocks), hole_block)
    schema, metadata = metadata_of(tables, o)

    sections = [(0, _CODECS[o.codec], pack(o.codec, b)) for b in blocks]
    return o.prefix + join(sections + last_sections(schema, metadata, o), o.index, o.minor)


def last_sections(schema: bytes, metadata: bytes, o: Options) -> list[tuple[int, int, bytes]]:
    """What comes after the blocks: type, codec, payload."""
    out = [(7, _CODECS[o.metadata_codec], pack(o.metadata_codec, schema)), (8, _CODECS[o.metadata_codec], pack(o.metadata_codec, metadata))]
    return out + ([(10, 0, history_payload(o.history))] if o.history is not None else []) + o.extra


def join(sections: list[tuple[int, int, bytes]], index: bool = True, minor: int = 5) -> bytes:
    """Sealed sections one after another, with an index after them if wanted."""
    return b"".join(sealed(sections, index, minor))


def sealed(sections: list[tuple[int, int, bytes]], index: bool = True, minor: int = 5, before: Iterable[tuple[int, int]] = ()) -> Iterator[bytes]:
    """``before``: types and lengths of the sealed sections that stand before these."""
    entries, at = [], 0
    for kind, n in before:
        entries.append(kind << 48 | at)
        at += n
    for number, (kind, codec, payload) in enumerate(sections, len(entries)):
        entries.append(kind << 48 | at)
        out = seal(number, kind, codec, payload, minor)
        at += len(out)
        yield out
    if index:
        entries.append(9 << 48 | at)
        yield seal(len(entries) - 1, 9, 0, struct.pack(f"<{len(entries)}Q", *entries), minor)

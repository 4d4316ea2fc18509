"""Sections of an image: where it begins in its source, headers, index, hashes, payloads."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

from cairn.errors import BadMagic, CorruptSectionIndex, IntegrityMismatch, NotAnImage, TruncatedHeader, TruncatedSection, UnsupportedVersion
from cairn.sources import codecs
from cairn.sources.bytesource import MemorySource, Source, WindowedSource, open_source

# Fixed values of the format.
MAGIC = b"DWARFS"
HEADER_LEN = 64
MAJOR = 2
MINOR = 6
SHA_FROM = 0x28
XXH_FROM = 0x30
BLOCK, SCHEMA, METADATA, INDEX, HISTORY = 0, 7, 8, 9, 10
SECTION_NAMES = {0: "block", 7: "metadata_v2_schema", 8: "metadata_v2", 9: "section_index", 10: "history"}

_HEADER = struct.Struct("<6sBB32sQIHHQ")
_PROBE = 64 << 10


@dataclass(frozen=True)
class Header:
    major: int
    minor: int
    sha512_256: bytes
    xxh3: int
    number: int
    kind: int
    compression: int
    payload_len: int

    @property
    def section_len(self) -> int:
        return HEADER_LEN + self.payload_len

    def write(self) -> bytes:
        return _HEADER.pack(MAGIC, self.major, self.minor, self.sha512_256, self.xxh3, self.number, self.kind, self.compression, self.payload_len)


@dataclass(frozen=True)
class Section:
    ordinal: int
    offset: int
    header: Header


def parse_header(data: bytes, offset: int = 0) -> Header:
    if len(data) - offset < HEADER_LEN:
        raise TruncatedHeader(f"{len(data) - offset} bytes at {offset}")
    magic, *rest = _HEADER.unpack_from(data, offset)
    if magic != MAGIC:
        raise BadMagic(f"at {offset}")
    header = Header(*rest)
    if header.major != MAJOR or header.minor > MINOR:
        raise UnsupportedVersion(f"{header.major}.{header.minor}")
    return header


def detect_base_offset(source: Source) -> int:
    """Where the first section begins: the first magic whose section ends at another one or at the source's end.

    The source is probed in windows that overlap, so a prefix of any length takes bounded memory.
    """
    version = None
    at = 0
    while at < source.size:
        window = source.read(at, min(_PROBE, source.size - at))
        i = window.find(MAGIC)
        while i >= 0:
            try:
                header = parse_header(source.read(at + i, min(HEADER_LEN, source.size - at - i)))
                end = at + i + header.section_len
                if end == source.size or end + len(MAGIC) <= source.size and source.read(end, len(MAGIC)) == MAGIC:
                    return at + i
            except UnsupportedVersion as e:
                version = version or e
            except TruncatedHeader:
                pass
            i = window.find(MAGIC, i + 1)
        if at + len(window) >= source.size:
            break
        at += len(window) - (len(MAGIC) - 1)
    raise version or NotAnImage("no section header was found")


def xxh3_64(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


class Image:
    """The sections of one image. Payloads are read when asked for."""

    def __init__(self, source: Source, base: int | None = None):
        self.source = source
        self.base = detect_base_offset(source) if base is None else base
        self.sections = self._walk()

    @classmethod
    def open(cls, path: str, offset: str | int = "auto", size: int | None = None) -> Image:
        """``offset`` "auto" looks for the image; with a ``size`` it means 0."""
        source = open_source(path)
        if size is not None:
            return cls(WindowedSource(source, 0 if offset == "auto" else int(offset), size))
        return cls(source) if offset == "auto" else cls(source, int(offset))

    @classmethod
    def from_bytes(cls, data: bytes) -> Image:
        return cls(MemorySource(data))

    def _walk(self) -> list[Section]:
        """The sections up to the end of the source, where the last one has to end; what follows an image needs a window."""
        out, at, end = [], self.base, self.source.size
        while at < end:
            if end - at < HEADER_LEN:
                raise TruncatedHeader(f"{end - at} bytes at {at}")
            header = parse_header(self.source.read(at, HEADER_LEN))
            if at + header.section_len > end:
                raise TruncatedSection(f"section {len(out)} at {at} ends past {end}")
            out.append(Section(len(out), at, header))
            at += header.section_len
        if not out:
            raise NotAnImage("no section")
        return out

    def find(self, kind: int) -> Section | None:
        return next((s for s in self.sections if s.header.kind == kind), None)

    def section_bytes(self, s: Section) -> bytes:
        return self.source.read(s.offset, s.header.section_len)

    def payload(self, s: Section) -> bytes:
        return self.source.read(s.offset + HEADER_LEN, s.header.payload_len)

    def index(self) -> list[tuple[int, int]] | None:
        """(section type, offset from the base) of the index section, or None if the image ends without one.

        The index is advice: sections are always found by their headers.
        """
        last = self.sections[-1]
        if last.header.kind != INDEX:
            return None
        if last.header.compression != 0:
            raise CorruptSectionIndex("it is compressed")
        data = self.payload(last)
        if len(data) % 8 or not data:
            raise CorruptSectionIndex(f"{len(data)} bytes")
        entries = [(x >> 48, x & ((1 << 48) - 1)) for (x,) in struct.iter_unpack("<Q", data)]
        if any(b[1] <= a[1] for a, b in zip(entries, entries[1:], strict=False)):
            raise CorruptSectionIndex("offsets don't rise")
        if entries[-1] != (INDEX, last.offset - self.base):
            raise CorruptSectionIndex("its last entry is not itself")
        return entries

    def indexed(self, kind: int) -> int | None:
        """The offset from the base that the index has for the first section of a type; None if it has none."""
        return next((at for k, at in self.index() or [] if k == kind), None)

    def xxh3_ok(self, s: Section, data: bytes | None = None) -> bool:
        """``data``: the section's bytes, where they have been read."""
        return xxh3_64((self.section_bytes(s) if data is None else data)[XXH_FROM:]) == s.header.xxh3

    def sha_ok(self, s: Section, data: bytes | None = None) -> bool:
        return hashlib.new("sha512_256", (self.section_bytes(s) if data is None else data)[SHA_FROM:]).digest() == s.header.sha512_256

    def verify(self, s: Section) -> None:
        """Raises unless both hashes hold."""
        if not self.xxh3_ok(s):
            raise IntegrityMismatch(f"section {s.ordinal}: xxh3")
        if not self.sha_ok(s):
            raise IntegrityMismatch(f"section {s.ordinal}: sha512_256")

    def decompressed(self, s: Section, cap: int) -> bytes:
        """The decoded payload; the quick hash is checked before anything is decoded."""
        if not self.xxh3_ok(s):
            raise IntegrityMismatch(f"section {s.ordinal}: xxh3")
        return codecs.decompress(s.header.compression, self.payload(s), cap)

    def decompressed_prefix(self, s: Section, needed: int) -> bytes | None:
        if not self.xxh3_ok(s):
            raise IntegrityMismatch(f"section {s.ordinal}: xxh3")
        return codecs.decompress_prefix(s.header.compression, self.payload(s), needed)

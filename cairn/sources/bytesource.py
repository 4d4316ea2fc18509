"""Random access to the bytes of an image: in memory, in a file, mapped, in a window of another source, or remote."""

from __future__ import annotations

import mmap
import os

from cairn.errors import SourceError, SourceOutOfBounds


class Source:
    """``size`` bytes that ``read(offset, length)`` returns in full or not at all."""

    size: int

    def _read(self, offset: int, length: int) -> bytes:
        raise NotImplementedError

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise SourceOutOfBounds(f"{length} bytes at {offset} of {self.size}")
        got = bytes(self._read(offset, length)) if length else b""
        if len(got) != length:
            raise SourceError(f"{len(got)} of {length} bytes at {offset}")
        return got

    def __len__(self) -> int:
        return self.size


class MemorySource(Source):
    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def _read(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length]


class FileSource(Source):
    """Positional reads, so one source can serve several threads."""

    def __init__(self, path: str):
        try:
            self.fd = os.open(path, os.O_RDONLY)
        except OSError as e:
            raise SourceError(str(e)) from e
        self.size = os.fstat(self.fd).st_size

    def _read(self, offset: int, length: int) -> bytes:
        out = []
        while length and (part := os.pread(self.fd, length, offset)):
            out.append(part)
            offset, length = offset + len(part), length - len(part)
        return b"".join(out)

    def __del__(self):
        if hasattr(self, "fd"):
            os.close(self.fd)


class MappedSource(Source):
    def __init__(self, path: str):
        try:
            with open(path, "rb") as f:
                self.size = os.fstat(f.fileno()).st_size
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if self.size else b""
        except OSError as e:
            raise SourceError(str(e)) from e

    def _read(self, offset: int, length: int) -> bytes:
        return self.map[offset : offset + length]


class StoreSource(Source):
    """A file of a store that Arrow can open, named by a URI."""

    def __init__(self, uri: str):
        from pyarrow import fs

        try:
            where, path = fs.FileSystem.from_uri(uri)
            self.file = where.open_input_file(path)
            self.size = self.file.size()
        except (OSError, ValueError) as e:
            raise SourceError(f"{uri}: {e}") from e

    def _read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)


class WindowedSource(Source):
    """``length`` bytes of another source from ``offset`` on; to its end if no length is given."""

    def __init__(self, inner: Source, offset: int, length: int | None = None):
        length = inner.size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > inner.size:
            raise SourceOutOfBounds(f"a window of {length} bytes at {offset} of {inner.size}")
        self.inner, self.offset, self.size = inner, offset, length

    def _read(self, offset: int, length: int) -> bytes:
        return self.inner.read(self.offset + offset, length)


def open_source(path: str, mapped: bool = False) -> Source:
    if path.startswith("file:"):
        path = path.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        return StoreSource(path)
    return MappedSource(path) if mapped else FileSource(path)

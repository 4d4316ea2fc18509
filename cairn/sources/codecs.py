"""Decoders of section payloads. Each bounds what it produces and raises ``CapExceeded`` beyond."""

from __future__ import annotations

import lzma
import struct

from cairn.errors import CapExceeded, CodecDisabled, CodecUnimplemented, DecodeError, UnknownCompression

# Compression ids and names.
NAMES = {0: "none", 1: "lzma", 2: "zstd", 3: "lz4", 4: "lz4hc", 5: "brotli", 6: "flac", 7: "ricepp"}


def codec_name(codec: int) -> str:
    return NAMES.get(codec, f"unknown({codec})")


def _zstandard():
    try:
        import zstandard
    except ImportError as e:
        raise CodecDisabled("zstd") from e
    return zstandard


def _arrow(name: str):
    try:
        import pyarrow as pa

        return pa.Codec(name)
    except (ImportError, ValueError, NotImplementedError) as e:
        raise CodecDisabled(name) from e


def _zstd(data: bytes, cap: int, needed: int | None) -> bytes:
    z = _zstandard()
    try:
        size = z.frame_content_size(data)
        if size > cap and needed is None:
            raise CapExceeded(f"zstd frame of {size} bytes, {cap} allowed")
        if size >= 0 and needed is None:
            return z.ZstdDecompressor().decompress(data, max_output_size=max(size, 1))
        limit = cap + 1 if needed is None else min(needed, cap)
        reader = z.ZstdDecompressor().stream_reader(data)
        out = []
        while limit and (part := reader.read(min(limit, 1 << 20))):
            out.append(part)
            limit -= len(part)
    except z.ZstdError as e:
        raise DecodeError(f"zstd: {e}") from e
    return b"".join(out)


def _xz(data: bytes, cap: int, needed: int | None) -> bytes:
    limit = cap + 1 if needed is None else min(needed, cap)
    d = lzma.LZMADecompressor(format=lzma.FORMAT_XZ)
    try:
        out = [d.decompress(data, max_length=limit)]
        left = limit - len(out[0])
        while left and not d.eof and not d.needs_input:
            out.append(part := d.decompress(b"", max_length=left))
            left -= len(part)
    except lzma.LZMAError as e:
        raise DecodeError(f"lzma: {e}") from e
    if needed is None and left and not d.eof:
        raise DecodeError("lzma: the stream ends early")
    return b"".join(out)


def _lz4(data: bytes, cap: int) -> bytes:
    if len(data) < 4:
        raise DecodeError("lz4: no size")
    (size,) = struct.unpack_from("<I", data)
    if size > cap:
        raise CapExceeded(f"lz4 block of {size} bytes, {cap} allowed")
    try:
        return _arrow("lz4_raw").decompress(data[4:], size, asbytes=True) if size else b""
    except OSError as e:
        raise DecodeError(f"lz4: {e}") from e


def _brotli(data: bytes, cap: int) -> bytes:
    import pyarrow as pa

    size = shift = at = 0
    while True:
        if at >= len(data) or shift > 63:
            raise DecodeError("brotli: no size")
        size |= (data[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if not data[at - 1] & 0x80:
            break
    if size > cap:
        raise CapExceeded(f"brotli stream of {size} bytes, {cap} allowed")
    _arrow("brotli")
    out, left = [], cap + 1
    try:
        with pa.CompressedInputStream(pa.BufferReader(data[at:]), "brotli") as stream:
            while left and (part := stream.read(min(left, 1 << 20))):
                out.append(part)
                left -= len(part)
    except OSError as e:
        raise DecodeError(f"brotli: {e}") from e
    return b"".join(out)


def decompress(codec: int, data: bytes, cap: int) -> bytes:
    """The payload decoded; at most ``cap`` bytes."""
    if codec == 0:
        out = data
    elif codec == 1:
        out = _xz(data, cap, None)
    elif codec == 2:
        out = _zstd(data, cap, None)
    elif codec in (3, 4):
        out = _lz4(data, cap)
    elif codec == 5:
        out = _brotli(data, cap)
    elif codec in NAMES:
        raise CodecUnimplemented(codec_name(codec))
    else:
        raise UnknownCompression(str(codec))
    if len(out) > cap:
        raise CapExceeded(f"{codec_name(codec)} payload of over {cap} bytes")
    return out


def decompress_prefix(codec: int, data: bytes, needed: int) -> bytes | None:
    """The first ``needed`` bytes of the decoded payload, or None if the codec can't stop early."""
    if codec == 1:
        return _xz(data, needed, needed)
    if codec == 2:
        return _zstd(data, needed, needed)
    return None

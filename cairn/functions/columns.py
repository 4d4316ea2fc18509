"""Expressions over columns of image tables. All stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.sources.codecs import NAMES
from cairn.sources.container import SECTION_NAMES

# Kinds of inodes by the type bits of a mode; the largest 32-bit value.
KINDS = {0o040000: "directory", 0o120000: "symlink", 0o100000: "regular", 0o020000: "char-device", 0o060000: "block-device", 0o010000: "fifo", 0o140000: "socket"}
U32 = 4294967295


def _case(value: Column, names: dict[int, str], other: Column) -> Column:
    first, *rest = names.items()
    return reduce(lambda c, kv: c.when(value == kv[0], kv[1]), rest, F.when(value == first[0], first[1])).otherwise(other)


def mode_kind(mode: Column) -> Column:
    return _case(mode.bitwiseAND(F.lit(0o170000)), KINDS, F.lit("unknown"))


def permissions(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(0o7777))


def _named(value: Column, names: dict[int, str]) -> Column:
    return _case(value, names, F.concat(F.lit("unknown("), value.cast("string"), F.lit(")")))


def section_type_name(kind: Column) -> Column:
    return _named(kind, SECTION_NAMES)


def compression_name(codec: Column) -> Column:
    return _named(codec, NAMES)


def section_len(payload_len: Column) -> Column:
    return payload_len + 64


def timestamp(base: Column, offset: Column, resolution: Column) -> Column:
    """Seconds since the epoch; an overflow is an error."""
    out = F.try_add(base, F.try_multiply(offset, F.coalesce(resolution, F.lit(1))))
    return F.coalesce(out, F.raise_error(F.lit("timestamp overflow")).cast("long"))


def hole_length(offset: Column, size: Column, block_size: Column, large: Column) -> Column:
    """Length of a hole; ``large`` is the length that ``size`` numbers in the table of large holes."""
    return F.when(offset == U32, large).otherwise(size * block_size + offset)


def chunk_length(block: Column, offset: Column, size: Column, hole: Column, block_size: Column, large: Column) -> Column:
    return F.when(block.eqNullSafe(hole) & hole.isNotNull(), hole_length(offset, size, block_size, large)).otherwise(size)


def device_major(rdev: Column) -> Column:
    return F.shiftrightunsigned(rdev, 32)


def device_minor(rdev: Column) -> Column:
    return rdev.bitwiseAND(F.lit(U32))


def makedev(major: Column, minor: Column) -> Column:
    """A device number in the layout of the C library's makedev."""
    low = minor.bitwiseAND(F.lit(0xFF)).bitwiseOR(F.shiftleft(major.bitwiseAND(F.lit(0xFFF)), 8))
    return low.bitwiseOR(F.shiftleft(F.shiftright(minor, 8), 20)).bitwiseOR(F.shiftleft(F.shiftright(major, 12), 44))


def blocks512(size: Column) -> Column:
    return F.floor((size + 511) / 512).cast("long")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def relative_path(path: Column) -> Column:
    return F.regexp_replace(path, "^/", "")


def text(data: Column) -> Column:
    """Bytes as UTF-8, what is not UTF-8 replaced."""
    return F.decode(data, "UTF-8")


def is_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def parse_size(value: str) -> int:
    """"512M" and the like in bytes."""
    m = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", value.strip().lower())
    if not m:
        raise ValueError(f"not a size: {value}")
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]]


def glob_regex(pattern: str) -> str:
    """A Java regular expression for bytes read as Latin-1.

    ``*`` and ``?`` stop at ``/``; a class has single bytes and ranges, may hold ``/``, and cannot be negated.
    """
    out = []
    chars = pattern.encode("utf-8").decode("latin-1")
    i = 0
    while i < len(chars):
        c = chars[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = chars.find("]", i + 1)
            if end < 0:
                raise ValueError(f"an open class in {pattern!r}")
            body, parts, j = chars[i + 1 : end], [], 0
            while j < len(body):
                if j + 2 < len(body) and body[j + 1] == "-":
                    if body[j] <= body[j + 2]:
                        parts.append(rf"\x{ord(body[j]):02x}-\x{ord(body[j + 2]):02x}")
                    j += 3
                else:
                    parts.append(rf"\x{ord(body[j]):02x}")
                    j += 1
            out.append(f"[{''.join(parts)}]" if parts else "(?!)")
            i = end
        else:
            out.append(rf"\x{ord(c):02x}")
        i += 1
    return rf"\A(?s:{''.join(out)})\z"


def glob_matches(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches ``path`` (bytes), which has no leading ``/``."""
    latin = F.decode(path, "ISO-8859-1")
    return reduce(lambda a, b: a | b, (latin.rlike(glob_regex(p)) for p in patterns), F.lit(False))


def selected(path: Column, kind: Column, patterns: list[str]) -> Column:
    """What an extraction takes: all without patterns; directories always; a path that is not UTF-8 counts as empty."""
    if not patterns:
        return F.lit(True)
    bare = F.when(F.substring(path, 1, 1) == F.lit(b"/"), F.substring(path, 2, 1 << 30)).otherwise(path)
    return (kind == "directory") | glob_matches(F.when(is_utf8(path), bare).otherwise(F.lit(b"")), patterns)

"""Strings compressed with a table of up to 255 symbols of one to eight bytes."""

from __future__ import annotations

import struct

from cairn.errors import DecodeError

# Fixed values.
VERSION = 20190218
ESCAPE = 0xFF


class Symbols:
    """A symbol table as it is stored: version, flag, numbers of symbols by length, symbols."""

    def __init__(self, data: bytes):
        if len(data) < 17:
            raise DecodeError("symbol table: too short")
        (word,) = struct.unpack_from("<Q", data)
        if word >> 32 != VERSION:
            raise DecodeError(f"symbol table: version {word >> 32}")
        self.zero_terminated = bool(data[8] & 1)
        counts = list(data[9:17])
        self.table: list[bytes | None] = [None] * 255
        at, code = 17, 0
        if self.zero_terminated:  # code 0 is the empty string, which no text has
            code = 1
            counts[0] = max(0, counts[0] - 1)
        for length in (2, 3, 4, 5, 6, 7, 8, 1):
            for _ in range(counts[length - 1]):
                if code >= 255 or at + length > len(data):
                    raise DecodeError("symbol table: it ends early")
                self.table[code] = data[at : at + length]
                code, at = code + 1, at + length
        self.header_len = at

    def decode(self, data: bytes) -> bytes:
        out, at = [], 0
        while at < len(data):
            code = data[at]
            if code == ESCAPE:
                if at + 1 >= len(data):
                    raise DecodeError("an escape at the end")
                out.append(data[at + 1 : at + 2])
                at += 2
                continue
            symbol = self.table[code]
            if symbol is None:
                raise DecodeError(f"code {code} is not in use")
            out.append(symbol)
            at += 1
        return b"".join(out)

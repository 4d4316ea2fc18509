"""Values of the compact binary protocol that image schemas and histories are written in."""

from __future__ import annotations

import struct

from cairn.errors import DecodeError

# Type codes.
STOP, TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(13)
_DEPTH = 64


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise DecodeError(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        out = 0
        for shift in range(0, 70, 7):
            b = self.take(1)[0]
            out |= (b & 0x7F) << shift
            if b < 0x80:
                if out >> 64:
                    break
                return out
        raise DecodeError("a varint of over 64 bits")

    def integer(self, bits: int) -> int:
        v = self.varint()
        v = (v >> 1) ^ -(v & 1)
        if not -(1 << (bits - 1)) <= v < 1 << (bits - 1):
            raise DecodeError(f"{v} in {bits} bits")
        return v

    def binary(self) -> bytes:
        return self.take(self.varint())

    def value(self, kind: int, depth: int = 0, inside: bool = False):
        """A value of type ``kind``: bool, int, float, bytes, list, dict, or for a struct a dict by field id."""
        if depth > _DEPTH:
            raise DecodeError("nested too deep")
        if kind in (TRUE, FALSE):
            return self.take(1)[0] == TRUE if inside else kind == TRUE
        if kind == BYTE:
            return struct.unpack("b", self.take(1))[0]
        if kind in (I16, I32, I64):
            return self.integer({I16: 16, I32: 32, I64: 64}[kind])
        if kind == DOUBLE:
            return struct.unpack("<d", self.take(8))[0]
        if kind == BINARY:
            return self.binary()
        if kind in (LIST, SET):
            head = self.take(1)[0]
            n = head >> 4 if head >> 4 < 15 else self.varint()
            self._fits(n)
            return [self.value(head & 15, depth + 1, True) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            self._fits(n)
            kinds = self.take(1)[0] if n else 0
            return {self._key(kinds >> 4, depth): self.value(kinds & 15, depth + 1, True) for _ in range(n)}
        if kind == STRUCT:
            return self.struct(depth)
        raise DecodeError(f"type {kind}")

    def _fits(self, n: int) -> None:
        if n > len(self.data) - self.at:
            raise DecodeError(f"{n} elements in {len(self.data) - self.at} bytes")

    def _key(self, kind: int, depth: int):
        k = self.value(kind, depth + 1, True)
        return k if isinstance(k, int | float | bytes | bool) else repr(k)

    def struct(self, depth: int = 0) -> dict[int, object]:
        out: dict[int, object] = {}
        last = 0
        while head := self.take(1)[0]:
            last = last + (head >> 4) if head >> 4 else self.integer(16)
            out[last] = self.value(head & 15, depth + 1)
        return out


def text(value: object) -> str:
    if not isinstance(value, bytes):
        raise DecodeError("not a string")
    try:
        return value.decode("utf-8")
    except UnicodeDecodeError as e:
        raise DecodeError(str(e)) from e

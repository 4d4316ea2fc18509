"""Bit-packed metadata that carries its own layout.

``Schema`` is the layout, ``Value`` a place in the data with a layout. Lists of integers and of structs are decoded a
column at a time with numpy; nothing walks elements one by one but lists of strings.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from cairn.errors import CapExceeded, DecodeError
from cairn.sources.thrift import Reader, text

#: Most elements a list may have.
LIST_CAP = 64 << 20


@dataclass(frozen=True)
class Field:
    layout: int
    offset: int  # bytes, or bits if negative


@dataclass(frozen=True)
class Layout:
    size: int
    bits: int
    fields: dict[int, Field] = field(default_factory=dict)
    name: str = ""


@dataclass(frozen=True)
class Schema:
    layouts: dict[int, Layout]
    root: int
    version: int = 0
    relaxed: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Schema:
        top = Reader(data).struct()
        layouts = {}
        for k, v in _dict(top.get(2, {})).items():
            v = _dict(v)
            fields = {i: Field(_dict(f).get(1, 0), _dict(f).get(2, 0)) for i, f in _dict(v.get(3, {})).items()}
            layouts[k] = Layout(v.get(1, 0), v.get(2, 0), fields, text(v.get(4, b"")))
        out = cls(layouts, top.get(3, 0), top.get(4, 0), bool(top.get(1, False)))
        if out.root not in layouts:
            raise DecodeError(f"schema: no root layout {out.root}")
        return out

    def of(self, layout: Layout | None, fid: int) -> Layout | None:
        f = layout.fields.get(fid) if layout else None
        if f is None:
            return None
        if f.layout not in self.layouts:
            raise DecodeError(f"schema: no layout {f.layout}")
        return self.layouts[f.layout]

    def kind(self, layout: Layout) -> str:
        """By structure alone: empty, integral, optional, array, string or struct."""
        if not layout.fields:
            return "integral" if layout.bits else "empty"
        one = self.of(layout, 1)
        if one is not None and one.bits == 1:
            return "optional"
        if 3 in layout.fields:
            return "array"
        return "string" if 1 in layout.fields or 2 in layout.fields else "struct"


def _dict(x: object) -> dict:
    if not isinstance(x, dict):
        raise DecodeError("schema: not a struct or map")
    return x


class Value:
    """A place (byte, bit) in the data and the layout of what is there; layout None is an absent field."""

    def __init__(self, schema: Schema, data: np.ndarray, layout: Layout | None, byte: int = 0, bit: int = 0):
        self.schema, self.data, self.layout, self.byte, self.bit = schema, data, layout, byte, bit

    @classmethod
    def root(cls, schema: Schema, data: bytes) -> Value:
        return cls(schema, np.frombuffer(data + b"\0" * 16, np.uint8), schema.layouts[schema.root])

    @property
    def length(self) -> int:
        return len(self.data) - 16

    def __getitem__(self, fid: int) -> Value:
        f = self.layout.fields.get(fid) if self.layout else None
        if f is None:
            return Value(self.schema, self.data, None)
        byte, bit = (self.byte, self.bit - f.offset) if f.offset < 0 else (self.byte + f.offset, self.bit)
        return Value(self.schema, self.data, self.schema.of(self.layout, fid), byte, bit)

    def kind(self) -> str:
        return self.schema.kind(self.layout) if self.layout else "empty"

    def integer(self) -> int:
        """Unsigned; 0 for an absent field or one without bits."""
        bits = self.layout.bits if self.layout else 0
        if not bits:
            return 0
        return int(self._gather(np.array([self.byte * 8 + self.bit], np.int64), bits)[0])

    def _gather(self, at: np.ndarray, bits: int) -> np.ndarray:
        """Unsigned integers of ``bits`` bits, least significant first, from bit positions ``at``."""
        if not 0 < bits <= 64:
            raise DecodeError(f"an integer of {bits} bits")
        if len(at) and (at[0] < 0 or int(at[-1]) + bits > self.length * 8):
            raise DecodeError("metadata: past the end")
        words = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        out = words[byte] >> shift
        if bits > 57:
            high = self.data[byte + 8].astype(np.uint64)
            out |= np.where(shift > 0, high << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return out if bits == 64 else out & np.uint64((1 << bits) - 1)

    def unwrapped(self) -> Value | None:
        """What an optional holds, None if unset; other values as they are."""
        if self.layout is None:
            return None
        if self.kind() != "optional":
            return self
        if not self[1].integer():
            return None
        held = self[2]
        return held if held.layout is not None else Value(self.schema, self.data, Layout(0, 0))

    def range(self) -> tuple[int, int]:
        """(first byte, count) of a list or string."""
        count = self[2].integer() if self.layout else 0
        if count > LIST_CAP:
            raise CapExceeded(f"a list of {count} elements")
        return (self.byte + self[1].integer() if count else 0), count

    def string(self) -> bytes:
        start, count = self.range()
        if start + count > self.length:
            raise DecodeError("metadata: a string past the end")
        return self.data[start : start + count].tobytes()

    def __bool__(self) -> bool:
        return True

    def __len__(self) -> int:
        return self.range()[1] if self.layout else 0

    def element(self, i: int) -> Value:
        start, _ = self.range()
        item = self.schema.of(self.layout, 3)
        if item is None or not item.size:
            return Value(self.schema, self.data, item, start, i * (item.bits if item else 0))
        return Value(self.schema, self.data, item, start + i * item.size, 0)

    def column(self, *path: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Of the elements from ``first`` to ``last``, the integer at ``path`` (none: the element), as uint64."""
        start, count = self.range() if self.layout else (0, 0)
        last = count if last is None else min(last, count)
        n = max(0, last - first)
        item = self.schema.of(self.layout, 3)
        bit, layout = 0, item
        for fid in path:
            f = layout.fields.get(fid) if layout else None
            if f is None:
                return np.zeros(n, np.uint64)
            bit += -f.offset if f.offset < 0 else f.offset * 8
            layout = self.schema.of(layout, fid)
        if not n or layout is None or not layout.bits:
            return np.zeros(n, np.uint64)
        stride = item.size * 8 if item.size else item.bits
        return self._gather(start * 8 + bit + np.arange(first, last, dtype=np.int64) * stride, layout.bits)

    def strings(self) -> list[bytes]:
        return [self.element(i).string() for i in range(len(self))]

"""History sections: what wrote an image."""

from __future__ import annotations

from cairn.errors import DecodeError
from cairn.sources.thrift import Reader, text


def parse(payload: bytes) -> list[dict]:
    """Entries with version, system_id, compiler_id, arguments, timestamp, library_versions; absent ones are None."""
    root = Reader(payload).struct()
    out = []
    for entry in _typed(root.get(1, []), list):
        e = _typed(entry, dict)
        v = _typed(e.get(1, {}), dict)
        version = {n: v.get(i, 0) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))} | {"is_release": bool(v.get(4, False))}
        version |= {n: text(v[i]) if i in v else None for i, n in ((5, "git_rev"), (6, "git_branch"), (7, "git_desc"))}
        when = e.get(5)
        out.append(
            {
                "version": version,
                "system_id": text(e.get(2, b"")),
                "compiler_id": text(e.get(3, b"")),
                "arguments": [text(x) for x in _typed(e[4], list)] if 4 in e else None,
                "timestamp": max(0, _typed(when, int)) if when is not None else None,
                "library_versions": [text(x) for x in _typed(e[6], list)] if 6 in e else None,
            }
        )
    return out


def _typed(value: object, kind: type):
    if not isinstance(value, kind):
        raise DecodeError(f"{type(value).__name__} where {kind.__name__} is due")
    return value

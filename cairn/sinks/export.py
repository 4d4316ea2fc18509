"""Lists, metadata lines and reports of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.errors import ImageError
from cairn.functions import columns as fn
from cairn.plans.image import ImageFrame
from cairn.sources import container, history
from cairn.sources.container import Image
from cairn.sources.metadata import Metadata

_FLAGS = ("mtime_only", "packed_chunk_table", "packed_directories", "packed_shared_files_table", "has_btime", "inodes_have_nlink")
_JSON_FLAGS = ("packed_chunk_table", "packed_directories", "packed_shared_files_table", "inodes_have_nlink", "has_btime", "mtime_only")


def metadata_rows(frame: ImageFrame) -> DataFrame:
    """A row for each path in walk order: inode, path, kind, mode, uid, gid, times, size, nlink, target."""
    joined = frame.tree.select("inode", "path_text", "place", "depth").join(frame.inode_attr, "inode").join(frame.symlinks, "inode", "left")
    path = F.when(F.col("depth") == 0, F.lit("/")).otherwise(F.col("path_text"))
    target = F.when(F.col("kind") == "symlink", fn.text(F.col("target")))
    return joined.orderBy("place").select("inode", path.alias("path"), "kind", "mode", "uid", "gid", "mtime", "atime", "ctime", "size", "nlink", target.alias("target"))


def metadata_lines(frame: ImageFrame) -> DataFrame:
    """``value``: one JSON object a line; no ``target`` but for symbolic links."""
    rows = metadata_rows(frame)
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def export_metadata(frame: ImageFrame, path: str) -> None:
    """The lines as text files in the folder ``path``, in order of their names."""
    metadata_lines(frame).write.mode("overwrite").text(path)


def list_paths(frame: ImageFrame) -> DataFrame:
    """``path`` without its leading slash, in walk order, the root left out."""
    return frame.tree.filter("depth > 0").orderBy("place").select(fn.relative_path(F.col("path_text")).alias("path"))


def section_summary(sections: DataFrame) -> DataFrame:
    """Number and payload bytes of the sections of each type."""
    return sections.groupBy("type").agg(F.count("*").alias("sections"), F.sum("payload_len").alias("payload_bytes"))


def summary(frame: ImageFrame) -> dict:
    """What the JSON report says; optional scalars are left out where the image has none."""
    sb, o = frame.superblock, frame.offsets
    out = {"block_size": sb.block_size, "inode_count": frame.n_inodes, "total_fs_size": sb.total_fs_size}
    if sb.total_allocated_fs_size is not None:
        out["total_allocated_fs_size"] = sb.total_allocated_fs_size
    out |= {"time_resolution_sec": 1 if sb.time_resolution_sec is None else sb.time_resolution_sec, "features": list(sb.features), "categories": frame.category_names()}
    if sb.preferred_path_separator is not None:
        out["preferred_path_separator"] = sb.preferred_path_separator
    out |= {k: o[k] for k in ("dir_offset", "symlink_offset", "file_offset", "shared_file_offset", "device_offset", "special_offset")}
    return out | {"timestamp_base": sb.timestamp_base, "options": [x for x in _JSON_FLAGS if sb[x]]}


def _open(frame: ImageFrame) -> Image:
    size = frame.options.get("imageSize")
    return Image.open(frame.options["path"], frame.options["imageOffset"], int(size) if size else None)


def header(frame: ImageFrame) -> bytes:
    """The bytes before the image in its file."""
    return bytes(frame.table("image").first().header)


def report(frame: ImageFrame, detail: int = 1) -> list[str]:
    """Lines of text: the image and its sections; history and metadata; from 2 on each section, from 3 on each table."""
    image = _open(frame)
    rows = {r.type: r for r in section_summary(frame.sections).collect()}
    size = lambda t: rows[t].payload_bytes if t in rows else 0
    first = image.sections[0].header

    def decoded(kind: int) -> int | None:
        s = image.find(kind)
        try:
            return len(image.decompressed(s, 1 << 30)) if s else None
        except ImageError:
            return None

    out = [f"Format version: {first.major}.{first.minor}", f"Image: {len(image.source)} bytes", f"Sections: {len(image.sections)}"]
    out += [f"Block count: {rows['block'].sections if 'block' in rows else 0}", f"Compressed block size: {size('block')} bytes", f"Compressed metadata size: {size('metadata_v2')} bytes"]
    if (n := decoded(container.METADATA)) is not None:
        out.append(f"Uncompressed metadata size: {n} bytes")
    out.append(f"Compressed schema size: {size('metadata_v2_schema')} bytes")
    if (n := decoded(container.SCHEMA)) is not None:
        out.append(f"Uncompressed schema size: {n} bytes")
    if size("history"):
        out.append(f"Compressed history size: {size('history')} bytes")
    out += [f"Unknown section type {t[8:-1]}: {r.payload_bytes} bytes" for t, r in rows.items() if t.startswith("unknown(")]
    if image.base:
        out.append(f"Header prefix: {image.base} bytes")
    if detail >= 2:
        for s in frame.sections.orderBy("ordinal").collect():
            out.append(f"  [{s.ordinal}] type={s.type} compression={s.compression} number={s.number} offset={s.file_offset} len={64 + s.payload_len} end={s.file_offset + 64 + s.payload_len}")
    if image.index() is not None:
        out.append("Section index: present")
    return out + history_lines(image) + (metadata_lines_of(frame, detail) if image.find(container.METADATA) else [])


def history_lines(image: Image) -> list[str]:
    out = []
    for s in image.sections:
        if s.header.kind != container.HISTORY:
            continue
        try:
            entries = history.parse(image.decompressed(s, 1 << 24))
        except ImageError as e:
            out.append(f"History: unreadable ({e})")
            continue
        for e in entries:
            v = e["version"]
            out.append(f"History: {v['major']}.{v['minor']}.{v['patch']} on {e['system_id']} built with {e['compiler_id']}")
            if e["timestamp"] is not None:
                out.append(f"  created on: {e['timestamp']}")
            if e["arguments"] is not None:
                out.append(f"  args: {' '.join(e['arguments'])}")
    return out


def metadata_lines_of(frame: ImageFrame, detail: int) -> list[str]:
    s = summary(frame)
    out = [f"Block size: {s['block_size']} bytes"]
    if s["categories"]:
        out.append(f"Block categories: {', '.join(s['categories'])}")
    out += [f"Inode count: {s['inode_count']}", f"Original filesystem size: {s['total_fs_size']} bytes"]
    if "total_allocated_fs_size" in s:
        out.append(f"Original allocated size: {s['total_allocated_fs_size']} bytes")
    if s["features"]:
        out.append(f"Features: {', '.join(s['features'])}")
    if flags := [x for x in _FLAGS if frame.superblock[x]]:
        out.append(f"Options: {', '.join(flags)}")
    out.append(f"Time resolution: {s['time_resolution_sec']} seconds")
    if "preferred_path_separator" in s:
        out.append(f"Preferred path separator: {chr(s['preferred_path_separator'])}")
    if detail >= 3:
        out.append("Metadata tables:")
        out += [f"  {r['table']:<20} {r['entries']:>10} entries {r['bytes']:>10} bytes" for r in Metadata(_open(frame)).layouts()]
        out.append("Inode offsets: " + " ".join(f"{k}={s[f'{n}_offset']}" for k, n in (("dir", "dir"), ("symlink", "symlink"), ("file", "file"), ("shared", "shared_file"), ("device", "device"), ("special", "special"))))
    return out


def parse_detail(value: str) -> int:
    """A level of detail; 7 at most, 3 if it is not a number."""
    return min(7, int(value)) if value.isdigit() else 3

"""Command lines: ``python -m cairn.tools check ...`` and ``python -m cairn.tools extract ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from cairn.functions.columns import parse_size
from cairn.plans.image import ImageFrame
from cairn.sinks import export, extract


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairn")
    sub = top.add_subparsers(dest="tool", required=True)
    check = sub.add_parser("check", help="inspect and verify an image")
    check.add_argument("-i", "--input", required=True)
    check.add_argument("-d", "--detail", default="1")
    check.add_argument("-q", "--quiet", action="store_true")
    check.add_argument("-v", "--verbose", action="store_true")
    check.add_argument("-O", "--image-offset", default="auto")
    check.add_argument("--image-size", type=int)
    check.add_argument("-H", "--print-header", action="store_true")
    check.add_argument("-l", "--list", action="store_true")
    check.add_argument("--checksum", choices=("sha256", "sha512", "xxh3-64", "xxh3-128"))
    check.add_argument("-n", "--num-workers", type=int, default=16, help="taken and ignored: the session has its own workers")
    check.add_argument("-s", "--cache-size", default="512m", type=parse_size, help="taken and ignored: blocks are decoded once")
    check.add_argument("--check-integrity", action="store_true")
    check.add_argument("--no-check", action="store_true")
    check.add_argument("-j", "--json", action="store_true")
    check.add_argument("--export-metadata")
    check.add_argument("--log-level", default="info")
    out = sub.add_parser("extract", help="extract an image")
    out.add_argument("-i", "--input", required=True)
    out.add_argument("-o", "--output")
    out.add_argument("--pattern", action="append", default=[])
    out.add_argument("-O", "--image-offset", default="auto")
    out.add_argument("--image-size", type=int)
    out.add_argument("-f", "--format")
    out.add_argument("--format-filters")
    out.add_argument("--format-options")
    out.add_argument("--continue-on-error", action="store_true")
    out.add_argument("--disable-integrity-check", action="store_true")
    out.add_argument("--stdout-progress", action="store_true")
    out.add_argument("-n", "--num-workers", type=int, default=16, help="taken and ignored: the session has its own workers")
    out.add_argument("-s", "--cache-size", default="512m", type=parse_size, help="taken and ignored: blocks are decoded once")
    out.add_argument("--perfmon")
    out.add_argument("--perfmon-trace")
    out.add_argument("--log-level", default="info")
    out.add_argument("--log-with-context", action="store_true")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a, out = _parser().parse_args(args), out or sys.stdout
    frame = ImageFrame(spark or SparkSession.builder.getOrCreate(), a.input, a.image_offset, a.image_size)
    return (_check if a.tool == "check" else _extract)(a, frame, out)


def _check(a: argparse.Namespace, frame: ImageFrame, out) -> int:
    if a.print_header:
        getattr(out, "buffer", out).write(export.header(frame))
        return 0
    if not a.no_check and not frame.verified(deep=a.check_integrity).first().ok:
        print("integrity check failed", file=sys.stderr)
        return 1
    if a.json:
        print(json.dumps(export.summary(frame), separators=(",", ":"), ensure_ascii=False), file=out)
    elif a.export_metadata:
        if a.export_metadata == "-":
            for r in export.metadata_lines(frame).toLocalIterator():
                print(r.value, file=out)
        else:
            export.export_metadata(frame, a.export_metadata)
    elif a.checksum:
        for r in frame.checksum_paths(a.checksum).toLocalIterator():
            print(f"{r.digest}  {r.path}", file=out)
    elif a.list:
        for r in export.list_paths(frame).toLocalIterator():
            print(r.path, file=out)
    elif not a.quiet:
        print("\n".join(export.report(frame, export.parse_detail(a.detail))), file=out)
    return 0


def _extract(a: argparse.Namespace, frame: ImageFrame, out) -> int:
    if not a.disable_integrity_check and not frame.verified().first().ok:
        print("integrity check failed", file=sys.stderr)
        return 1
    if a.format in ("ustar", "tar", "gnutar", "pax"):
        extract.write_tar(frame, getattr(out, "buffer", out) if a.output in (None, "-") else a.output)
        return 0
    if a.format:
        print(f"unknown format {a.format}; extracting to a folder", file=sys.stderr)
    stats = extract.extract_all(frame, a.output or ".", extract.ExtractOptions(continue_on_error=a.continue_on_error, include_patterns=a.pattern))
    if a.stdout_progress:
        print(stats, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

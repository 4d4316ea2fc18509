"""An image as DataFrames: one tree in many encodings, against what the tree says."""

import hashlib
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from cairn import errors, tools
from cairn.fixtures.builder import Device, Fifo, Holes, Link, Options, Same, build
from cairn.functions import columns as fn
from cairn.plans.image import ImageFrame
from cairn.sinks import export, extract

WIDE = b"".join(bytes([i % 251]) * 512 for i in range(4096))
SPARSE = bytes(524288) + b"middle" + bytes(2097152 - 524294)


def tree():
    return {
        "top.txt": b"top level\n", "hardlink.txt": Same("/top.txt"), "dup-a.txt": b"shared body\n",
        "dir": {"dup-b.txt": b"shared body\n", "nested": {"deep.txt": b"nested\n"}, "link-to-top": Link(b"../top.txt")},
        "empty": {}, "zero": b"", "sparse.bin": Holes((524288, b"middle", 2097152 - 524294)), "wide.bin": WIDE,
        "dev": Device(8 << 32 | 1, True), "tty": Device(4 << 32 | 64), "pipe": Fifo(),
    }


FILES = {"/top.txt": b"top level\n", "/hardlink.txt": b"top level\n", "/dup-a.txt": b"shared body\n", "/dir/dup-b.txt": b"shared body\n", "/dir/nested/deep.txt": b"nested\n", "/zero": b"", "/sparse.bin": SPARSE, "/wide.bin": WIDE}
ORDER = ["", "/dev", "/dir", "/dir/dup-b.txt", "/dir/link-to-top", "/dir/nested", "/dir/nested/deep.txt", "/dup-a.txt", "/empty", "/hardlink.txt", "/pipe", "/sparse.bin", "/top.txt", "/tty", "/wide.bin", "/zero"]
VARIANTS = {
    "fsst": Options(packed=True, fsst=True, codec="lzma", metadata_codec="lzma"),
    "plain": Options(compact=False, aligned=True, codec="lz4", index=False), "brotli": Options(codec="brotli", large_holes=True, prefix=b"#!/bin/sh\n", aligned=True, compact=True, fsst=True),
    "other": Options(codec="zstd", metadata_codec="zstd", minor=6, history=[{"version": {"major": 1, "minor": 2, "patch": 3}, "system_id": "sys", "compiler_id": "cc", "arguments": ["mk", "-l3"], "timestamp": 7}], categories=["text", "audio"]),
}


@pytest.fixture(scope="module", params=list(VARIANTS))
def frame(request, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("img") / f"{request.param}.img"
    path.write_bytes(build(tree(), VARIANTS[request.param]))
    out = ImageFrame(spark, str(path))
    out.variant = request.param
    return out


def test_walk_order_and_kinds(frame):
    rows = frame.walk().collect()
    assert [bytes(r.path).decode() for r in rows] == ORDER
    kinds = {bytes(r.path).decode(): r.kind for r in rows}
    assert kinds["/dev"] == "block-device" and kinds["/tty"] == "char-device" and kinds["/pipe"] == "fifo" and kinds["/dir/link-to-top"] == "symlink" and kinds[""] == "directory"


def test_stat(frame):
    rows = {r.path_text: r for r in frame.tree.join(frame.inode_attr.drop("kind"), "inode").collect()}
    for path, data in FILES.items():
        assert rows[path].size == len(data) and rows[path].mode == 0o100644
    assert rows["/top.txt"].nlink == 2 and rows["/top.txt"].inode == rows["/hardlink.txt"].inode
    assert rows["/dev"].rdev == 8 << 32 | 1 and rows["/dir"].size == 0 and rows["/dir"].uid == 1000 and rows["/dir"].gid == 100
    assert rows["/top.txt"].mtime == rows["/top.txt"].atime == 1_700_000_000


@pytest.mark.parametrize("algorithm", ["sha256", "xxh3-64"])
def test_checksums(frame, algorithm):
    import xxhash

    made = (lambda b: hashlib.sha256(b).hexdigest()) if algorithm == "sha256" else (lambda b: f"{xxhash.xxh3_64_intdigest(b):016x}")
    got = {"/" + r.path: r.digest for r in frame.checksum_paths(algorithm).collect()}
    assert got == {p: made(b) for p, b in FILES.items()}


def test_reads(frame):
    paths = {r.inode: r.path_text for r in frame.tree.filter("kind = 'regular'").collect()}
    for offset, size in ((0, 5), (3, 4), (65530, 20), (524280, 30), (2097140, 100), (1 << 30, 10)):
        for r in frame.read_ranges(offset, size).collect():
            assert bytes(r.data) == FILES[paths[r.inode]][offset : offset + size], (paths[r.inode], offset)


def test_verbs(frame):
    top = frame.lookup_one("/top.txt")
    assert frame.lookup_one("//dir//nested/deep.txt/") == frame.lookup_child(frame.lookup_child(frame.lookup_one("dir"), b"nested").first().inode, b"deep.txt").first().inode
    assert frame.read_file(top) == b"top level\n"
    assert frame.read_single_chunk(top, 2, 3) == b"p l" and frame.read_single_chunk(frame.lookup_one("/sparse.bin"), 0, 9) is None
    assert frame.read_link(frame.lookup_one("/dir/link-to-top")) == b"../top.txt"
    assert frame.device_rdev(frame.lookup_one("/tty")) == 4 << 32 | 64
    nested = frame.lookup_one("/dir/nested")
    assert frame.parent(nested).first().parent == frame.lookup_one("/dir") and frame.parent(0).first().parent == 0
    assert [bytes(r.name) for r in frame.read_dir(frame.lookup_one("/dir")).collect()] == [b"dup-b.txt", b"link-to-top", b"nested"]
    assert [bytes(r.name) for r in frame.read_dir_page(frame.lookup_one("/dir"), 1, 2).collect()] == [b"..", b"dup-b.txt"]
    with pytest.raises(FileNotFoundError):
        frame.lookup_one("/absent")
    with pytest.raises(errors.DecodeError):
        frame.read_link(top)


def test_lookup_many(frame, spark):
    got = frame.lookup(spark.createDataFrame([("/dir",), ("dir/nested//deep.txt",), ("/no",), ("/",)], "path string"))
    rows = {r.path: r.kind for r in got.collect()}
    assert rows == {"/dir": "directory", "dir/nested//deep.txt": "regular", "/no": None, "/": "directory"}


def test_verify_and_groups(frame):
    assert frame.verified(deep=True).first().ok
    quick = frame.verify("quick").first()
    assert quick.xxh3_ok and quick.sha_ok is None and quick.decodes is None
    assert frame.verify().first().decodes
    shared = frame.content_groups().filter("files > 1").collect()
    assert [(r.files, r.size) for r in shared] == [(2, 12)]


def test_offsets(frame):
    o = frame.offsets
    assert (o["symlink_offset"], o["file_offset"], o["shared_file_offset"], o["device_offset"], o["special_offset"]) == (4, 5, 10, 12, 14)


def test_blocks_option_prunes(frame):
    assert [r.block for r in frame.table("blocks", blocks="0,2").collect()] == [0, 2]


def test_pushed_filter(frame, spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = frame.table("blocks").filter("block = 1")
        assert [r.block for r in some.collect()] == [1]
        assert some.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_report(frame):
    lines = export.report(frame, 3)
    assert "Inode count: 15" in lines
    if frame.variant == "other":
        assert "History: 1.2.3 on sys built with cc" in lines and "Block categories: text, audio" in lines
        assert frame.table("history").first().arguments == ["mk", "-l3"]
    if frame.variant == "brotli":
        assert "Header prefix: 10 bytes" in lines and export.header(frame) == b"#!/bin/sh\n"


def test_tools(frame, spark):
    for args, check in ((["-l"], lambda s: s.split("\n")[:-1] == [p[1:] for p in ORDER[1:]]), (["-j"], lambda s: json.loads(s)["inode_count"] == 15), (["--export-metadata", "-"], lambda s: json.loads(s.split("\n")[0])["path"] == "/"), (["--checksum", "sha512"], lambda s: len(s.split("\n")) == len(FILES) + 1)):
        out = io.StringIO()
        assert tools.main(["check", "-i", frame.options["path"], *args], spark, out) == 0
        assert check(out.getvalue()), args


def test_extract(frame, tmp_path):
    stats = extract.extract_all(frame, str(tmp_path / "x"))
    assert (stats.directories, stats.files, stats.hardlinks, stats.symlinks, stats.skipped) == (4, 6, 2, 1, 3)
    for path, data in FILES.items():
        assert (tmp_path / "x" / path[1:]).read_bytes() == data
    assert os.readlink(tmp_path / "x/dir/link-to-top") == "../top.txt"
    some = extract.extract_all(frame, str(tmp_path / "y"), extract.ExtractOptions(include_patterns=["d*/*/[c-e]*.txt"], hardlink_shared=False))
    assert some.files == 1 and (tmp_path / "y/dir/nested/deep.txt").read_bytes() == b"nested\n" and not (tmp_path / "y/top.txt").exists()


def test_tar(frame):
    out = io.BytesIO()
    extract.write_tar(frame, out)
    out.seek(0)
    with tarfile.open(fileobj=out) as tar:
        got = {m.name: tar.extractfile(m).read() for m in tar.getmembers() if m.isfile()}
        assert got == {p[1:]: b for p, b in FILES.items()}
        assert tar.getmember("dir/link-to-top").linkname == "../top.txt"


def test_corrupt_block_is_found(spark, tmp_path):
    data = bytearray(build(tree(), Options()))
    data[72] ^= 1
    path = tmp_path / "bad.img"
    path.write_bytes(data)
    f = ImageFrame(spark, str(path))
    row = f.verified().first()
    assert not row.ok and row.first_failure == 0
    with pytest.raises(Exception, match="IntegrityMismatch"):
        f.checksums().collect()


def test_window_equals_file(spark, tmp_path):
    image = build(tree(), Options(packed=True))
    path = tmp_path / "w.img"
    path.write_bytes(b"z" * 100_000 + image)
    f = ImageFrame(spark, str(path), 100_000, None)
    assert f.walk().count() == len(ORDER)


def test_times_with_resolution(spark, tmp_path):
    path = tmp_path / "t.img"
    path.write_bytes(build({"a": b"x"}, Options(times=(1, 2, 3), resolution=10)))
    r = ImageFrame(spark, str(path)).stat(1).first()
    assert (r.atime, r.mtime, r.ctime) == (1_700_000_010, 1_700_000_020, 1_700_000_030)


@pytest.mark.parametrize(
    "pattern, text, want",
    [("*.txt", "a.txt", True), ("*.txt", "d/a.txt", False), ("d/*", "d/a.txt", True), ("?", "a", True), ("?", "/", False), ("[a-c]x", "bx", True), ("[a-c]x", "dx", False), ("[^a]", "^", True), ("[^a]", "b", False), ("a.b", "axb", False), ("[]", "]", False), ("*", "", True), ("**", "a/b", False)],
)
def test_glob(spark, pattern, text, want):
    row = spark.range(1).select(fn.glob_matches(F.lit(text.encode()), [pattern]).alias("m")).first()
    assert row.m is want


def test_glob_open_class():
    with pytest.raises(ValueError):
        fn.glob_regex("[a")


def test_sizes():
    assert fn.parse_size("512M") == 512 << 20 and fn.parse_size("1kb") == 1024
    with pytest.raises(ValueError):
        fn.parse_size("x")


def test_stream_of_folder(spark, tmp_path):
    from cairn.streaming.watch import sections

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.img").write_bytes(build({"a": b"x"}))
    (tmp_path / "in/b.img").write_bytes(b"no image")
    q = sections(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    rows = spark.table("seen").collect()
    assert sum(r.error is None for r in rows) == 4 and sum("NotAnImage" in (r.error or "") for r in rows) == 1

"""Sections, hashes, detection, codecs, and the binary protocol."""

import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn import errors
from cairn.fixtures import builder
from cairn.sources import codecs, container, history
from cairn.sources.bytesource import FileSource, MappedSource, MemorySource, WindowedSource
from cairn.sources.container import Image, parse_header
from cairn.sources.frozen import Schema
from cairn.sources.fsst import Symbols
from cairn.sources.metadata import Metadata
from cairn.sources.thrift import Reader

TREE = {"a.txt": b"alpha", "d": {"b.txt": b"beta" * 1000}}
IMAGE = builder.build(TREE)


def test_header_round_trip():
    header = parse_header(IMAGE)
    assert header.write() == IMAGE[:64]
    assert header.section_len == 64 + header.payload_len


def test_hash_cover():
    s = builder.seal(3, 0, 0, b"data")
    assert hashlib.new("sha512_256", s[0x28:]).digest() == s[8:40]
    image = Image.from_bytes(builder.join([(0, 0, b"data")], index=False))
    image.verify(image.sections[0])


@pytest.mark.parametrize("minor, good", [(0, True), (5, True), (6, True), (7, False)])
def test_versions(minor, good):
    data = builder.join([(0, 0, b"x")], index=False, minor=minor)
    if good:
        assert len(Image.from_bytes(data).sections) == 1
    else:
        with pytest.raises(errors.UnsupportedVersion):
            Image.from_bytes(data)


@pytest.mark.parametrize("prefix", [b"#!/bin/sh\n", b"A" * 200 * 1024, container.MAGIC * 9, b"x" * 65533])
def test_detection_behind_prefix(prefix):
    image = Image.from_bytes(prefix + IMAGE)
    assert image.base == len(prefix)
    assert [s.header for s in image.sections] == [s.header for s in Image.from_bytes(IMAGE).sections]
    assert image.index()[-1][0] == container.INDEX


def test_no_image():
    with pytest.raises(errors.NotAnImage):
        Image.from_bytes(b"nothing here" * 100)


def test_window_file_memory_agree(tmp_path):
    path = tmp_path / "x.img"
    path.write_bytes(b"s" * 1000 + IMAGE + b"tail")
    want = Image.from_bytes(IMAGE).sections
    for source in (FileSource(str(path)), MappedSource(str(path)), MemorySource(path.read_bytes())):
        got = Image(WindowedSource(source, 1000, len(IMAGE)), 0).sections
        assert got == want
    with pytest.raises(errors.SourceOutOfBounds):
        WindowedSource(FileSource(str(path)), 10, 1 << 20)


def test_unknown_section_and_codec_are_tolerated():
    data = builder.join([(0, 0, b"x"), (4242, 0, b"y"), (0, 99, b"z")], index=False)
    image = Image.from_bytes(data)
    assert [s.header.kind for s in image.sections] == [0, 4242, 0]
    with pytest.raises(errors.UnknownCompression):
        image.decompressed(image.sections[2], 100)


@pytest.mark.parametrize("n", [1, 32, 63, 64, 65, len(IMAGE) // 2, len(IMAGE) - 1])
def test_truncation_is_an_error(n):
    with pytest.raises(errors.ImageError):
        Metadata(Image.from_bytes(IMAGE[:n]))


def test_bit_flips_are_found():
    size = len(IMAGE)
    for i in range(64):
        data = bytearray(IMAGE)
        data[i * (size - 1) // 63] ^= 1 << (i % 8)
        try:
            image = Image(MemorySource(bytes(data)), 0)
            for s in image.sections:
                image.verify(s)
            pytest.fail(f"flip {i} went unseen")
        except errors.ImageError:
            pass


def test_a_flip_in_any_magic_is_an_error():
    for s in Image.from_bytes(IMAGE).sections:
        data = bytearray(IMAGE)
        data[s.offset] ^= 1
        with pytest.raises(errors.ImageError):
            Image(MemorySource(bytes(data)), 0)


def test_trailing_bytes_need_a_window():
    for tail in (b"x", b"y" * 200):
        with pytest.raises(errors.ImageError):
            Image.from_bytes(IMAGE + tail)
        assert len(Image(WindowedSource(MemorySource(IMAGE + tail), 0, len(IMAGE))).sections) == len(Image.from_bytes(IMAGE).sections)


def test_index_finds_the_first_section_of_a_type():
    image = Image.from_bytes(IMAGE)
    for kind in {s.header.kind for s in image.sections}:
        assert image.indexed(kind) == image.find(kind).offset - image.base
    assert image.indexed(12345) is None


def test_corrupt_index():
    data = builder.join([(0, 0, b"x"), (9, 0, struct.pack("<2Q", 9 << 48 | 5, 9 << 48 | 5))], index=False)
    with pytest.raises(errors.CorruptSectionIndex):
        Image.from_bytes(data).index()


@pytest.mark.parametrize("codec", ["none", "zstd", "lzma", "lz4", "lz4hc", "brotli"])
@pytest.mark.parametrize("data", [b"", b"x", b"abc" * 100_000])
def test_codecs_round_trip_and_cap(codec, data):
    packed, number = builder.pack(codec, data), builder._CODECS[codec]
    assert codecs.decompress(number, packed, len(data)) == data
    if data:
        with pytest.raises(errors.CapExceeded):
            codecs.decompress(number, packed, len(data) - 1)
    head = codecs.decompress_prefix(number, packed, 7)
    assert head is None or head == data[:7]


def test_codecs_not_there():
    for number in (6, 7):
        with pytest.raises(errors.CodecUnimplemented):
            codecs.decompress(number, b"", 1)
    with pytest.raises(errors.UnknownCompression):
        codecs.decompress(77, b"", 1)


@pytest.mark.parametrize("number", [1, 2, 3, 5])
@given(data=st.binary(max_size=200))
@settings(max_examples=40, deadline=None)
def test_garbage_never_crashes_a_codec(number, data):
    try:
        codecs.decompress(number, data, 1 << 16)
    except errors.ImageError:
        pass


def test_fsst_vector():
    symbols = [b"ir", b"abc", b"!", b"n"]
    table = Symbols(struct.pack("<QB8B", 20190218 << 32, 0, 2, 1, 1, 0, 0, 0, 0, 0) + b"".join(symbols))
    assert table.table[:4] == symbols
    assert table.decode(bytes([3, 1, 0, 2])) == b"nabcir!"
    assert table.decode(bytes([255, 65])) == b"A"
    with pytest.raises(errors.DecodeError):
        table.decode(bytes([9]))
    with pytest.raises(errors.DecodeError):
        table.decode(bytes([255]))


@given(st.lists(st.integers(0, 2**40), max_size=50), st.booleans(), st.booleans())
@settings(max_examples=60, deadline=None)
def test_lists_of_integers(values, aligned, _):
    w = builder._Writer(aligned)
    w.list(4, *w.numbers(values), len(values))
    schema, data = w.finish()
    from cairn.sources.frozen import Value

    assert Value.root(Schema.parse(schema), data)[4].column().tolist() == values


@given(st.lists(st.tuples(st.integers(0, 2**33), st.integers(0, 7), st.integers(0, 2**60)), min_size=1, max_size=40), st.booleans())
@settings(max_examples=60, deadline=None)
def test_lists_of_structs(rows, aligned):
    w = builder._Writer(aligned)
    w.list(1, *w.structs([1, 2, 3], rows), len(rows))
    schema, data = w.finish()
    from cairn.sources.frozen import Value

    held = Value.root(Schema.parse(schema), data)[1]
    assert [held.column(i).tolist() for i in (1, 2, 3)] == [list(x) for x in zip(*rows, strict=True)]


@given(st.integers(-(2**63), 2**63 - 1))
def test_zigzag(n):
    assert Reader(builder._zig(n)).integer(64) == n


def test_history_entries_and_garbage():
    entry = {"version": {"major": 1, "minor": 2, "git_rev": "abc", "is_release": True}, "system_id": "s", "compiler_id": "c", "arguments": ["a", "b"], "timestamp": -3, "library_versions": ["l"]}
    (got,) = history.parse(builder.history_payload([entry]))
    assert got["version"]["minor"] == 2 and got["version"]["is_release"] and got["version"]["git_rev"] == "abc"
    assert got["arguments"] == ["a", "b"] and got["timestamp"] == 0 and got["library_versions"] == ["l"]
    assert history.parse(b"\0") == []


@given(st.binary(max_size=60))
def test_history_garbage(data):
    try:
        history.parse(data)
    except errors.ImageError:
        pass


def test_unknown_feature_is_refused():
    with pytest.raises(errors.UnsupportedFeature):
        Metadata(Image.from_bytes(builder.build(TREE, builder.Options(features=("later",)))))

"""Images written by executors, and what their sinks hold in memory."""

import io
import tarfile
import tracemalloc

import pandas as pd
import pytest

from cairn import queries
from cairn.fixtures import builder, spread
from cairn.plans.image import ImageFrame
from cairn.sources import container, datasource

ROWS = [(i, ["", None, "en", "de", "a-longer-name"][i % 5], ["web", "b", None][i % 3], [None, "", "same", "x" * 70_000, f"text {i}", "é" * i][i % 6]) for i in range(90)]
CHATS = [(i % 7, i // 7, "user" if i % 2 else "assistant") for i in range(40)]


def tree(chats):
    out = {}
    for i, lang, source, text in ROWS:
        out.setdefault(lang or "none", {}).setdefault(source or "none", {})[f"{i}.txt"] = (text or "").encode()
    if chats:
        out["chats"] = {f"{c}-{t}": builder.Link(f"../{role}/{c}".encode()) for c, t, role in CHATS}
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS + ROWS[3:5], "doc_id long, lang string, source string, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(CHATS, "conv_id long, turn long, role string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("variant", [v for v in queries.VARIANTS if v not in ("special", "large_holes")])
def test_same_bytes_as_the_builder(spark, folder, tmp_path, monkeypatch, variant):
    options = builder.Options(**{"block_size": 1 << 20, **queries.VARIANTS[variant]})
    monkeypatch.setattr(spread, "PART", 1 << 15)  # several files
    links = queries._chats_links(spark, folder) if variant == "links" else None
    spread.write(queries._documents_files(spark, folder), links, str(tmp_path / "img"), str(tmp_path), options)
    assert (tmp_path / "img").read_bytes() == builder.build(tree(links is not None), options)
    assert [p.name for p in tmp_path.iterdir()] == ["img"]


def test_no_rows(spark, tmp_path):
    files = spark.createDataFrame([], "folder string, name string, content binary")
    spread.write(files, None, str(tmp_path / "img"), str(tmp_path))
    assert (tmp_path / "img").read_bytes() == builder.build({})


def test_texts_stay_on_executors(spark, tmp_path):
    """32 MB of texts; the driver's Python may hold a quarter of them."""
    texts = spark.range(64).selectExpr("id AS doc_id", "'en' AS lang", "'web' AS source", "repeat(sha2(cast(id AS string), 256), 8192) AS text")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    tracemalloc.start()
    try:
        queries._image("", str(tmp_path), "plain")
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()


def test_members_come_in_batches(tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for i in range(300):
            info = tarfile.TarInfo(f"{i}.txt")
            info.size = 2
            tar.addfile(info, io.BytesIO(b"ab"))
    frames = list(queries._members(iter([pd.DataFrame({"path": [str(tmp_path / "a.tar")]})])))
    assert len(frames) == 1 and list(frames[0]["place"]) == list(range(300)) and frames[0]["digest"].nunique() == 1


def test_extracted_files_are_listed_by_executors(spark):
    plan = queries.extracted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "binaryFile" not in plan and "MapInPandas" in plan


def test_names_stay_on_executors(spark, tmp_path):
    """60,000 files; the driver's Python may hold 50 bytes for each, buffers to copy files included."""
    files = spark.range(60_000).selectExpr("'en' AS folder", "concat('a-name-of-some-length-', id) AS name", "encode(cast(id AS string), 'utf-8') AS content")
    tracemalloc.start()
    try:
        spread.write(files, None, str(tmp_path / "img"), str(tmp_path))
        assert tracemalloc.get_traced_memory()[1] < 3_000_000
    finally:
        tracemalloc.stop()


def test_plans_decode_nothing(spark, tmp_path, monkeypatch):
    """The driver plans reads of tables and of sections without the metadata or the headers."""
    path = tmp_path / "img"
    path.write_bytes(builder.build({f"{i}": f"text {i}".encode() for i in range(40)}, builder.Options(block_size=64)))
    counts = ImageFrame(spark, str(path)).counts
    monkeypatch.setattr(datasource, "TOGETHER", 512)
    readers = [datasource.ImageReader({"path": str(path), "rows": str(counts.get(t, 0))}, t) for t in ("inodes", "names", "blocks", "verify")]
    with monkeypatch.context() as m:
        m.setattr(container.Image, "open", None)
        plans = [r.partitions() for r in readers]
    rows = [[x for p in ps for x in r.read(p)] for r, ps in zip(readers, plans, strict=True)]
    assert [sum(b.num_rows for b in rows[i]) for i in (0, 1)] == [41, 40]
    assert [r[0] for r in rows[2]] == list(range(len(rows[2]))) and b"".join(r[2] for r in rows[2]).startswith(b"text 0text 1")
    assert len(plans[3]) > 2 and [r[0] for r in rows[3]] == list(range(len(rows[2]) + 3)) and all(r[2] and r[3] for r in rows[3])


def test_no_python_plans_beside_the_driver(spark, tmp_path):
    """A table is read by tasks alone, and is not taken for a small one."""
    path = tmp_path / "img"
    path.write_bytes(builder.build({"a": b"x"}))
    frame = ImageFrame(spark, str(path))
    for table in ("inodes", "names", "blocks", "sections"):
        df = frame.table(table)
        assert "BatchScan" not in df._jdf.queryExecution().toString()
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 1 << 40
        assert df.count() == spark.read.format("fsimage").options(path=str(path), table=table).load().count()

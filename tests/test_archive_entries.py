"""Entries of archives: damaged at any byte, too large, unwanted; and the data source over a folder."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from stratograph.sources import archives, zipfolder


def zipped(files, compression=zipfile.ZIP_DEFLATED):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", compression) as archive:
        for name, content in files:
            archive.writestr(name, content)
    return buffer.getvalue()


SMALL = zipped([("p/pom.xml", "<project/>"), ("p/src/main/java/A.java", "class A { B b; }"), ("p/readme.txt", "x" * 50)])


def test_every_flipped_byte_gives_rows(spark):
    """No flip may raise; in Spark, all damaged archives go through one job."""
    damaged = [SMALL[:i] + bytes([SMALL[i] ^ flip]) + SMALL[i + 1 :] for i in range(len(SMALL)) for flip in (0x01, 0xFF)]
    damaged += [SMALL[:i] for i in range(len(SMALL))]
    for content in damaged:
        assert all(e.content is not None or e.error or not re.search(archives.WANTED, e.path) for e in archives.read_entries(io.BytesIO(content)))
    rows = [(f"/in/{i}.zip", len(c), bytearray(c)) for i, c in enumerate(damaged)]
    found = archives.explode_entries(archives.admitted(spark.createDataFrame(rows, "path string, length long, content binary")))
    by = {r["project_id"]: r["n"] for r in found.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(by) == len([r for r in rows if r[1]])
    assert found.filter("error IS NOT NULL").count() > 100


def test_one_bad_entry_hides_no_other():
    files = [(f"src/main/java/A{i}.java", f"class A{i} {{ B{i} b; }}" * 20) for i in range(3)]
    content = zipped(files)
    at = zipfile.ZipFile(io.BytesIO(content)).infolist()[1].header_offset + 60
    found = list(archives.read_entries(io.BytesIO(content[:at] + b"\xff\xff\xff\xff" + content[at + 4 :])))
    assert [e.error is None for e in found] == [True, False, True]
    assert found[1].error.startswith("Entry cannot be read") and found[2].content.decode() == files[2][1]


def test_bounds_and_unwanted_entries():
    bomb = zipped([("src/main/java/Big.java", b"\0" * (80 << 20)), ("src/main/java/A.java", "class A { }"), ("big.bin", b"\0" * (80 << 20))])
    big, small, other = archives.read_entries(io.BytesIO(bomb))
    assert big.content is None and "larger than" in big.error and small.content == b"class A { }" and other == (2, "big.bin", None, None)
    many = zipped([(f"src/main/java/A{i}.java", b" " * 1000) for i in range(10)])
    found = list(archives.read_entries(io.BytesIO(many), archive_limit=3500))
    assert [e.content is not None for e in found] == [True] * 3 + [False] * 7


def test_the_last_of_one_path_holds(recwarn):
    content = zipped([("pom.xml", "first"), ("a/../pom.xml", "second"), ("dir/", "")])
    assert [(e.seq, e.path, e.content) for e in archives.read_entries(io.BytesIO(content))] == [(1, "pom.xml", b"second")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("zips")
    (top / "sub").mkdir()
    (top / "a.zip").write_bytes(zipped([(f"src/main/java/A{i}.java", f"class A{i} {{ }}") for i in range(25)] + [("pom.xml", "<p/>"), ("../evil.java", "x")]))
    (top / "sub" / "b.ZIP").write_bytes(SMALL)
    (top / "bad.zip").write_bytes(b"no archive")
    (top / "empty.zip").write_bytes(zipped([]))
    (top / "other.txt").write_bytes(b"x")
    return str(top)


def test_data_source(spark, folder):
    zipfolder.register(spark)
    rows = spark.read.format("zip_entries").option("entries", 10).load(folder)
    assert rows.rdd.getNumPartitions() == 3 + 1 + 2
    got = {(r["archive"].rpartition("/")[2], r["entry"]): r for r in rows.collect()}
    assert len(got) == 27 + 3 + 2
    assert bytes(got["a.zip", "src/main/java/A7.java"]["content"]) == b"class A7 { }" and got["a.zip", "../evil.java"]["error"] == "Entry leaves the archive"
    assert got["bad.zip", ""]["error"].startswith("Invalid or corrupted") and got["empty.zip", ""]["error"] == "ZIP file is empty"


def test_filters_are_pushed_down(spark, folder):
    zipfolder.register(spark)
    rows = spark.read.format("zip_entries").option("entries", 10).load(folder)
    poms = rows.filter(F.col("entry").endswith("pom.xml"))
    assert poms.rdd.getNumPartitions() == 1 + 1 + 2  # entries that don't fit are not planned
    assert sorted(r["entry"] for r in poms.collect()) == ["p/pom.xml", "pom.xml"]
    assert rows.filter("entry = 'p/readme.txt' AND entry_seq = 2").count() == 1
    assert rows.filter("entry LIKE 'src/main/%' AND content IS NOT NULL").count() == 25
    assert rows.filter("error IS NOT NULL").count() == 3

import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewipe.sources import archives, published


def visible(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if "_jobs" not in d)


def rows(spark, n, start=0):
    return spark.range(start, start + n, 1, 4).select(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"), F.lit("/f"), F.col("id").cast("string")).alias("path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("data"), F.lit(1).alias("more"))


def test_files_appear_and_names_are_kept(spark, tmp_path):
    target = str(tmp_path / "out")
    published.publish(rows(spark, 40), target)
    assert len(visible(target)) == 40 and (tmp_path / "out/d1/f7").read_bytes() == b"7"
    before = {n: (tmp_path / "out" / n).read_bytes() for n in visible(target)}
    with pytest.raises(Exception, match="taken"):
        published.publish(rows(spark, 10, 35), target)  # five names are there: nothing of the job shows
    assert {n: (tmp_path / "out" / n).read_bytes() for n in visible(target)} == before
    published.publish(rows(spark, 10, 35).withColumn("data", F.lit(b"new")), target, overwrite=True)
    assert len(visible(target)) == 45 and (tmp_path / "out/d2/f44").read_bytes() == b"new" and published.recover(target) == []


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    target = str(tmp_path / "out")

    def dies(batches):
        for b in batches:
            yield b
            if 33 in b.column("id").to_pylist():
                os._exit(9)

    some = spark.range(0, 40, 1, 4).select("id").mapInArrow(dies, "id long").select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(b"x").alias("data"))
    published.prepare(spark).dataSource.register(published.PublishedFiles)
    with pytest.raises(Exception):  # noqa: B017
        some.write.format("tracewipe_files").mode("append").save(target)
    assert visible(target) == [] and published.recover(target) == []


def test_bad_names_and_repeats_fail_the_job(spark, tmp_path):
    for name in ("../x", "/x", "a//b", "", "_jobs/x", None):
        with pytest.raises(Exception):  # noqa: B017
            published.publish(spark.createDataFrame([("good", b"1"), (name, b"2")], "path string, data binary"), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="two files"):
        published.publish(spark.createDataFrame([("a", b"1"), ("a", b"2")], "path string, data binary"), str(tmp_path / "out"))
    assert visible(str(tmp_path / "out")) == []
    published.publish(spark.createDataFrame([("a", None), ("b", b"")], "path string, data binary"), str(tmp_path / "out"))
    assert visible(str(tmp_path / "out")) == ["b"]


@pytest.mark.parametrize("stop", range(1, 12))
def test_a_driver_that_dies_in_commit(tmp_path, monkeypatch, stop):
    """The commit stops before each of its file operations: nothing is visible before the marker, all after recovery."""
    target = str(tmp_path)
    w = published._Writer(target, False)
    made = []
    for k in range(2):
        folder = f"{target}/_jobs/{w.job}/t{k}"
        os.makedirs(folder)
        for i in range(2):
            (tmp_path / "_jobs" / w.job / f"t{k}" / str(i)).write_bytes(b"%d%d" % (k, i))
        (tmp_path / "_jobs" / w.job / f"t{k}" / "names.json").write_text(f'["a{k}0", "b/a{k}1"]')
        made.append(published.Staged(folder, 2))
    monkeypatch.setattr(published, "THREADS", 1)
    at = 0
    for n in ("_moved", "_write", "_read", "_exists"):

        def stopping(*args, f=getattr(published, n)):
            nonlocal at
            at += 1
            if at == stop * 3:
                raise KeyboardInterrupt
            return f(*args)

        monkeypatch.setattr(published, n, stopping)
    try:
        w.commit([*made, None])
    except KeyboardInterrupt:
        pass
    monkeypatch.undo()
    marked = os.path.exists(f"{target}/_jobs/{w.job}.json")
    assert marked or visible(target) == []
    published.recover(target)
    assert visible(target) == (["a00", "a10", "b/a01", "b/a11"] if marked else [])
    if marked:
        assert (tmp_path / "b/a11").read_bytes() == b"11"


def test_members_by_range(spark, tmp_path):
    big = tmp_path / "in" / "big.zip"
    big.parent.mkdir()
    with zipfile.ZipFile(big, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(50):
            with z.open(zipfile.ZipInfo(f"m{i:02d}", (2020, 1, 1, 0, 0, 0)), "w", force_zip64=i % 2 == 0) as f:
                f.write(os.urandom(1000) * (i + 1))
        z.writestr("stored", b"plain", zipfile.ZIP_STORED)
        z.writestr("folder/", b"")
        z.writestr("huge", bytes(200_000))
        z.comment = b"comment " * 50
    (tmp_path / "in" / "none.zip").write_bytes(b"no archive")
    (tmp_path / "in" / "empty.zip").write_bytes(b"PK\5\6" + bytes(18))
    raw = bytearray(big.read_bytes())
    raw[60] ^= 0xFF  # in the first member's data
    (tmp_path / "in" / "hurt.zip").write_bytes(raw)
    df = archives.read_archives(spark, str(tmp_path / "in"), partition_bytes=5000, most=100_000)
    assert df.rdd.getNumPartitions() > 10
    got = df.collect()
    of = {n: {r.member: r for r in got if r.archive.endswith(n)} for n in ("big.zip", "hurt.zip", "none.zip", "empty.zip")}
    with zipfile.ZipFile(big) as z:
        want = {n: z.read(n) for n in z.namelist()}
    assert {n: bytes(r.data) for n, r in of["big.zip"].items() if r.data is not None} == {n: d for n, d in want.items() if n != "huge"}
    assert of["big.zip"]["huge"].error == "too_large" and sorted(r.ord for r in of["big.zip"].values()) == list(range(53))
    assert of["hurt.zip"]["m00"].error == "malformed" and of["hurt.zip"]["m01"].data == want["m01"]
    assert [r.error for r in of["none.zip"].values()] == ["malformed"] and of["empty.zip"] == {}


def test_an_archive_beyond_the_limit_of_rows(tmp_path):
    """Places beyond 4 GB, from a directory written by hand: a sparse file of 5 GB with one member at its end."""
    path = tmp_path / "wide.zip"
    body, at = b"found", 5 << 30
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0x21, archives.zlib.crc32(body), 5, 5, 1, 0) + b"m" + body
    extra = struct.pack("<HHQ", 1, 8, at)
    central = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0x21, archives.zlib.crc32(body), 5, 5, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"m" + extra
    start = at + len(local)
    wide = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    end = b"PK\6\7" + struct.pack("<IQI", 0, start + len(central), 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    with open(path, "wb") as f:
        f.seek(at)
        f.write(local + central + wide + end)
    reader = archives._Reader(str(path), 1 << 20, 1 << 20)
    (part,) = reader.partitions()
    assert [(r[2], r[5], r[6]) for r in reader.read(part)] == [("m", b"found", None)]



def test_commits_and_plans_are_made_in_tasks(spark, tmp_path, monkeypatch):
    """The driver neither moves a file nor opens a small archive."""

    driver = os.getpid()

    def away(f):
        def run(*args):
            assert os.getpid() != driver
            return f(*args)

        return run

    monkeypatch.setattr(published, "_moved", away(published._moved))
    monkeypatch.setattr(archives, "listed", away(archives.listed))
    published.publish(rows(spark, 40), str(tmp_path / "out"))
    assert len(visible(str(tmp_path / "out"))) == 40 and published.recover(str(tmp_path / "out")) == []
    assert sorted(n.rpartition(".")[2] for n in os.listdir(tmp_path / "out/_jobs")) == ["done", "json"]
    assert [len(p.parts) for p in archives._Reader(str(tmp_path / "out"), 1 << 20, 1 << 20).partitions()] == [16, 16, 8]
    monkeypatch.undo()
    got = archives.read_archives(spark, str(tmp_path / "out")).collect()
    assert len(got) == 40 and {(r.member, r.error) for r in got} == {(None, "malformed")}


def test_rows_are_computed_once(spark, tmp_path):
    """Names are compared after the files are staged, not by a run of their own over the rows."""
    log = str(tmp_path / "log")
    os.mkdir(log)

    def noted(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                fd = os.open(f"{log}/{i}", os.O_WRONLY | os.O_CREAT | os.O_APPEND)
                os.write(fd, b"x")
                os.close(fd)
            yield b

    some = spark.range(0, 40, 1, 4).mapInArrow(noted, "id long")
    named = some.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("data"))
    published.publish(named, str(tmp_path / "out"))
    assert len(visible(str(tmp_path / "out"))) == 40 and {os.path.getsize(f"{log}/{i}") for i in range(40)} == {1}
    with pytest.raises(ValueError, match="two files"):  # in tasks apart
        published.publish(named.unionByName(named.limit(1)).withColumn("path", F.concat(F.lit("again/"), "path")), str(tmp_path / "out"))
    assert len(visible(str(tmp_path / "out"))) == 40 and sorted(n.rpartition(".")[2] for n in os.listdir(tmp_path / "out/_jobs")) == ["done", "json"]

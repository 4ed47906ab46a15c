import json
import os
import sys
from pathlib import Path

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import samples as s  # noqa: E402

from tracewipe import __main__ as cli  # noqa: E402
from tracewipe.functions import sql  # noqa: E402
from tracewipe.operators import handbook, pixels  # noqa: E402
from tracewipe.sources import export  # noqa: E402


def test_sql_functions(spark):
    sql.register(spark)
    spark.createDataFrame([(n, bytearray(b)) for n, b in s.ALL.items()] + [("none", None), ("cut", bytearray(s.png_full()[:50]))], "file string, content binary").createOrReplaceTempView("files")
    rows = {r.file: r for r in spark.sql("select file, tw_detect_format(content) as f, tw_inspect(content) as i, tw_scrub(content) as s from files").collect()}
    assert all(rows[n].f == n and rows[n].i.format == n and rows[n].s.data is not None for n in s.ALL)
    assert rows["none"].f is None and rows["none"].i is None and rows["cut"].i.error["class"] == "malformed"
    n = spark.sql("select file, f.kind from files, lateral tw_findings(content) f where file = 'PNG' order by f.ord").collect()
    assert [r.kind for r in n][:2] == ["comment", "XMP"]
    r = spark.sql("""select tw_scrub_markup('<a onclick="x">t</a>') as m, tw_scrub_xml('<a w:author="B"/>') as x, tw_scrub_xml(null) as n""").first()
    assert (r.m, r.x, r.n) == ("<a>t</a>", '<a w:author="author"/>', None)


def test_handbook(spark):
    h = handbook.handbook(spark)
    assert h.count() == sum(len(rows) for _, rows in handbook.SECTIONS.values()) and len(handbook.SECTIONS) == 8
    assert {r.title for r in handbook.search(h, "SERIAL").collect()} == {"maker note"}
    assert handbook.search(h, "", "myths").count() == 2 and handbook.search(h, "serial", "myths").count() == 0
    assert handbook.nothing_found(h, "no such thing").first()[0] and not handbook.nothing_found(h, "serial").first()[0]


def test_pictures_in_sql(spark):
    sql.register(spark)
    spark.createDataFrame([(1, s.png_file()), (2, b"text"), (3, None)], "i int, content binary").createOrReplaceTempView("pictures")
    rows = spark.sql("select i, tw_wash(content, 'light') w, tw_to_png(content, 1, null) p from pictures order by i").collect()
    assert pixels.decode(bytes(rows[0].w)).shape[2] == 3 and pixels.decode(bytes(rows[0].p)).shape == (1, 1, 3)
    assert [(r.w, r.p) for r in rows[1:]] == [(None, None)] * 2


class _Remote:
    """A file system without exclusive moves; ``write`` and ``move`` may be replaced."""

    def __init__(self, root):
        self._own = pafs.SubTreeFileSystem(str(root), pafs.LocalFileSystem())

    def __getattr__(self, name):
        return getattr(self._own, name)


def test_remote_exports_leave_no_parts(tmp_path):
    files = _Remote(tmp_path)
    export._put_remote(files, "a.bin", b"one", True)
    export._put_remote(files, "a.bin", b"one", True)  # a retry of the same bytes
    with pytest.raises(export.Taken):
        export._put_remote(files, "a.bin", b"two", True)
    export._put_remote(files, "a.bin", b"two", False)
    assert (tmp_path / "a.bin").read_bytes() == b"two"

    def broken(source, target):
        raise OSError("lost")

    files.move = broken
    with pytest.raises(OSError, match="lost"):
        export._put_remote(files, "b.bin", b"one", True)
    del files.move
    real = files.open_output_stream

    def late(path):  # another writer takes the name while the part is written
        (tmp_path / "c.bin").write_bytes(b"theirs")
        return real(path)

    files.open_output_stream = late
    with pytest.raises(export.Taken):
        export._put_remote(files, "c.bin", b"one", True)
    assert sorted(f.name for f in tmp_path.iterdir()) == ["a.bin", "c.bin"] and (tmp_path / "c.bin").read_bytes() == b"theirs"


def test_exports_are_exclusive_and_private(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, b"abc")], "i int, assurance int, data binary")
    target, names = F.lit(f"{tmp_path}/x.bin"), F.array(F.lit(f"{tmp_path}/x.bin"), F.lit(f"{tmp_path}/y.bin"))
    assert [tuple(r) for r in export.export(rows, target).collect()] == [(f"{tmp_path}/x.bin", 3, None)]
    assert os.stat(f"{tmp_path}/x.bin").st_mode & 0o777 == 0o600
    assert export.export(rows, target).first().error is None  # a retry of the same bytes
    other = rows.withColumn("data", F.lit(b"other"))
    assert tuple(export.export(other, target).first()) == (f"{tmp_path}/x.bin", None, "exists")
    assert tuple(export.export(other, names).first()) == (f"{tmp_path}/y.bin", 5, None)
    assert export.export(other, target, replace=True).first().bytes == 5 and (tmp_path / "x.bin").read_bytes() == b"other"
    assert "Error" in export.export(rows, F.lit(f"{tmp_path}/none/x.bin")).first().error
    with pytest.raises(Exception, match="exists"):
        export.export(rows, target, stop=True).collect()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.bin", "y.bin"]
    r = spark.range(1).select(export.random_names(F.lit("/a/b.PNG"), F.lit("s")).alias("n")).first().n
    assert len(set(r)) == export.ROLLS and all(x.startswith("/a/") and x.endswith(".png") for x in r)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.png").write_bytes(s.png_full())
    (tmp_path / "a.xmp").write_bytes(s.XMP)
    (tmp_path / "b.txt").write_bytes(b"text")
    args = cli.parser().parse_args([str(tmp_path / "a.png"), "--json", "--verify", "--sidecars"])
    assert cli.run(spark, args) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["format"] for x in out] == ["PNG", "XMP sidecar"] and out[0]["verification"]["passed"]
    assert (tmp_path / "a.clean.png").read_bytes() == s.png_file() and (tmp_path / "a.clean.xmp").exists()
    assert cli.run(spark, cli.parser().parse_args([str(tmp_path / "b.txt"), "--dry-run"])) == 2
    assert cli.run(spark, cli.parser().parse_args([str(tmp_path), "--dry-run", "--limit", "10"])) == 2
    assert "left as it was" in capsys.readouterr().out


def test_sql_detection_is_inlined(spark):
    """The SQL function is the native expression; Python sees only the contents that need a probe."""
    from tracewipe.functions.sql import register
    from tracewipe.operators.detect import format_of

    register(spark)
    data = [b"GIF89a", b"II*\0\x08\0\0\0\0\0", b"\0\0\0\x18ftypavif\0\0\0\0mif1avif", b"PK\5\6", b"plain", b""]
    spark.createDataFrame([(i, d) for i, d in enumerate(data)] + [(99, None)], "id int, content binary").createOrReplaceTempView("detected")
    found = spark.sql("select id, tw_detect_format(content) as f from detected")
    assert {r.id: r.f for r in found.collect()} == {**{i: format_of(d) for i, d in enumerate(data)}, 99: None}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "GIF" in plan and "tw_probe_format(CASE WHEN" in plan.replace("\n", " ")

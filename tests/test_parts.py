import datetime
import io
import random
import zipfile

import pytest

from tracewipe.operators import lookup, repack
from tracewipe.streaming.latest import newest_policy
from tracewipe.streaming.scrub_stream import run_available


def archive(members, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, (name, data) in enumerate(members):
            z.writestr(name, data, [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED][i % 2])
        z.comment = comment
    return out.getvalue()


def test_split_edit_and_put_together(spark):
    a = archive([("a/é.txt", b"one" * 100), ("b", b"two" * 500), ("c", b""), ("meta", b"secret")], b"a comment " * 90)
    b = archive([(f"m{i}", bytes([i]) * i * 9) for i in range(130)])
    cut = a[:40] + b"XXXX" + a[44:]
    files = spark.createDataFrame([(1, a), (2, b), (3, b"no archive"), (4, None), (5, cut), (6, b"PK\5\6" + bytes(18)), (7, archive([("x", b"y")]).replace(b"PK\1\2", b"PK\1\3"))], "id int, content binary")
    parts = repack.parts(files, ["id"])
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan
    rows = {(r.id, r.name): r for r in parts.collect()}
    assert len(rows) == 4 + 130 + 4 and (rows[1, "b"].method, rows[1, "b"].size) == (8, 1500)
    assert {(r.id, r.error) for r in repack.unreadable(files, ["id"]).collect()} == {(3, "malformed"), (4, "malformed"), (7, "malformed")}
    edits = spark.createDataFrame([(1, "meta", b"clean"), (1, "c", None), (2, "m7", b"seven")], "id int, name string, data binary")
    whole = {r.id: r.content for r in repack.repacked(repack.edited(parts, edits, ["id", "name"]), ["id"]).collect()}
    with zipfile.ZipFile(io.BytesIO(whole[1])) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == [("a/é.txt", b"one" * 100), ("b", b"two" * 500), ("meta", b"clean")]
        assert z.comment == b"" and {i.date_time for i in z.infolist()} == {(1980, 1, 1, 0, 0, 0)}
    with zipfile.ZipFile(io.BytesIO(whole[2])) as z:
        assert z.read("m7") == b"seven" and z.read("m129") == bytes([129]) * 129 * 9 and len(z.namelist()) == 130
    again = {(r.id, r.name): r for r in repack.parts(spark.createDataFrame(list(whole.items()), "id int, content binary"), ["id"]).collect()}
    same = [k for k in again if k not in ((1, "meta"), (2, "m7"))]
    assert all(again[k].packed == rows[k].packed and again[k].method == rows[k].method for k in same) and len(same) == 2 + 129 + 4


@pytest.mark.parametrize("most", [lookup.BROADCAST, 0])
def test_first_rule_by_prefix(spark, monkeypatch, most):
    monkeypatch.setattr(lookup, "BROADCAST", most)
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abC") for _ in range(n))
    rules = [(r.randrange(50), word(r.choice([1, 2, 3, 5])), f"v{i}") for i in range(40)] + [(3, None, "none"), (49, "", "any")]
    rules = list({(o, None if p is None else p.lower()): (o, p, v) for o, p, v in rules}.values())
    rows = [(i, word(r.choice([0, 1, 2, 4, 8]))) for i in range(200)] + [(900, None)]
    got = {x.id: x.v for x in lookup.first_by_prefix(spark.createDataFrame(rows, "id int, t string"), ["id"], "t", spark.createDataFrame(rules, "ord int, prefix string, v string"), "v").collect()}
    for i, t in rows:
        met = [(o, p, v) for o, p, v in rules if t is not None and p is not None and t.lower().startswith(p.lower())]
        least = min((o for o, _, _ in met), default=None)
        assert got[i] in {v for o, _, v in met if o == least} or (not met and got[i] is None)


def test_newest_policy_across_restarts(spark, tmp_path):
    """Two policies interleaved over three runs of one stream: late results of the old one never pass."""
    schema = "path string, generation long, modificationTime timestamp, note string"
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    runs = [
        [("a", 1, at(1), "a1"), ("b", 1, at(1), "b1"), ("b", 2, at(1), "b2")],
        [("a", 2, at(1), "a2"), ("b", 1, at(5), "late"), ("c", 2, at(3), "c2"), ("c", 2, at(2), "older"), (None, 1, at(1), "no path"), ("d", None, at(1), "no generation")],
        [("a", 1, at(9), "late"), ("a", 2, at(1), "again"), ("a", 2, at(2), "a2 changed"), ("c", 1, at(9), "late"), ("b", 3, at(0), "b3")],
    ]
    seen = []
    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = newest_policy(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        done = run_available(stream, f"file://{tmp_path}/run")
        now = sorted(r.note for r in done.collect())
        seen.append([n for n in now if n not in [x for s in seen for x in s]])
    assert seen == [["a1", "b2"], ["a2", "c2", "no path"], ["a2 changed", "b3"]]


def test_few_rules_keep_rows_in_place(spark):
    """Rules that are broadcast need no shuffle, sort or grouping of the texts, however many there are."""
    rules = spark.createDataFrame([(3, "a", "one"), (1, "ab", "two"), (2, "", "any")], "ord int, prefix string, v string")
    out = lookup.first_by_prefix(spark.range(0, 3000, 1, 4).selectExpr("id", "substr('ABC', 1, cast(id % 4 as int)) as t"), ["id"], "t", rules, "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "SortAggregate" not in plan.split("BroadcastExchange")[0] and "SortMergeJoin" not in plan
    assert {(r.id % 4, r.v) for r in out.collect()} == {(0, "any"), (1, "any"), (2, "two"), (3, "two")}


def test_newest_policy_settles_paths_together(spark, tmp_path):
    """More paths than buckets, each in calls of whole buckets; large numbers beside nulls stay exact."""
    from tracewipe.streaming import latest

    at, big = datetime.datetime(2024, 1, 1), 2**53 + 1
    rows = [(f"p{i}", g, at, big + i if i % 2 else None) for i in range(6000) for g in (1, 2)]
    schema = "path string, generation long, modificationTime timestamp, n long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = newest_policy(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    assert "_bucket" in stream._jdf.queryExecution().analyzed().toString() and latest.BUCKETS < 6000
    got = run_available(stream, f"file://{tmp_path}/run").collect()
    assert sorted((r.path, r.generation, r.n) for r in got if r.n is not None) == sorted((f"p{i}", 2, big + i) for i in range(1, 6000, 2)) and len(got) == 6000

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewipe.operators import elements as el
from tracewipe.operators import intervals as iv
from tracewipe.operators import reachability as rc
from tracewipe.operators.formats import markup

RANGE = "file string, id int, start long, end long"


def ranges(r, n, files, most, widths):
    out = []
    for i in range(n):
        s = r.randrange(most) - most // 4
        out.append((r.choice(files), i, s, s + r.choice(widths)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_as_all_pairs(spark, seed):
    r = random.Random(seed)
    files = ["hot"] * 6 + ["a", "b"]
    left = ranges(r, 300, files, [50, 3000, 10**6, 2**40][seed], [0, 1, 2, 3, 7, 8, 9, 64, 1000, 2**20, 2**33]) + [(None, 900, 1, 5), ("a", 901, None, 5), ("a", 902, 9, 2), ("a", 903, 5, None)]
    right = ranges(r, [3, 40, 60, 30][seed], files, [50, 3000, 10**6, 2**40][seed], [0, 1, 2, 5, 8, 33, 100, 5000, 2**19]) + [(None, 0, 0, 99), ("a", 1, 3, None)]
    want = {i for f, i, s, e in left if any(f is not None and f == g and None not in (s, e, x, y) and s < y and x < e and s < e and x < y for g, _, x, y in right)}
    a, b = spark.createDataFrame(left, RANGE), spark.createDataFrame(right, RANGE)
    assert {x.id for x in iv.overlap_semi_join(a, b, ["file"], ["id"]).collect()} == want
    assert sorted(x.id for x in iv.overlap_anti_join(a, b, ["file"], ["id"]).collect()) == sorted({i for _, i, _, _ in left} - want)


def test_a_skewed_file_makes_one_row_per_bin(spark):
    """20 000 ranges piled up at one place on both sides, and one range over all of them."""
    a = spark.range(20_000).select(F.lit("hot").alias("file"), F.col("id"), (F.col("id") % 7).alias("start"), (F.col("id") % 7 + 1000).alias("end"))
    b = spark.range(20_000).select(F.lit("hot").alias("file"), (F.lit(1003) + F.col("id") % 5).alias("start"), F.lit(2000).alias("end"))
    assert iv.overlap_anti_join(a, b, ["file"], ["id"]).count() == a.filter("id % 7 + 1000 <= 1003").count()
    one = spark.createDataFrame([("hot", 0, -(2**40), 2**40)], "file string, id long, start long, end long")
    assert iv.overlap_semi_join(one, b, ["file"], ["id"]).count() == 1 and iv.overlap_anti_join(a, one, ["file"], ["id"]).count() == 0
    assert iv.overlap_anti_join(a, b.limit(0), ["file"], ["id"]).count() == 20_000 and iv.overlap_semi_join(a.limit(0), b, ["file"], ["id"]).count() == 0


MARKUP = [
    "<a><b>x</b><c/>y</a>", "plain", "", None, "<w:rsids>1<rsids>2</rsids>3</w:rsids>4", "<s><rsids>open ended <b>", "</rsids>stray<rsids/>z<rsids>q</rsids>",
    "<!-- <rsids> --><p t='>' u=\"</rsids>\">é😀</p><![CDATA[<rsids>]]><?pi <rsids?>", "<RSIDS a='1'>gone</RSIDS >kept", "<rsids><b></rsids></b>tail", "a < b <rsids>x</rsids> > c",
]


def test_elements_are_removed_as_by_the_lexer(spark):
    rows = [m for m in MARKUP if m != "a < b <rsids>x</rsids> > c"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, x string").repartition(3)
    got = {r.id: (r.removed, r.cleaned) for r in el.without_elements(df, "x", ["id"], ["rsids"]).collect()}
    for i, m in enumerate(rows):
        if m is None:
            assert got[i] == (0, None)
            continue
        n = 0

        def count(t):
            nonlocal n
            n += 1

        stream = markup.tokens(m.encode())
        want = b"".join(t.raw for t in markup.without_elements(stream, lambda t: t.local == b"rsids", count)).decode()
        assert got[i] == (n, want), m


def test_random_markup(spark):
    r = random.Random(5)
    parts = ["<a>", "</a>", "<b x='1>'>", "</b>", "<c/>", "text ", "<!-- <a> -->", "é", "\n"]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, x string")
    got = {x.id: x.cleaned for x in el.without_elements(df, "x", ["id"], ["a"]).collect()}
    for i, m in enumerate(rows):
        want = b"".join(t.raw for t in markup.without_elements(markup.tokens(m.encode()), lambda t: t.local == b"a", lambda t: None)).decode()
        assert got[i] == want, m


def test_two_names_and_places(spark):
    df = spark.createDataFrame([(1, "0<x><y>1</y></x>2<y><x>3</x></y>4<br>5")], "id int, x string")
    assert [tuple(r) for r in el.without_elements(df, "x", ["id"], ["X", "y"]).collect()] == [(1, 2, "024<br>5")]
    rows = el.elements(el.tokens(df, "x", ["id"], el.VOID), ["id"]).orderBy("ord").collect()
    assert [(r.name, r.level, r.parent, r.start, r.end) for r in rows] == [("x", 1, None, 1, 16), ("y", 2, 0, 4, 12), ("y", 1, None, 17, 32), ("x", 2, 4, 20, 28), ("br", 1, None, 33, 37)]
    open_ = spark.createDataFrame([(1, "</z><a><b></b>")], "id int, x string")
    rows = el.elements(el.tokens(open_, "x", ["id"]), ["id"]).orderBy("ord").collect()
    assert [(r.name, r.level, r.parent, r.end) for r in rows] == [("a", 1, None, None), ("b", 2, 1, 14)]


def closure(roots, links):
    seen, todo = set(roots), list(roots)
    while todo:
        f, n = todo.pop()
        for g, a, b in links:
            if (g, a) == (f, n) and (f, b) not in seen and b is not None:
                seen.add((f, b))
                todo.append((f, b))
    return seen


def test_reached_as_by_hand(spark):
    r = random.Random(6)
    for n, m in ((12, 14), (30, 25), (8, 40)):
        links = [(r.choice("xxy"), r.randrange(n), r.randrange(n)) for _ in range(m)] + [("x", 1, None), ("x", 500, 501)]
        roots = [("x", 0), ("y", 1), ("y", 1), ("x", 77)]
        got = rc.reachable(spark.createDataFrame(roots, "file string, node int"), spark.createDataFrame(links, "file string, node int, to int")).collect()
        assert len(got) == len(set(got)) and {tuple(x) for x in got} == closure(set(roots), links)


def test_long_chain_and_rings(spark):
    chain = [("f", i, i + 1) for i in range(1000)]
    ring = [("f", 2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [("f", 3000, 3000), ("f", 500, 4000), ("f", 4000, 500)]
    objects = spark.createDataFrame([("f", n) for n in {*range(1001), *range(2000, 2050), 3000, 4000}], "file string, node int")
    roots, links = spark.createDataFrame([("f", 0)], "file string, node int"), spark.createDataFrame(chain + ring, "file string, node int, to int")
    assert sorted(x.node for x in rc.orphans(objects, roots, links).collect()) == [*range(2000, 2050), 3000]


def test_pdf_objects(spark):
    pdf = b"%PDF-1.4\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj\n<</Kids[3 0 R 3 0 R]>>\nendobj\n3 0 obj\n<</Parent 2 0 R>>stream\n9 0 R\nendstream\nendobj\n4 0 obj\n<</Author(x)/X 9 0 R>>\nendobj\n3 0 obj\n<</Parent 2 0 R/Contents 5 0 R>>\nendobj\n5 0 obj <<>> endobj trailer\n<</Root 1 0 R/Info 4 0 R>>"
    files = spark.createDataFrame([("p", pdf), ("q", b"no pdf"), ("r", None)], "path string, content binary")
    objects = rc.pdf_objects(files)
    gone = rc.orphans(objects, rc.pdf_roots(files), rc.pdf_references(objects))
    assert [(r.file, r.node) for r in gone.collect()] == [("p", 4)] and objects.count() == 5


def test_left_rows_of_ranges_are_shuffled_once(spark):
    """No aggregate, join by key or second shuffle of the left rows: they are laid out by one sort."""
    a = spark.range(0, 3000, 1, 4).selectExpr("id % 3 as file", "id", "id * 7 as start", "id * 7 + id % 9 as end")
    b = spark.range(0, 300, 1, 2).selectExpr("id % 3 as file", "id * 90 as start", "id * 90 + 40 as end")
    free = iv.overlap_anti_join(a, b, ["file"], ["id"])
    plan = free._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "explode" not in plan and "left_anti" not in plan.lower()
    want = a.alias("a").join(b.alias("b"), F.expr("a.file = b.file and a.start < b.end and b.start < a.end and a.start < a.end"), "left_anti")
    assert sorted(r.id for r in free.collect()) == sorted(r.id for r in want.collect())


def test_a_running_maximum_goes_on_over_partitions_and_batches(spark, monkeypatch):
    """One right range over all, many keys beside it, and piles of one place: batches of 7 rows, 4 partitions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        left = [("k", i, 10 + i // 50, 12 + i // 50) for i in range(400)] + [(f"x{i}", 1000 + i, 0, 9) for i in range(90)]
        right = [("k", 0, 11, 17), ("x5", 1, 8, 20), ("x6", 2, 9, 20)]
        a, b = spark.createDataFrame(left, RANGE), spark.createDataFrame(right, RANGE)
        want = {i for f, i, s, e in left if any(f == g and s < y and x < e for g, _, x, y in right)}
        assert {x.id for x in iv.overlap_semi_join(a, b, ["file"], ["id"]).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("few", [0, 3, rc.FEW])
def test_frontiers_of_all_sizes(spark, monkeypatch, few):
    """Large frontiers are joined by shuffle, small ones by broadcast."""
    monkeypatch.setattr(rc, "FEW", few)
    links = [("f", i, 2 * i) for i in range(1, 20)] + [("f", i, 3 * i) for i in range(1, 14)] + [("f", 38, 1)]
    roots, todo = {1}, [1]
    while todo:
        n = todo.pop()
        for _, a, b in links:
            if a == n and b not in roots:
                roots.add(b)
                todo.append(b)
    got = rc.reachable(spark.createDataFrame([("f", 1)], "file string, node long"), spark.createDataFrame(links, "file string, node long, to long"))
    assert sorted(r.node for r in got.collect()) == sorted(roots)


def by_hand(content):
    """Objects and roots of a file, by the plain patterns."""
    s, text = r"[ \t\n\x0b\f\r]", content.decode("latin-1")
    last = {}
    for m in re.finditer(rf"(?s)(?:\A|[ \t\n\x0b\f\r>])([0-9]{{1,10}}){s}+([0-9]{{1,5}}){s}+obj\b(.*?)\bendobj", text):
        last[int(m[1])] = m[3].split("stream")[0]
    return {n: (b, [int(x) for x in re.findall(rf"([0-9]{{1,10}}){s}+[0-9]{{1,5}}{s}+R\b", b)]) for n, b in last.items()}, [int(x) for x in re.findall(rf"/Root{s}+([0-9]{{1,10}}){s}+[0-9]{{1,5}}{s}+R", text)]


@pytest.mark.parametrize("seed", range(3))
def test_objects_and_references_as_by_plain_patterns(spark, seed):
    r = random.Random(seed)
    parts = ["1 0 obj", "\n2 0 obj<<", ">3\t00001  obj ", " 12345678901 0 obj", "4 123456 obj", "endobj", " endobj", "\nendobj", "xendobj", "\xe9endobj", "-endobj", "eendob", "e", "een", "stream", "endstream\n", " 7 0 R", "/A 12345678901 0 R ",
             "8 0 Rx", "9\n0\rR/", "5 5 5 R", "\n", " ", ">", "0", "obj", "\xe9", "R", "/Root 1 0 R", "/Root  2\n0 R"]
    files = [(f"f{i}", "".join(r.choice(parts) for _ in range(r.randint(0, 60))).encode("latin-1")) for i in range(150)]
    files += [("long", b"1 0 obj " + b"e" * 300_000 + b" 1234567" * 50_000 + b" 0 R endobj\n2 0 obj 3 0 R"), ("none", None), ("roots only", b"trailer<</Root 5 0 R>>")]
    df = spark.createDataFrame(files, "path string, content binary")
    want = {(f, n): v for f, c in files if c for n, v in by_hand(c)[0].items()}
    assert len(want) > 100 and ("long", 1) in want
    assert {(x.file, x.node): (x.body, x.to) for x in rc.pdf_objects(df).collect()} == want
    objects, roots = rc.pdf_graph(df)
    assert {(x.file, x.node): x.to for x in objects.collect()} == {k: v[1] for k, v in want.items()}
    assert sorted(map(tuple, roots.collect())) == sorted(map(tuple, rc.pdf_roots(df).collect())) == sorted((f, n) for f, c in files if c for n in by_hand(c)[1])


def test_pdf_files_are_read_once(spark, monkeypatch, tmp_path):
    """What is shuffled and joined are numbers from a table written in one pass; neither texts nor patterns are in later plans."""
    from tracewipe.plans import structures

    spark.createDataFrame([(i, "x" * 50) for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    given, reachable = [], rc.reachable
    monkeypatch.setattr(rc, "reachable", lambda roots, links: given.extend([roots, links]) or reachable(roots, links))
    out = structures.pdf_orphans(spark, str(tmp_path))
    assert {(x.doc_id, x.orphans, x.objects) for x in out.collect()} == {(i, 1 + (i % 7 if i % 2 else 0), 4 + i % 7) for i in range(20)}
    for df in (*given, out):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "regexp" not in plan and "hex" not in plan and not any("documents.parquet" in f for f in df.inputFiles())

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewipe.llm import additive_ann, collision_dedup
from tracewipe.llm.vectors import units

VECS = "vec_id long, embedding array<float>, label int"


def table(sp, x, ids=None, extra=()):
    rows = [(int(i), [float(v) for v in row], 0) for i, row in zip(range(len(x)) if ids is None else ids, x)]
    return sp.createDataFrame(rows + list(extra), VECS)


ODD = [(9000, None, 1), (9100, [0.0] * 16, 1), (9200, [float("nan")] * 16, 1), (9300, [1.0] * 15 + [float("inf")], None), (9400, [], 1), (None, [1.0] * 16, 1), (9500, [1.0] * 15 + [None], 1), (9600, [1.0] * 3, 1)]


def clusters(seed, n=600, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[100:160] = x[7] + 0.05 * rng.standard_normal((60, dim))
    x[200:205] = x[9]
    x[300:340] = x[11] + 0.12 * rng.standard_normal((40, dim))
    return x.astype(np.float32).astype(float)


def test_books_code_better_with_more_beams():
    x = np.random.default_rng(0).standard_normal((500, 16))
    books = additive_ann.fit(x, books=4, words=32)
    unit, size = additive_ann.directions(x)
    assert np.allclose(unit * size[:, None], x, atol=1e-5)
    cost = []
    for beam in (1, 8):
        codes, norms = additive_ann.encode(unit, books, beam)
        coded = books.mean + books.words[np.arange(4), codes].sum(axis=1)
        assert np.allclose((coded**2).sum(1), norms, rtol=1e-3)
        cost.append(((unit - coded) ** 2).sum())
        got = additive_ann.costs(codes, norms, size, books, unit[:3], size[:3])
        want = ((x[:3][None] - (coded * size[:, None])[:, None]) ** 2).sum(2) - size[:3][None] ** 2
        assert np.allclose(got, want, atol=1e-2)
    assert cost[1] < cost[0]


def stored(sp, tmp_path, x, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(x)), "label": np.zeros(len(x), np.int32)}), f"{tmp_path}/x.parquet")
    return sp.read.parquet(f"{tmp_path}/x.parquet")


def nearest(x, q, k=10):
    with np.errstate(over="ignore"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k], d


def test_recall_where_few_candidates_are_kept(sp, tmp_path):
    """50 000 rows without any structure: the kept candidates are one in 200, and recall is counted against brute force."""
    x = np.random.default_rng(12).standard_normal((50_000, 32)).astype(np.float32)
    got = additive_ann.neighbours(stored(sp, tmp_path, x)).toPandas()
    x = x.astype(float)
    assert len(got) == 5000 and additive_ann.KEEP <= len(x) // 195
    hits = 0
    for q in range(0, 50_000, 500):
        want, d = nearest(x, q)
        mine = got[got.query_id == q].sort_values("rank")
        hits += len(set(mine.vec_id) & set(want))
        assert np.allclose(mine.score, d[mine.vec_id], rtol=1e-12)
    print("recall", hits / 1000)
    assert hits >= 0.95 * 1000


@pytest.mark.parametrize("huge", [1e30, 3e38, 1e-30])
def test_one_row_far_from_all_harms_no_other(sp, tmp_path, huge):
    x = np.random.default_rng(13).standard_normal((3000, 16))
    x[17] = huge
    x[1100:1103] *= huge
    x = x.astype(np.float32)
    got = additive_ann.neighbours(stored(sp, tmp_path, x).withColumn("query_id", F.lit(1)).withColumn("key", F.lit("x")).withColumn("rank", F.lit(2))).toPandas()
    x = x.astype(float)
    assert np.isfinite(got.score).all() and (got.groupby("query_id").size() == 10).all()
    hits = n = 0
    for q in range(0, 3000, 100):
        if q != 1100:
            want, _ = nearest(x, q)
            hits, n = hits + len(set(got[got.query_id == q].vec_id) & set(want)), n + 10
    assert hits >= 0.97 * n


def test_search_against_brute_force(sp):
    x = clusters(1)
    got = additive_ann.neighbours(table(sp, x, extra=ODD)).toPandas()
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11))
        hits += len(set(mine.vec_id) & set(want))
        assert np.allclose(mine.score, d[mine.vec_id], rtol=0, atol=1e-12)
        assert mine.score.is_monotonic_increasing
    assert set(got.query_id) == set(range(0, 600, 100))
    assert hits >= 0.9 * 60


def test_few_candidates_ties_and_none(sp):
    x = np.ones((4, 16))
    got = additive_ann.neighbours(table(sp, x, ids=[0, 7, 3, 5])).toPandas()
    assert list(got.sort_values("rank").vec_id) == [3, 5, 7]
    assert additive_ann.neighbours(table(sp, np.ones((1, 16)), ids=[100])).count() == 0
    assert additive_ann.neighbours(table(sp, x[:0], extra=ODD[:4])).count() == 0
    assert additive_ann.neighbours(table(sp, x[:0])).count() == 0


def test_spans_and_groups_of_queries(sp, monkeypatch):
    monkeypatch.setattr(additive_ann, "SPAN", 100)
    monkeypatch.setattr(additive_ann, "QUERY_BLOCK", (2, 3))
    x = clusters(4)
    points = table(sp, x).selectExpr("vec_id", "cast(embedding as array<double>) embedding")
    got = additive_ann.search(points, points.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), keep=100).toPandas()
    hits = sum(len(set(got[got.query_id == q].vec_id) & set(nearest(x, q)[0])) for q in range(0, 600, 50))
    assert len(got) == 120 and hits >= 114


def brute(x):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = y @ y.T >= 0.9
    np.fill_diagonal(g, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(g, label[None], len(x)).min(axis=1))
        if (new == label).all():
            return g.sum(1), label
        label = new


@pytest.mark.parametrize("block", [16_384, 16])
def test_near_copies_against_brute_force(sp, monkeypatch, block):
    monkeypatch.setattr(collision_dedup, "BLOCK", block)
    monkeypatch.setattr(collision_dedup, "BUNDLE", 1000)
    x = clusters(2)
    n, component = brute(x)
    got = collision_dedup.near_copies(table(sp, x, extra=ODD).withColumn("id", F.lit(1)).withColumn("usable", F.lit("x")).withColumn("weight", F.lit(2))).toPandas()
    assert len(got) == 600 + len(ODD)
    mine = got[got.vec_id < 600].set_index("vec_id").sort_index()
    assert (mine.n_links.to_numpy() <= n).all() and mine.n_links.sum() >= 0.99 * n.sum()
    assert (mine.component_id.to_numpy() == component).mean() > 0.99
    assert (mine.kept == (mine.index == mine.component_id)).all()
    rest = got[~(got.vec_id < 600)]
    assert (rest.n_links == 0).all() and rest.kept.all()


@pytest.mark.parametrize("rows", [5_000, 50_000, 500_000])
def test_plan_reaches_its_recall(rows):
    """Recall on pairs that took no part in the calibration, printed for each size."""
    x = np.random.default_rng(3).standard_normal((4000, 32)) + 0.1
    plan = collision_dedup.calibrated(x, rows)
    assert plan.count >= collision_dedup.COUNT > 1 and plan.recall >= collision_dedup.RECALL
    base, partner = collision_dedup._planted(units(x), 0.9, np.random.default_rng(99))
    sides = []
    for v in (base, partner):
        row, lists, values = plan.tails(v)
        cuts = np.searchsorted(row, np.arange(len(v) + 1))
        sides.append([dict(zip(lists[lo:hi].tolist(), values[lo:hi].tolist())) for lo, hi in zip(cuts[:-1], cuts[1:])])
    found = [min(len(p), len(q)) < plan.least or sum(k in q and abs(p[k] - q[k]) <= plan.width for k in p) >= plan.count for p, q in zip(*sides)]
    print("rows", rows, "projections", plan.projections, "count", plan.count, "recall", np.mean(found))
    assert np.mean(found) >= 0.9985


def member_table(x, plan, dtype=np.float32):
    row, lists, values = plan.tails(units(x))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))]).astype(np.int32))
    columns = {"lists": pa.ListArray.from_arrays(offsets, pa.array(lists)), "at": pa.ListArray.from_arrays(offsets, pa.array(values))}
    return pa.table({"id": np.arange(len(x)), "weight": np.ones(len(x), np.int64), "point": pa.array([v.astype(dtype).tobytes() for v in x], pa.binary()), **columns})


@pytest.mark.parametrize("pairs", [2_000_000, 50])
def test_pairs_are_counted_first_and_few_are_verified(monkeypatch, pairs):
    """Every pair that reaches the count in windows is verified once, no other pair is."""
    monkeypatch.setattr(collision_dedup, "PAIRS", pairs)
    x = clusters(2, n=700)
    plan = collision_dedup.calibrated(x, len(x))
    c = collision_dedup.Counter(member_table(x, plan), plan, 0.9, np.float32)
    seen = []
    monkeypatch.setattr(c, "_verify", lambda a, b: seen.extend(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())))
    for bundle in range(3):
        collision_dedup._bundle(c, bundle, 3, np.array([], np.int32))
    row, lists, values = plan.tails(units(x))
    dense = np.full((len(x), 2 * plan.projections), np.inf)
    dense[row, lists] = values
    with np.errstate(invalid="ignore"):
        hits = np.array([(np.abs(dense[i] - dense) <= plan.width).sum(axis=1) for i in range(len(x))])
    i, j = np.nonzero(np.triu(hits >= plan.count, 1))
    assert sorted(seen) == list(zip(i.tolist(), j.tolist()))
    assert 0 < len(seen) < 0.5 * (np.triu(hits > 0, 1)).sum()


def test_rows_that_share_an_id_all_come_back(sp):
    got = collision_dedup.near_copies(table(sp, np.eye(16)[:2], ids=[4, 9], extra=[(4, None, 1), (4, [1.0] * 16, 1), (9, [float("nan")] * 16, 1)])).collect()
    assert len(got) == 5 and sorted(r.vec_id for r in got) == [4, 4, 4, 9, 9] and all(r.n_links == 0 for r in got)


def test_links_between_rows_that_share_ids(sp):
    """Different vectors under one id are vectors of their own, each with its links."""
    rng = np.random.default_rng(8)
    a, b, c = (rng.normal(size=16) for _ in range(3))
    rows = [(7, a), (7, b), (1, a * 1.01 + 1e-3), (2, b + 1e-3), (9, c), (9, c), (3, c * 2), (7, c + 1e-3), *((100 + i, rng.normal(size=16)) for i in range(40))]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in collision_dedup.near_copies(sp.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")).collect())
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    near = (x @ x.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    low = [i for i, _ in rows]
    for _ in rows:
        low = [min([low[i], *(low[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
    assert got == sorted((i, int(near[k].sum()), low[k]) for k, (i, _) in enumerate(rows)) and (7, 1, 1) in got and (7, 1, 2) in got


@pytest.mark.parametrize(("dim", "n"), [(128, 20_000), (768, 4_000)])
def test_recall_is_calibrated_in_many_dimensions(dim, n):
    """Vectors without structure: as many candidates are kept as their nearest need."""
    x = np.random.default_rng(dim).normal(size=(n, dim))
    books = additive_ann.fit(x[:4096], books=8, words=64)
    keep = additive_ann.candidates(x[4096:8192] if n > 8192 else x, books, n, 10)
    unit, size = additive_ann.directions(x)
    codes, norms = additive_ann.encode(unit, books, 2)
    asked = np.arange(n - 60, n)
    cost = additive_ann.costs(codes, norms, size, books, unit[asked], size[asked])
    true = (x**2).sum(1)[:, None] - 2 * x @ x[asked].T
    cost[asked, np.arange(60)] = true[asked, np.arange(60)] = np.inf
    found = [len(set(np.argpartition(true[:, j], 9)[:10]) & set(np.argpartition(cost[:, j], min(keep, n - 1) - 1)[:keep])) for j in range(60)]
    assert sum(found) >= 0.93 * 600 and keep > additive_ann.KEEP


def test_huge_values_count_like_others(sp):
    x = np.random.default_rng(4).standard_normal((60, 16))
    x[50:] = x[5] * np.array([1e30, 1e-30, 3e37, 1, 2, 5e-38, 1e20, 1e-20, 7, 9])[:, None]
    got = collision_dedup.near_copies(table(sp, x)).toPandas().set_index("vec_id")
    assert (got.component_id[50:] == 5).all() and (got.n_links[50:] == 10).all()


def test_repeated_rows_link(sp):
    got = collision_dedup.near_copies(table(sp, np.ones((3, 16)), ids=[4, 4, 9])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(4, 2, 4), (4, 2, 4), (9, 2, 4)]
    assert collision_dedup.near_copies(table(sp, np.ones((0, 16)))).count() == 0


@pytest.mark.parametrize("block", [16_384, 200])
def test_a_group_of_a_third_keeps_its_links(sp, monkeypatch, block):
    monkeypatch.setattr(collision_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 64))
    x[1000:] = x[3] + 0.16 * rng.standard_normal((500, 64))
    x[40] = x[1200]
    x = x.astype(np.float32).astype(float)
    n, component = brute(x)
    assert n[1000:].min() > 400
    mine = collision_dedup.near_copies(table(sp, x)).toPandas().set_index("vec_id").sort_index()
    assert (mine.n_links.to_numpy() <= n).all() and mine.n_links.sum() >= 0.999 * n.sum()
    assert (mine.component_id.to_numpy() == component).all()


@pytest.mark.parametrize("share", [0.25, 0.33, 0.6])
def test_plan_reaches_its_recall_beside_a_large_group(share):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 64))
    x[: int(2000 * share)] = x[0] + 0.16 * rng.standard_normal((int(2000 * share), 64))
    plan = collision_dedup.calibrated(x, 10_000)
    assert plan.recall >= collision_dedup.RECALL
    assert plan.projections < 2000 and plan.alone < share + 0.1


def test_copies_beyond_keep_come_in_id_order(sp):
    x = np.random.default_rng(8).standard_normal((1000, 16))
    x[100:400] = x[0]
    ids = np.concatenate([np.arange(100), np.arange(999, 699, -1), np.arange(100, 700)])
    extra = [(0, x[0].tolist(), 0), (701, x[0].tolist(), 0)]
    points = table(sp, x, ids, extra).selectExpr("vec_id", "cast(embedding as array<double>) embedding")
    asked = points.filter("vec_id in (0, 50, 100)").selectExpr("vec_id query_id", "embedding").dropDuplicates(["query_id"])
    got = additive_ann.search(points, asked, keep=60).toPandas().sort_values(["query_id", "rank"])
    assert list(got[got.query_id == 0].vec_id) == [700, 701, 701, *range(702, 709)]
    y = np.concatenate([x, [x[0], x[0]]]).astype(np.float32).astype(float)
    all_ids = np.concatenate([ids, [0, 701]])
    hits = 0
    for q in (50, 100):
        d = np.sqrt(((y - y[all_ids == q][0]) ** 2).sum(1))
        d[all_ids == q] = np.inf
        hits += len(set(got[got.query_id == q].vec_id) & set(all_ids[np.lexsort((all_ids, d))[:10]]))
    assert hits >= 18

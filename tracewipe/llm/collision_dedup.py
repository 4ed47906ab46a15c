"""Near-duplicate embeddings by collision counting over many sorted one-dimensional projections.

Every vector is scaled to length 1, centred and projected on ``m`` random directions. Along each
projection the values are sorted, and a vector looks at a window centred on its own value: two vectors
*collide* there if they are at most ``width`` apart. Windows in the crowded middle hold a large share of
all vectors whatever their similarity, so a vector only uses the projections where it lies in one of the
two sparse tails (its most extreme ``share`` of values): vectors of high cosine are extreme together.
Collisions are counted per pair over all projections; only pairs with ``count`` of them or more are
verified by exact cosine in double precision.

``width`` holds ``WINDOW`` of the differences of planted pairs (pairs of exactly the threshold
similarity around sampled vectors) that lie in one tail. ``count`` is ``COUNT`` at least: projections
are added until the planted pairs reach it with ``RECALL``, and it is then raised as far as they allow.
The tail share falls as one over the square root of the rows (``SHARE``), so work is about
rows ** 1.5 window pairs; few of them come to be verified.

Vectors that lie in fewer than ``least`` tails (members of a group so large that it would fill the tails
it lies in, which are not used, and vectors near the mean) cannot be trusted to collide: they leave the
lists and are compared with every vector instead. ``least`` is calibrated with the projections: the
smallest with which the planted pairs that are compared one way or the other reach ``RECALL``, so a plan
never falls below it; of the plans tried, the one with the least work is used, and ``calibrated`` raises
where none reaches it. W such vectors cost W * rows products.

Vectors that are equal bit for bit are one weighted row. Tail lists are bundled, so a vector goes once
to each bundle with a list of its; a list above ``BLOCK`` is cut into blocks by hash and pairs of blocks
are compared in separate tasks. Within a list, the other lists of its members are sorted and their windows
give the counts of the pairs; a pair that collides often is verified in one of its lists only. Tasks
emit counts of links per vector and a spanning forest of theirs, never pairs, so a group of near copies
costs arithmetic but no rows.

Defined results: vectors that are null, empty, zero or not finite, or of an unusual length, link
with nothing and stay alone; every row is returned, also where rows share an id; rows with a null id
stay alone too. Repeated rows link with each other. Very large finite values count like any others.
An empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import join_spread, saved, shuffle_partitions
from .components import connected_components
from .vectors import marked, matrix, sample_matrix, units

THRESHOLD = 0.9
RECALL = 0.999
COUNT = 3
WINDOW = 0.85
SHARE = 2.0  # times 1 / sqrt(rows)
LEAST_SHARE, MOST_SHARE = 1e-5, 0.05
CROWDED = 4.0  # a tail with this many times its share of the sample is not used
MOST_PROJECTIONS = 1 << 20
SAMPLE = 8_192
PLANTED = 16_000
MARGIN = 0.5  # share of the pairs that may be missed which the planted ones may miss, so that fresh pairs keep the recall
STEP = 32
ALONE_COST = 4.0  # of a vector that meets all, against a vector's pairs in the lists
BUNDLE = 65_536  # memberships of lists that one task takes together, about
BLOCK = 16_384
ALL_BLOCK = 1_024
PAIRS = 2_000_000
SEED = 23


@lru_cache(maxsize=64)
def _directions(dim: int, step: int) -> np.ndarray:
    """The ``STEP`` directions number ``step``, the same in every task."""
    return np.random.default_rng([SEED, step]).standard_normal((dim, STEP))


@dataclass
class Plan:
    mean: np.ndarray  # (dim,)
    low: np.ndarray  # (projections,): values at or below are in the lower tail
    high: np.ndarray
    width: float  # half the window
    count: int
    least: int  # vectors in fewer tails are compared with all
    recall: float
    alone: float  # share of these vectors in the sample

    @property
    def projections(self) -> int:
        return len(self.low)

    def tails(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, value) of every tail the vectors lie in, by row: list 2 j is the lower one of projection j, 2 j + 1 the upper."""
        y = unit - self.mean
        rows, lists, values = [], [], []
        for step in range(-(-self.projections // STEP)):
            at = slice(step * STEP, (step + 1) * STEP)
            p = y @ _directions(len(self.mean), step)
            r, j = np.nonzero((p <= self.low[at]) | (p >= self.high[at]))
            rows.append(r), values.append(p[r, j]), lists.append(2 * (step * STEP + j) + (p[r, j] >= self.high[at][j]))
        rows, lists, values = (np.concatenate(x) if x else np.array([], np.int64) for x in (rows, lists, values))
        order = np.argsort(rows, kind="stable")
        return rows[order], lists[order].astype(np.int32), values[order].astype(np.float32)


def _planted(unit: np.ndarray, threshold: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sampled vectors, and one of exactly the threshold similarity to each."""
    base = unit[rng.integers(0, len(unit), PLANTED)]
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    return base, threshold * base + np.sqrt(max(0.0, 1 - threshold**2)) * side / np.where(norm > 0, norm, 1)


def calibrated(sample: np.ndarray, rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
    """A plan whose count planted pairs of exactly the threshold similarity reach with ``recall``."""
    unit = units(sample)
    mean = unit.mean(axis=0)
    share = min(max(SHARE / np.sqrt(max(rows, 1)), LEAST_SHARE), MOST_SHARE)
    base, partner = _planted(unit, threshold, np.random.default_rng(SEED))
    crowd = max(CROWDED * share * len(unit), 8)
    width = np.inf
    lows, highs = [], []
    hits, own, other = np.zeros((3, PLANTED), np.int64)
    lost = int(MARGIN * (1 - recall) * PLANTED)  # pairs that may be missed
    tails = 0.0  # pairs in the tails, as a share of all pairs
    best, size, least, kept = np.inf, 0, 0, (hits, own, other)
    while len(lows) * STEP < MOST_PROJECTIONS:  # a few projections at a time
        towards = _directions(sample.shape[1], len(lows))
        own_values = (unit - mean) @ towards
        q1, middle, q3 = np.quantile(own_values, [0.25, 0.5, 0.75], axis=0)
        reach = NormalDist().inv_cdf(1 - share) * (q3 - q1) / 1.349
        low, high = middle - reach, middle + reach
        below, above = (own_values <= low).sum(axis=0), (own_values >= high).sum(axis=0)
        low, high = np.where(below > crowd, -np.inf, low), np.where(above > crowd, np.inf, high)
        p, q = (base - mean) @ towards, (partner - mean) @ towards
        a, b = ((v >= high).astype(np.int8) - (v <= low).astype(np.int8) for v in (p, q))
        same, apart = (a != 0) & (a == b), np.abs(p - q)
        if not np.isfinite(width) and same.any():
            width = float(np.quantile(apart[same], WINDOW))
        hits, own, other = hits + (same & (apart <= width)).sum(axis=1), own + (a != 0).sum(axis=1), other + (b != 0).sum(axis=1)
        for n, limit in ((below, low), (above, high)):
            tails += ((n[np.isfinite(limit)] / len(unit)) ** 2).sum() / 2
        lows.append(low), highs.append(high)
        missed = np.sort(np.minimum(own, other)[hits < COUNT])[::-1]
        needed = int(missed[lost]) + 1 if len(missed) > lost else 0
        cost = ALONE_COST * (own < needed).mean() + tails
        if cost < best:
            best, size, least, kept = cost, len(lows), needed, (hits, own, other)
        # more projections cannot pay any longer, or have not while their number doubled
        if needed == 0 or tails > best or best < 0.9 * ALONE_COST and len(lows) >= 2 * size + 8:
            break
    hits, own, other = kept
    exact = (own < least) | (other < least)
    count = COUNT if exact.all() else max(COUNT, int(np.sort(np.where(exact, np.iinfo(np.int64).max, hits))[lost]))
    count = min(count, int(hits[~exact].max(initial=COUNT)))
    got = float((exact | (hits >= count)).mean())
    if got < recall:
        raise ValueError(f"planted pairs are found with a recall of {got} only")
    return Plan(mean, np.concatenate(lows[:size]), np.concatenate(highs[:size]), width, count, least, got, float((own < least).mean()))


_TAILS = "id long, weight long, point binary, lists array<int>, at array<float>, alone boolean"
_ALL = -1  # the group in which vectors of few tails meet every vector


def _place(shared, dtype):
    """Each vector with the tails it lies in; none where they are too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                x = matrix(part.column(2))
                rows, lists, values = plan.tails(units(x))
                n = np.bincount(rows, minlength=len(x))
                alone = n < plan.least
                keep = ~alone[rows]
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(alone, 0, n))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([u.tobytes() for u in x.astype(dtype)], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(lists[keep])), pa.ListArray.from_arrays(offsets, pa.array(values[keep])), pa.array(alone)],
                    ["id", "weight", "point", "lists", "at", "alone"],
                )

    return run


class _Forest:
    """Union-find over the ids of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


class Counter:
    """Counts collisions of pairs within one task and verifies those that reach the count.

    A pair that collides in ``k`` lists has, in its list number ``k - count + 1``, exactly ``count - 1``
    collisions to come; there it is verified, and nowhere else.
    """

    def __init__(self, t: pa.Table, plan: Plan, threshold: float, dtype):
        self.plan, self.threshold = plan, threshold
        self.ids, self.weight = np.asarray(t.column("id")), np.asarray(t.column("weight"))
        self.unit = units(np.frombuffer(b"".join(t.column("point").to_pylist()), dtype).reshape(len(self.ids), -1).astype(float))
        lists, values = t.column("lists").combine_chunks(), t.column("at").combine_chunks()
        self.ends = np.cumsum(np.asarray(lists.value_lengths()))
        self.lists, self.values = np.asarray(lists.flatten()), np.asarray(values.flatten()).astype(float)
        self.row = np.repeat(np.arange(len(self.ids)), np.asarray(lists.value_lengths()))
        self.links = np.zeros(len(self.ids), np.int64)
        self.forest, self.edges = _Forest(), []
        self.collided = self.verified = 0

    def count(self, at: np.ndarray, block: np.ndarray | None = None, one: int = 0, two: int = 0) -> None:
        """``at``: the places of one list's entries. With ``block``, only pairs between the blocks ``one`` and ``two``."""
        member = self.row[at]
        later = self.ends[member] - at - 1
        at, member, later = at[later >= self.plan.count - 1], member[later >= self.plan.count - 1], later[later >= self.plan.count - 1]
        if len(member) < 2:
            return
        who = np.repeat(np.arange(len(member)), later)  # whose later entry
        entry = np.repeat(at + 1 - np.cumsum(later) + later, later) + np.arange(later.sum())
        order = np.lexsort((self.values[entry], self.lists[entry]))
        who, entry = who[order], entry[order]
        # one axis for all later lists, far apart; the window of a query is centred on its own value
        run = np.cumsum(np.concatenate(([0], self.lists[entry[1:]] != self.lists[entry[:-1]])))
        value = self.values[entry]
        value = value + run * (np.ptp(value) + 2 * self.plan.width + 1)
        lo, hi = np.searchsorted(value, value - self.plan.width), np.searchsorted(value, value + self.plan.width, side="right")
        by_query = np.argsort(who, kind="stable")
        seen = np.cumsum((hi - lo)[by_query])
        start = 0
        while start < len(by_query):  # queries of some window pairs at a time
            stop = max(start + 1, int(np.searchsorted(seen, (seen[start - 1] if start else 0) + PAIRS, side="right")))
            while stop < len(by_query) and who[by_query[stop]] == who[by_query[stop - 1]]:
                stop += 1
            q = by_query[start:stop]
            start, n = stop, (hi - lo)[q]
            u, v = np.repeat(who[q], n), who[np.repeat(lo[q] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            ok = (u < v) & (np.abs(self.values[at[u]] - self.values[at[v]]) <= self.plan.width)
            if block is not None:
                bu, bv = block[member[u]], block[member[v]]
                ok &= (np.minimum(bu, bv) == one) & (np.maximum(bu, bv) == two)
            code, hits = np.unique(u[ok] * len(member) + v[ok], return_counts=True)
            self.collided += len(code)
            code = code[hits == self.plan.count - 1]
            self._verify(member[code // len(member)], member[code % len(member)])

    def _verify(self, a: np.ndarray, b: np.ndarray) -> None:
        self.verified += len(a)
        ok = np.einsum("ij,ij->i", self.unit[a], self.unit[b]) >= self.threshold
        a, b = a[ok], b[ok]
        np.add.at(self.links, a, self.weight[b])
        np.add.at(self.links, b, self.weight[a])
        for u, v in zip(self.ids[a].tolist(), self.ids[b].tolist(), strict=True):
            if self.forest.join(u, v):
                self.edges.append((u, v))

    def found(self) -> Iterator[pa.RecordBatch]:
        return _found(self.ids, self.links, self.edges)


def _bundle(c: Counter, bundle: int, bundles: int, large: np.ndarray) -> None:
    """All lists of the bundle but the large ones."""
    at = np.flatnonzero((c.lists % bundles == bundle) & ~np.isin(c.lists, large))
    at = at[np.argsort(c.lists[at], kind="stable")]
    own = c.lists[at]
    for part in np.split(at, np.flatnonzero(own[1:] != own[:-1]) + 1):
        c.count(part)


def _compare(shared, threshold: float, dtype, bundles: int):
    """Links within the groups that come together, as counts per vector and forest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, large = shared.value
        for (group, one, two), t in _by_key(batches):
            if group == _ALL:
                yield from _all_links((group, one, two), t, threshold, dtype)
                continue
            c = Counter(t, plan, threshold, dtype)
            if group < bundles:
                _bundle(c, group, bundles, large)
            else:
                c.count(np.flatnonzero(c.lists == group - bundles), np.asarray(t.column("block")), one, two)
            yield from c.found()

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """Runs of rows with one (list, one, two); rows come sorted by it."""
    key, parts = None, []
    for b in batches:
        k = np.stack([np.asarray(b.column(i)) for i in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            now = tuple(k[lo].tolist())
            if key is not None and now != key:
                yield key, pa.Table.from_batches(parts)
                parts = []
            key = now
            parts.append(b.slice(lo, hi - lo))
    if parts:
        yield key, pa.Table.from_batches(parts)


def _padded(column: pa.ChunkedArray, fill: float, dtype) -> np.ndarray:
    a = column.combine_chunks()
    n = np.asarray(a.value_lengths())
    out = np.full((len(n), int(n.max(initial=1))), fill, dtype)
    out[np.arange(out.shape[1]) < n[:, None]] = np.asarray(a.flatten())
    return out


def _all_links(key: tuple[int, int, int], t: pa.Table, threshold: float, dtype) -> Iterator[pa.RecordBatch]:
    """Links between two blocks, or within one, by all products."""
    _, one, two = key
    block = np.asarray(t.column("block"))
    ids, weight = np.asarray(t.column("id")), np.asarray(t.column("weight"))
    x = units(np.frombuffer(b"".join(t.column("point").to_pylist()), dtype).reshape(len(ids), -1).astype(float))
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    count, label, edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    for lo in range(0, len(left), 256):
        a = left[lo : lo + 256]
        products = x[a] @ x[right].T
        ok = products >= threshold
        i, j = np.nonzero(np.abs(products - threshold) < 1e-9)  # rounded as in the lists
        ok[i, j] = np.einsum("ij,ij->i", x[a[i]], x[right[j]]) >= threshold
        if one == two:
            ok &= a[:, None] < right[None]
        count[a] += ok @ weight[right]
        count[right] += weight[a] @ ok
        for u in np.flatnonzero(ok.any(axis=1)):
            joined = np.unique(np.append(label[right[ok[u]]], label[a[u]]))
            if len(joined) > 1:
                edges += [(int(ids[joined[0]]), int(ids[v])) for v in joined[1:]]
                label[np.isin(label, joined[1:])] = joined[0]
    yield from _found(ids, count, edges)


def _found(ids: np.ndarray, count: np.ndarray, edges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(count)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(np.full(len(some), None), pa.int64()), pa.array(count[some])], ["a", "b", "n"])
    if edges:
        u, v = zip(*edges, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array([0] * len(u), pa.int64())], ["a", "b", "n"])


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    n = shuffle_partitions(spark)
    rows = marked(vectors)
    points = rows.filter("usable").select("vec_id", "embedding")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # a group is a vector, numbered for itself: rows that share an id may hold different vectors
    groups = points.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    groups = saved(groups.select("*", F.monotonically_increasing_id().alias("id")), "emb-groups")
    sample = sample_matrix(groups.select(F.col("least").alias("vec_id"), "embedding"), SAMPLE, SEED)
    if not len(sample):
        return alone.withColumn("kept", F.lit(True))
    # vectors travel as they are stored: floats stay floats, and cosines are taken in double precision
    kind = vectors.schema["embedding"].dataType
    dtype = np.float32 if isinstance(kind.elementType, FloatType) else np.float64
    size = groups.agg(F.count("*").alias("n"), F.sum("weight").alias("rows")).first()
    plan = calibrated(sample, size["n"], threshold, recall)
    placed = saved(groups.select("id", "weight", "embedding").mapInArrow(_place(spark.sparkContext.broadcast(plan), dtype), _TAILS), "emb-tails")
    lists = saved(placed.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")), "emb-lists")
    large = lists.filter(F.col("n") > BLOCK).select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    names = np.array([r["list"] for r in large.select("list").collect()], np.int32)  # of two lists for each projection at most
    bundles = max(1, -(-(lists.filter(F.col("n") <= BLOCK).agg(F.sum("n")).first()[0] or 0) // BUNDLE))
    shape = ["group", "one", "two", "block", "id", "weight", "point", "lists", "at"]
    bundle = F.explode(F.array_distinct(F.transform("lists", lambda x: F.pmod(x, F.lit(bundles)))))
    member = placed.select("*", bundle.alias("group")).withColumn("one", F.lit(0)).withColumn("two", F.lit(0)).withColumn("block", F.lit(0)).select(*shape)
    if len(names):
        cut = placed.select("*", F.explode("lists").alias("list")).join(F.broadcast(large), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("group", F.col("list") + bundles)
        member = member.unionByName(cut.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).select(*shape))
    few = placed.filter("alone").count()
    if few:
        # blocks of the vectors of few tails come first: they meet all blocks, the others meet only them
        mine, others = -(-few // ALL_BLOCK), -(-(size["n"] - few) // ALL_BLOCK)
        block = F.when(F.col("alone"), F.pmod(F.xxhash64("id"), F.lit(mine))).otherwise(mine + F.pmod(F.xxhash64("id"), F.lit(max(others, 1)))).cast("int")
        every = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("alone"), mine + others).otherwise(mine) - 1)))
        every = every.select(F.lit(_ALL).alias("group"), F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "weight", "point", F.array().cast("array<int>").alias("lists"), F.array().cast("array<float>").alias("at"))
        member = member.unionByName(every)
    dealt = member.repartition(n, "group", "one", "two").sortWithinPartitions("group", "one", "two")
    found = saved(dealt.mapInArrow(_compare(spark.sparkContext.broadcast((plan, names)), threshold, dtype, bundles), "a long, b long, n long"), "emb-links")
    tied = connected_components(found.filter("b is not null").select("a", "b"))
    degree = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    known = groups.join(degree, "id", "left").join(tied.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("embedding", "weight", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    known = saved(known, "emb-known")
    lowest = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    known = join_spread(known, lowest, ["component"], "members", size["n"]).select("embedding", "weight", "n_links", "component_id")
    done = join_spread(points, saved(known, "emb-lowest"), ["embedding"], "weight", size["rows"]).select("vec_id", "n_links", "component_id")
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: Brute force over all pairs.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v),
steps AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) >= 0.9 * a.size * b.size),
reach AS (SELECT DISTINCT x AS a, x AS b FROM steps UNION SELECT r.a, t.y FROM reach r JOIN steps t ON r.b = t.x),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT u.vec_id, (SELECT count(*) FROM steps WHERE x = u.vec_id) AS n_links, coalesce(low, u.vec_id) AS component_id, coalesce(low, u.vec_id) = u.vec_id AS kept
FROM u LEFT JOIN low ON low.a = u.vec_id
"""

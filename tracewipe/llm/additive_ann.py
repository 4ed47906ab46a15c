"""Nearest neighbours by additive quantisation.

A vector is a length times a direction. The direction is coded as the sum of one codeword from each of
``BOOKS`` codebooks; all codewords have the full dimension and each book is trained on the residuals
that the books before it leave. Encoding is a beam search over the books. With the coded direction's
squared norm and the length stored, the distance to a query is a few products and ``BOOKS`` table
look-ups; the ``KEEP`` best of each query are ranked again on the original vectors in double precision.
Directions have length 1, so books and sums stay in range whatever the vectors' lengths are.

The books are fitted on ``SAMPLE`` vectors at most (by a hash of the id, the driver holds no more);
every vector is encoded and searched, once if several rows have it: copies are put in its place after
the ranking, those with the smallest ids, as many as a query can need. Codes are packed into blocks and
dealt to *spans* once; groups of queries go to every span, where a task holds a span's codes and streams
the groups past them. Neither side is broadcast, and what a query keeps per span is ``KEEP`` rows.

Defined results: vectors that are null, empty, zero or not finite, and rows with a null id, take no
part, neither as query nor as candidate; so do vectors of an unusual length. Very large and very small
finite components take part; squares beyond a double's range make a distance infinite, as they do in
SQL, and distances that are equal in double precision are ties. Repeated rows are candidates of their
own; a query's own row is left out by id. With fewer candidates than asked, all are returned. Ties go
to the smaller id. An empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions
from .vectors import lengths, matrix, sample_matrix, usable

BOOKS, WORDS = 32, 256
BEAM = 6
SAMPLE = 16_384
ROUNDS = 8
KEEP = 256
RECALL = 0.98
CALIBRATED, ASKED = 4096, 128  # vectors of the sample that are coded to calibrate, and queries among them
KEPT = 1 << 22  # candidates that one task holds at most, about
CODE_BLOCK = 8192
QUERY_BLOCK = (16, 512)  # least and most queries that one task scores together
SPAN = 1 << 21  # codes that a task holds at most, about
BROADCAST_BYTES = 64 << 20
SEED = 11


@dataclass
class Books:
    words: np.ndarray  # (books, words, dim) float32
    mean: np.ndarray  # (dim,) float32, of the directions


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Plain k-means; an empty cell restarts at a random vector."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1)[None] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        total = np.add.reduceat(x[order], np.minimum(np.cumsum(n) - n, len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))]).astype(np.float32)
    return c


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions in float32 and lengths in double; the largest component is taken out first, so squares stay in range."""
    size = lengths(x)
    top = np.abs(x).max(axis=1)
    scaled = x / top[:, None]
    return (scaled / np.sqrt((scaled**2).sum(1))[:, None]).astype(np.float32), size


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS) -> Books:
    """Residual codebooks of the directions: each on what the ones before leave of the sample."""
    rng = np.random.default_rng(SEED)
    unit, _ = directions(sample)
    mean = unit.mean(axis=0)
    rest = unit - mean
    out = []
    for _ in range(books):
        c = _means(rest, min(words, len(rest)), rng)
        out.append(c)
        rest = rest - c[np.argmin((c**2).sum(1)[None] - 2 * rest @ c.T, axis=1)]
    return Books(np.stack(out).astype(np.float32), mean.astype(np.float32))


def encode(unit: np.ndarray, books: Books, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) uint8 of directions and squared norms of the coded directions, by beam search."""
    x = unit - books.mean
    n, dim = x.shape
    rest = x[:, None, :]  # (n, beams, dim)
    codes = np.zeros((n, 1, 0), np.uint8)
    rows = np.arange(n)[:, None]
    for c in books.words:
        cost = (rest**2).sum(2)[:, :, None] + (c**2).sum(1)[None, None] - 2 * (rest.reshape(-1, dim) @ c.T).reshape(n, -1, len(c))
        flat = cost.reshape(n, -1)
        k = min(beam, flat.shape[1])
        best = np.argpartition(flat, k - 1, axis=1)[:, :k]
        parent, word = best // len(c), best % len(c)
        rest = rest[rows, parent] - c[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
    top = np.argmin((rest**2).sum(2), axis=1)
    rows = np.arange(n)
    coded = unit - rest[rows, top]
    return codes[rows, top], (coded.astype(float) ** 2).sum(1)


def costs(codes: np.ndarray, norms: np.ndarray, size: np.ndarray, books: Books, unit: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """(codes, queries): squared distance less the query's own square, by table look-ups in double precision."""
    look = np.einsum("qd,mwd->mwq", unit, books.words, optimize=True)
    along = np.repeat((unit @ books.mean)[None], len(codes), axis=0)
    for m in range(codes.shape[1]):
        along += look[m][codes[:, m]]
    with np.errstate(over="ignore"):
        out = size[:, None] * (size[:, None] * norms[:, None] - 2 * asked[None] * along)
    return np.nan_to_num(out, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def candidates(sample: np.ndarray, books: Books, total: int, k: int, least: int = KEEP) -> int:
    """How many codes to keep so that ``RECALL`` of the ``k`` nearest of ``total`` vectors are among them; ``least`` or more.

    Measured on a sample in random order: the place that each of a query's true nearest has by its code. Among more
    vectors as many more come before it, and the nearest come nearer, so the share found there is a lower bound.
    Where codes tell little apart this comes to all vectors, which makes the search exact.
    """
    x = sample[:CALIBRATED]
    if len(x) <= k + 1:
        return max(least, total)
    unit, size = directions(x)
    codes, norms = encode(unit, books)
    asked = np.arange(min(ASKED, len(x)))
    cost = costs(codes, norms, size, books, unit[asked], size[asked])
    top = np.abs(x).max()
    scaled = x / top
    square = (scaled**2).sum(1)
    true = square[:, None] - 2 * scaled @ scaled[asked].T
    cost[asked, asked] = true[asked, asked] = np.inf
    near = np.argpartition(true, k - 1, axis=0)[:k]
    place = np.argsort(np.argsort(cost, axis=0, kind="stable"), axis=0)[near, asked[None]] + 1
    needed = np.quantile(place, RECALL, method="higher")
    return int(min(total, max(least, np.ceil(needed * max(1.0, total / len(x))))))


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            cols = [np.concatenate(v) for v in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([len(cols[0])], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], ["n", "ids", "codes", "norms", "sizes"])

        for b in batches:
            x = matrix(b.column(1))
            for at in range(0, len(x), 1024):
                unit, size = directions(x[at : at + 1024])
                held.append((np.asarray(b.column(0))[at : at + 1024], *encode(unit, shared.value), size))
                if sum(len(h[0]) for h in held) >= CODE_BLOCK:
                    yield block()
                    held = []
        if held:
            yield block()

    return run


def _least(cost: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``keep`` by (cost, id)."""
    if len(cost) <= keep:
        return cost, ids
    some = np.flatnonzero(cost <= np.partition(cost, keep - 1)[keep - 1])
    some = some[np.lexsort((ids[some], cost[some]))[:keep]]
    return cost[some], ids[some]


def _distinct(points: DataFrame, copies: int) -> DataFrame:
    """(key, embedding, copies): each vector once, with its ``copies`` smallest ids and how many rows have them."""
    rows = points.groupBy("embedding", "vec_id").agg(F.count("*").alias("n"))
    low = Window.partitionBy("embedding").orderBy("vec_id")
    rows = rows.withColumn("at", F.row_number().over(low)).filter(F.col("at") <= copies)
    rows = rows.groupBy("embedding").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("copies"))
    return rows.select(F.xxhash64("embedding").alias("key"), "embedding", "copies")


def _scan(shared, keep: int):
    """The ``keep`` best codes of each query over the blocks of one span; a group's blocks come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Books = shared.value
        group, asked = None, None
        best: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            for i in range(b.num_rows):
                now = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if now != group:
                    yield from _best(asked, best)
                    group, asked = now, np.asarray(b.column(2)[i].values)
                    unit, size = directions(np.asarray(b.column(3)[i].values.flatten()).reshape(len(asked), -1))
                    best = [(np.array([]), np.array([], np.int64))] * len(asked)
                ids, codes, norms, sizes = (np.frombuffer(b.column(k)[i].as_py(), t) for k, t in zip(range(4, 8), (np.int64, np.uint8, float, float), strict=True))
                cost = costs(codes.reshape(len(ids), -1), norms, sizes, books, unit, size)
                for j in range(len(asked)):
                    c, k = _least(cost[:, j], ids, keep)
                    best[j] = _least(np.concatenate([best[j][0], c]), np.concatenate([best[j][1], k]), keep)
        yield from _best(asked, best)

    def _best(asked: np.ndarray | None, best: list) -> Iterator[pa.RecordBatch]:
        if best:
            size = [len(c) for c, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, size)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([c for c, _ in best]))], ["query_id", "key", "cost"])

    return run


def search(points: DataFrame, queries: DataFrame, k: int = 10, keep: int = KEEP, books: Books | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query by Euclidean distance.

    ``points`` is (vec_id, embedding) and ``queries`` (query_id, embedding), both of usable vectors of
    one length; a point whose id is the query's is left out.
    """
    spark = points.sparkSession
    n = shuffle_partitions(spark)
    # one id and one vector more than asked, as the query's own may be among them
    distinct = saved(_distinct(points, k + 1), "aq-distinct")
    if books is None:
        sample = sample_matrix(distinct.select(F.col("copies")[0]["vec_id"].alias("vec_id"), "embedding"), SAMPLE, SEED)
        if not len(sample):
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        sample, all_points = sample[np.random.default_rng(SEED).permutation(len(sample))], distinct.count()
        # codes fit what they were learnt from better than the rest, so where there is a rest others calibrate
        fitted = sample[CALIBRATED:] if all_points > len(sample) > 2 * CALIBRATED else sample
        books = fit(fitted)
        keep = candidates(sample[:CALIBRATED], books, all_points, k, keep)
    keep += 1
    shared = spark.sparkContext.broadcast(books)
    codes = saved(distinct.select("key", "embedding").mapInArrow(_encode(shared), "n int, ids binary, codes binary, norms binary, sizes binary"), "aq-codes")
    total, held = queries.count(), codes.agg(F.count("*"), F.sum("n")).first()
    spans = max(1, min(n, held[0]), -(-(held[1] or 0) // SPAN))
    size = min(max(-(-total // n), QUERY_BLOCK[0]), QUERY_BLOCK[1], max(1, KEPT // keep))
    groups = max(1, -(-total // size))
    asked = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("q"))
    asked = asked.select("group", F.col("q.query_id").alias("queries"), F.col("q.embedding").alias("points"), F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"))
    blocks = codes.select("*", F.pmod(F.xxhash64("ids"), F.lit(spans)).cast("int").alias("span"))
    met = asked.join(blocks.hint("shuffle_hash"), "span").select("group", "span", "queries", "points", "ids", "codes", "norms", "sizes")
    found = met.mapInArrow(_scan(shared, keep), "query_id long, key long, cost double")
    order = Window.partitionBy("query_id").orderBy("cost", "key")
    found = found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= keep).select("query_id", "key").distinct()
    # the queries' vectors go to the candidates while they are small, by a shuffle beyond that
    small = total * 8 * len(books.mean) <= BROADCAST_BYTES
    pairs = found.join(distinct, "key").join(queries.select("query_id", F.col("embedding").alias("asked")).hint("broadcast" if small else "merge"), "query_id")
    square = F.aggregate(F.zip_with("embedding", "asked", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    pairs = pairs.select("query_id", F.sqrt(square).alias("score"), F.filter("copies", lambda c: c["vec_id"] != F.col("query_id")).alias("copies"))
    near = Window.partitionBy("query_id").orderBy("score", F.col("copies")[0]["vec_id"])
    pairs = pairs.filter(F.size("copies") > 0).withColumn("at", F.row_number().over(near)).filter(F.col("at") <= k)
    pairs = pairs.select("query_id", "score", F.explode("copies").alias("c"))
    again = F.explode(F.sequence(F.lit(1), F.least(F.col("c.n"), F.lit(k)).cast("int")))  # repeated rows
    pairs = pairs.select("query_id", "score", F.col("c.vec_id").alias("vec_id"), again.alias("copy"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 100) -> DataFrame:
    """Searches ``vectors`` for each row whose id is divisible by ``every``."""
    points = usable(vectors)
    asked = points.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(points, asked.groupBy("query_id").agg(F.min("embedding").alias("embedding")))  # of vectors that share a query's id the smallest asks


#: Brute force; the index finds all of it where no query has more than ``KEEP`` candidates.
ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM near)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

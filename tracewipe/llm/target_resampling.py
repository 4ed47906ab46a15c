"""Resampling towards a target distribution with an integer word dictionary.

Each task cuts its texts into blocks of some ``BLOCK`` bytes and numbers the words of a block as they
come, so a word leaves a block once, however often it stands there. Then, by shuffles of such entries:

1. the distinct words of all blocks get ids (the dictionary);
2. ids go back to the blocks, whose n-grams become tuples of ids, each with its count in the block;
3. every distinct tuple is written out as words again and hashed, once, to a bucket; its counts are
   summed to those of its bucket;
4. a bucket's gain, the logarithm of its share in the target over that in the documents, goes back to
   the tuples and through them to the blocks, where a document's gains are summed.

Documents are drawn without replacement by the largest sums of weight and Gumbel noise, seeded by the
id; ranks come from one range-partitioned sort. As a block holds an entry once, even a word of every
text has one row per block; blocks are the only groups collected, and they are bounded by ``BLOCK``
and one text.

Defined results: null and wordless texts have no features and weight 0; a document without an id takes
part like any other, with the noise of the text ``null``, and loses ties; repeated rows are drawn one
by one. Where no document has enough words none is drawn; an empty table gives an empty table, an
empty target leaves only the documents' own counts in the gains. Texts are read whole, however long.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, saved

LONGEST = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
BLOCK = 16 << 20  # bytes of text after which a block ends
SLICE = 1 << 20  # bytes of a text that are split into words at once

_ROW = pa.struct([("doc_id", pa.int64()), ("n_words", pa.int64()), ("grams", pa.list_(pa.int32()))])
_ROW_TYPE = "array<struct<doc_id: long, n_words: long, grams: array<int>>>"
_BLOCKS = f"block long, target boolean, words array<string>, grams array<array<int>>, counts array<long>, rows {_ROW_TYPE}"

#: Bytes outside 0-9, A-Z, a-z and those of non-ASCII characters become spaces; A-Z is lowered.
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def _word_slices(text: bytes) -> Iterator[list[bytes]]:
    """Words of the text in order, a ``SLICE`` at a time, never cut."""
    at = 0
    while at < len(text):
        end = at + SLICE
        part = text[at:end].translate(_WORD_BYTES)
        if end < len(text):
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):  # a word longer than a slice
                part, end = part + text[end : end + SLICE].translate(_WORD_BYTES), end + SLICE
                cut = part.rfind(b" ") if end < len(text) else -1
            if cut >= 0:
                part, end = part[:cut], at + cut + 1
        yield part.split()
        at = end


class _Block:
    """Texts with words and n-grams numbered in the order of their first occurrence here."""

    def __init__(self, longest: int):
        self.longest, self.size = longest, 0
        self.words: dict[bytes, int] = defaultdict(count().__next__)
        self.tuples: dict[tuple[int, ...], int] = defaultdict(count().__next__)
        self.doc_ids: list[int | None] = []
        self.n_words: list[int] = []
        self.grams: list[np.ndarray] = []

    def add(self, doc_id: int | None, text: bytes) -> None:
        parts = [np.fromiter(map(self.words.__getitem__, w), np.int32, len(w)) for w in _word_slices(text)]
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        if self.longest > 1:
            plain = ids.tolist()
            runs = [np.fromiter(map(self.tuples.__getitem__, zip(*(plain[k:] for k in range(n)), strict=False)), np.int32) for n in range(1, self.longest + 1)]
            grams = np.concatenate(runs)
        else:  # a word's number is that of its tuple
            grams = ids
        self.doc_ids.append(doc_id)
        self.n_words.append(len(ids))
        self.grams.append(grams)
        self.size += len(text) + 64

    def batch(self, number: int, target: bool) -> pa.RecordBatch:
        words = pa.array(list(self.words), pa.binary()).cast(pa.string())
        if self.longest > 1:
            tuples = pa.array(list(self.tuples), pa.list_(pa.int32()))
        else:
            n = np.arange(len(self.words) + 1, dtype=np.int32)
            tuples = pa.ListArray.from_arrays(pa.array(n), pa.array(n[:-1]))
        every = np.concatenate(self.grams)
        ends = np.cumsum([0, *map(len, self.grams)], dtype=np.int64).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(self.doc_ids, pa.int64()), pa.array(self.n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(every))], fields=list(_ROW))
        counts = pa.array(np.bincount(every, minlength=len(tuples)).astype(np.int64))
        columns = [pa.array([number], pa.int64()), pa.array([target])]
        for values in (words, tuples, counts, rows):
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.RecordBatch.from_arrays(columns, ["block", "target", "words", "grams", "counts", "rows"])


def encoded(docs: DataFrame, target: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The texts of both tables in numbered blocks, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().partitionId() << 32)
        blocks = {}
        for b in batches:
            for doc_id, text, goal in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                held = blocks.setdefault(goal, _Block(longest))
                held.add(doc_id, bytes(text.as_buffer()) if text.is_valid else b"")
                if held.size >= BLOCK:
                    yield blocks.pop(goal).batch(next(numbers), goal)
        for goal, held in blocks.items():
            yield held.batch(next(numbers), goal)

    both = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.lit(False).alias("goal"))
    both = both.unionAll(target.select(F.lit(None).cast("long"), target["text"], F.lit(True)))
    return saved(both.mapInArrow(run, _BLOCKS), "resample-blocks", rows_per_file=1)  # a row is a block


def _as_tuples(key, grams: pa.Table, ids: pa.Table) -> pa.Table:
    """A block's n-grams as tuples of dictionary ids: (block, at, ids, n, target)."""
    local = grams.column("grams").combine_chunks().flatten()
    known = np.empty(ids.num_rows, np.int64)
    known[ids.column("at").to_numpy()] = ids.column("id").to_numpy()
    tuples = pa.ListArray.from_arrays(pc.subtract(local.offsets, local.offsets[0]), pa.array(known[local.flatten().to_numpy()]))
    n = len(tuples)
    counts = grams.column("counts").combine_chunks().flatten()
    return pa.table([pa.array(np.full(n, grams.column("block")[0].as_py(), np.int64)), pa.array(np.arange(n, dtype=np.int32)), tuples, counts, pa.array(np.full(n, grams.column("target")[0].as_py()))], ["block", "at", "ids", "n", "target"])


def id_tuples(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """(block, at, ids, n, target): the distinct n-grams of each block as tuples of ``words``'s ids."""
    local = blocks.select("block", F.posexplode("words").alias("at", "word"))
    ids = local.join(words, "word").select(F.col("block").alias("of"), "at", "id")
    grams = blocks.select("block", "target", "grams", "counts").filter(F.size("grams") > 0)
    return grams.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(_as_tuples, "block long, at int, ids array<long>, n long, target boolean")


def dictionary(blocks: DataFrame) -> DataFrame:
    """(word, id) for each distinct word of the blocks; ids are distinct, not consecutive."""
    words = blocks.select(F.explode("words").alias("word")).distinct()
    return saved(words.select("word", F.monotonically_increasing_id().alias("id")), "resample-words")


def hashed(tuples: DataFrame, words: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(ids, bucket, s, t) for each distinct tuple: its words' bytes hashed once, its counts in documents and target."""
    distinct = tuples.groupBy("ids").agg(F.sum(F.when(~F.col("target"), F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("target"), F.col("n")).otherwise(0)).alias("t"))
    for k in range(longest):
        word = words.select(F.col("id").alias(f"id_{k}"), F.col("word").alias(f"word_{k}"))
        distinct = distinct.withColumn(f"id_{k}", F.get("ids", F.lit(k))).join(word, f"id_{k}", "left" if k else "inner")
    text = F.concat_ws(" ", *[F.col(f"word_{k}") for k in range(longest)])
    return distinct.select("ids", (F.crc32(text.cast("binary")) % buckets).alias("bucket"), "s", "t")


def gains(tuples: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that occur: at most ``buckets`` rows."""
    own = tuples.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    whole = own.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return own.join(F.broadcast(whole)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))  # one row of totals


def _weighed(key, rows: pa.Table, gain: pa.Table) -> pa.Table:
    docs = rows.column("rows").combine_chunks().flatten()
    of = np.zeros(gain.num_rows, np.int64)
    of[gain.column("at").to_numpy()] = gain.column("gain").to_numpy()
    doc_id, n_words, grams = docs.flatten()
    ends = grams.offsets.to_numpy().astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(of[grams.flatten().to_numpy()])])
    ends = ends - ends[0]
    return pa.table([doc_id, n_words, pa.array(np.diff(ends)), pa.array(upto[ends[1:]] - upto[ends[:-1]])], ["doc_id", "n_words", "n_features", "weight"])


def weights(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document: the sum of its n-grams' gains."""
    spark = docs.sparkSession
    blocks = encoded(docs, target, longest)
    words = dictionary(blocks)
    tuples = saved(id_tuples(blocks, words), "resample-tuples")
    distinct = saved(hashed(tuples, words, longest, buckets), "resample-hashed")
    for path in {f.rsplit("/", 1)[0] for f in words.inputFiles()}:
        remove(spark, path)
    known = distinct.join(F.broadcast(gains(distinct, buckets)), "bucket").select("ids", "gain")  # at most ``buckets`` rows
    back = tuples.filter(~F.col("target")).select("block", "at", "ids").join(known, "ids").select(F.col("block").alias("of"), "at", "gain")
    rows = blocks.filter(~F.col("target")).select("block", "rows")
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_weighed, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Noise in thousandths, from the first 32 bits of a SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``place`` (from 1) in the given order: sorted by ranges, counted by range."""
    parts = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    parts = parts.withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the sort
    sizes = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = F.col("at") - F.shiftleft("part", 33)
    return parts.join(F.broadcast(sizes), "part").withColumn("place", F.col("earlier") + inside + 1).drop("part", "at", "earlier")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn.
    """
    scored = saved(weights(docs, target, longest, buckets).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scores")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = ranked(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "resample-ranks")
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, rank.alias("rank")).unionByName(rest)


ORACLE = r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, s: xor(a >> 1, 3988292384 * (a & 1))) AS v FROM range(256) t(i))),
texts AS (
  SELECT 0 AS goal, doc_id, row_number() OVER () AS k, text FROM documents
  UNION ALL SELECT 1, NULL, 0, text FROM benchmark),
words AS (
  SELECT goal, doc_id, k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
used AS (SELECT goal, doc_id, k, unnest(w) AS word FROM words),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM used)),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
         lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) % 10000 AS bucket
  FROM spelt, tab),
sums AS (
  SELECT bucket, CAST(count(*) FILTER (goal = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (goal = 1) AS DOUBLE) AS t FROM used JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM sums),
weighed AS (
  SELECT k, CAST(count(*) AS BIGINT) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM used JOIN hashed USING (word) JOIN gains USING (bucket) WHERE goal = 0 GROUP BY k),
scored AS (
  SELECT t.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(t.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM texts t LEFT JOIN weighed USING (k) WHERE goal = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS able
  FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM placed
"""

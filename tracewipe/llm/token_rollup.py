"""Token totals kept up to date by deltas: signed inserts, deletes and revised counts.

A batch of changes is aggregated to one signed row per (source, lang, version), written to a folder of
its own, and committed by a marker (see ``markers``): a small file under the batch's id that names the
folder, appears whole and never replaces another. A batch whose marker is there changes nothing, so
retries and replays are safe; folders without a marker of theirs are ignored. Totals are the sum over
the committed folders; ``compact`` folds them into a snapshot, itself put in place by a marker, and only
then removes them. A snapshot names every folder that is folded and still there, also those that an
earlier run could not remove, so a run may stop after any step and nothing is counted twice. Markers
stay, so a folded batch is still known. The driver lists what is not folded yet, never the whole history.
A reader that meets a folder just folded fails and may read again.

Changes carry their sign themselves (+1 for an insert, -1 for a delete; a revision is a delete of
the old count and an insert of the new one), so no document table is kept and a third of all rows in
one source only makes one partial sum per task.

Defined results: null text counts 0 tokens but one document; null source or language form groups of
their own; a null id meets no label; repeated rows in a batch count as often as they occur; groups whose documents and tokens
come to 0 are left out; an empty batch commits and changes nothing; an empty table gives no totals.
Texts are counted whole, however long. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch_path
from .markers import claim, drop, names, read_marker
from .mixing import word_count
from .packing import default_tokenizer, encoder

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"
BROADCAST_MARKS = 1_000_000

#: Token counts that SQL expresses, by version name.
COUNTERS: dict[str, Callable[[Column], Column]] = {
    "words-1": word_count,
    "bytes-1": lambda text: F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
}
#: The version counted with the byte-level vocabulary file.
BPE = "byte-bpe-50k-1"


def counted(docs: DataFrame, version: str) -> DataFrame:
    """(source, lang, version, n_tokens) for each document under a version of ``COUNTERS``."""
    return docs.select("source", "lang", F.lit(version).alias("version"), COUNTERS[version](F.col("text")).alias("n_tokens"))


def counted_by(docs: DataFrame, version: str, path: str) -> DataFrame:
    """As ``counted``, with the ids of the byte-level BPE file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            n = [len(encode(t)) if (t := x.as_py()) else 0 for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["source", "lang", "version", "n_tokens"])

    return docs.select("source", "lang", "text").mapInArrow(run, "source string, lang string, version string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    return deletes(old).unionByName(inserts(new))


def write(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


class Rollup:
    """Committed batches below one folder of the shared file system.

    ``batches/<id>~<attempt>`` holds a batch's delta, ``commits/<id>`` its marker; ``snapshots/<number>``
    is a snapshot's marker: its folder and the batch folders that it has folded in.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "rollup")

    def _marker(self, batch_id: str) -> str:
        if not batch_id or any(not (c.isalnum() or c in "-_.") for c in batch_id) or batch_id.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"{self.path}/commits/{batch_id}"

    def _names(self, folder: str) -> list[str]:
        return names(self.spark, f"{self.path}/{folder}")

    def is_committed(self, batch_id: str) -> bool:
        return bool(read_marker(self.spark, self._marker(batch_id)))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds the signed ``changes`` once; False where the batch was there before."""
        marker = self._marker(batch_id)
        if read_marker(self.spark, marker):
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        name = f"{batch_id}~{uuid.uuid4().hex[:12]}"
        write(delta, f"{self.path}/batches/{name}")
        if claim(self.spark, marker, name):
            return True
        drop(self.spark, f"{self.path}/batches/{name}")
        return False

    def _state(self) -> tuple[int, str | None, list[str], list[str]]:
        """Number and folder of the latest snapshot (0 and None before the first), folded folders that are still there, committed ones beyond it."""
        number, folder, folded = 0, None, []
        if done := [n for n in self._names("snapshots") if n.isdigit()]:
            held = json.loads(read_marker(self.spark, f"{self.path}/snapshots/{done[-1]}"))
            number, folder, folded = int(done[-1]), held["totals"], held["folded"]
        there, gone = self._names("batches"), set(folded)
        fresh = [n for n in there if n not in gone and read_marker(self.spark, self._marker(n.rpartition("~")[0])) == n]
        return number, folder, [n for n in there if n in gone], fresh

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        _, snapshot, _, batches = self._state()
        return self._sum(snapshot, batches)

    def _sum(self, snapshot: str | None, batches: list[str]) -> DataFrame:
        places = [f"{self.path}/batches/{n}" for n in batches] + ([f"{self.path}/totals/{snapshot}"] if snapshot else [])
        deltas = self.spark.read.schema(SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], SCHEMA)
        out = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Folds what is committed into one snapshot; folders go only once its marker is there. False where another run was first."""
        number, kept, left, batches = self._state()
        if batches:
            name = f"{number + 1:08d}-{uuid.uuid4().hex[:12]}"
            write(self._sum(kept, batches), f"{self.path}/totals/{name}")
            if not claim(self.spark, f"{self.path}/snapshots/{number + 1:08d}", json.dumps({"totals": name, "folded": left + batches})):
                drop(self.spark, f"{self.path}/totals/{name}")
                return False
        number, kept, left, _ = self._state()
        for done in left:
            drop(self.spark, f"{self.path}/batches/{done}")
        for old in self._names("totals"):
            if int(old.partition("-")[0]) < number:
                drop(self.spark, f"{self.path}/totals/{old}")
        return True


def without_first_line(text: Column) -> Column:
    """A revision rule for the query: the text without its first line; null stays null."""
    return F.regexp_replace(text, r"^[^\n]*\n?", "")


def _tallies(path: str):
    """Adds the BPE counts of the text and, where it is revised, of the rest below its first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            n, revised = [], []
            for x, low in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                text = x.as_py() or ""
                n.append(len(encode(text)) if text else 0)
                rest = text.partition("\n")[2] if low else ""
                revised.append(len(encode(rest)) if rest else 0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), pa.array(n, pa.int64()), pa.array(revised, pa.int64())], [*b.schema.names[1:], f"n_{BPE}", f"revised_{BPE}"])

    return run


def replayed_rollup(docs: DataFrame, labels: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A day's changes as four batches, two of them replayed: totals by source, lang and version.

    All documents come in under three versions (words, bytes, ids of the vocabulary at ``tokenizer``);
    those labelled toxic are deleted; the rest of those labelled low in quality are revised, without
    their first line. Texts are read once and counted again only where they are revised; labels meet
    them by broadcast up to ``BROADCAST_MARKS`` marked ids, by a shuffle of both beyond that.
    """
    rollup = Rollup(docs.sparkSession)
    marks = labels.filter("doc_id is not null and (toxic = 1 or quality = 0)").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marks = saved(marks.select("id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"), F.coalesce(F.col("quality") == 0, F.lit(False)).alias("low")), "rollup-marks")
    few = marks.count() <= BROADCAST_MARKS
    text, low = F.col("text"), F.coalesce(F.col("low") & ~F.col("toxic"), F.lit(False))
    rows = docs.select("doc_id", "source", "lang", "text").join(marks.hint("broadcast" if few else "merge"), F.col("doc_id") == F.col("id"), "left")
    shorter = F.when(low, without_first_line(text))
    own = [c for v, f in COUNTERS.items() for c in (f(text).alias(f"n_{v}"), f(shorter).alias(f"revised_{v}"))]
    rows = rows.select("text", low.alias("low"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "source", "lang", *own)
    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:]) + f", `n_{BPE}` long, `revised_{BPE}` long"
    tallied = rows.mapInArrow(_tallies(tokenizer or default_tokenizer()), types)
    forms = F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"`n_{v}`").alias("n_tokens"), F.col(f"`revised_{v}`").alias("revised")) for v in (*COUNTERS, BPE)])
    counts = saved(tallied.select("source", "lang", "low", "toxic", F.explode(forms).alias("f")).select("source", "lang", "low", "toxic", "f.*"), "rollup-counts")
    load, toxic, revised = inserts(counts.select(*KEYS, "n_tokens")), counts.filter("toxic").select(*KEYS, "n_tokens"), counts.filter("low")
    rollup.commit("0001-load", load)
    rollup.commit("0002-toxic", deletes(toxic))
    rollup.commit("0002-toxic", deletes(toxic))
    rollup.compact()
    rollup.commit("0001-load", load)
    rollup.commit("0003-revised", revisions(revised.select(*KEYS, "n_tokens"), revised.select(*KEYS, F.col("revised").alias("n_tokens"))))
    return rollup.totals()

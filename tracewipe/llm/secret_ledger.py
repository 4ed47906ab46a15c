"""Secret scans over an incremental ledger of blobs.

A version of a file is a row (path, content). Its content is addressed by SHA-256; the ledger keeps, for
each blob, the rule versions it was scanned with and what they found. An update

1. digests every version, natively, and keeps (path, blob);
2. finds the (blob, rule version) pairs that no committed update holds;
3. scans each unseen blob once, in one of its versions, with just the rules it lacks;
4. commits the rows by a marker that is created exclusively, so a retried update adds nothing twice.

Findings are then joined back to all paths of a blob. A changed rule gets a new version, and only its
pairs are scanned again; moved, copied and reverted files cost a digest.

Texts are shuffled only to drop versions whose blob is scanned elsewhere: by broadcast of the versions to
scan up to ``BROADCAST`` of them, by a merge join on (path, blob) beyond that, from which versions of blobs
with a large share of all rows are taken out beforehand. No text is grouped.

Defined results: a null content is an empty text; it has a blob like any other. Rows with a null path
take part; repeated rows give repeated rows. Base rules find leftmost, non-overlapping matches, and a
match whose secret is too short is dropped but still passes over its characters. Positions are code
points, ends exclusive; rows that repeat a path and a blob are scanned alike. Whole texts are scanned, however long; an empty table gives no rows. Extra columns
of ``versions`` are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, join_spread, saved, scratch_path
from .markers import claim, drop, names, read_marker

BROADCAST = 10_000


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts, and the fewest characters of it; ``words``: a text has one of them, in some case, or no match."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    words: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def finder(self):
        found = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)).finditer
        return lambda text: [m.span() for m in found(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: Fixed values of the base rules.
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, ("password", "passwd", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, words=("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24),  # a shorter run has no match of its own and ends before the next
)
#: Public shapes of other secrets: private key headers, prefixed tokens, signed web tokens.
ADDED = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 27, words=("private key",)),
    Rule("github", 1, r"gh[opsur]_[A-Za-z0-9]+", 40, words=("gh",)),
    Rule("slack", 1, r"xox[abeprs]-[A-Za-z0-9-]+", 16, words=("xox",)),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]+", 39, words=("aiza",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, words=("eyj",)),
)

SPANS = "array<struct<start: int, end: int, rule: string>>"
LEDGER = f"blob string, rules array<string>, found {SPANS}"


def blob(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def spans_of(text: str, rules: Sequence[Rule], finders) -> list[tuple[int, int, str]]:
    """(start, end, rule name) of all matches, by start, then in the order of the rules."""
    low, found = text.lower(), []
    for order, (rule, find) in enumerate(zip(rules, finders, strict=True)):
        if not rule.words or any(w in low for w in rule.words):
            found += [(start, order, end, rule.name) for start, end in find(text)]
    return [(start, end, name) for start, _, end, name in sorted(found)]


def _scanner(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {r.name: r.finder() for r in rules}
        for b in batches:
            found = []
            for text, lacks in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                mine = [r for r in rules if r.name in lacks]
                found.append([{"start": s, "end": e, "rule": n} for s, e, n in spans_of(text.as_py() or "", mine, [finders[r.name] for r in mine])])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, kind)], ["blob", "rules", "found"])

    return run


class Ledger:
    """Committed scans below one folder: ``scans/<update>~<attempt>`` holds rows, ``commits/<update>`` names the folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "ledger")

    def entries(self) -> DataFrame:
        """(blob, rules, found) of all committed updates; a blob has one row for each update that scanned it."""
        folders = [read_marker(self.spark, f"{self.path}/commits/{n}") for n in names(self.spark, f"{self.path}/commits")]
        folders = [f"{self.path}/scans/{f}" for f in folders if f]
        return self.spark.read.schema(LEDGER).parquet(*folders) if folders else self.spark.createDataFrame([], LEDGER)

    def unseen(self, versions: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """(blob, path, copies, lacks): each blob of (path, blob) that lacks a rule version, the path to scan it at, its rows."""
        wanted = F.array(*[F.lit(r.name) for r in rules])
        blobs = versions.groupBy("blob").agg(F.min("path").alias("path"), F.count("*").alias("copies"))
        known = self.entries().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))  # one short list for each update that scanned the blob
        lacks = F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))
        return blobs.join(known, "blob", "left").select("blob", "path", "copies", lacks.alias("lacks")).filter(F.size("lacks") > 0)

    def update(self, update_id: str, versions: DataFrame, rules: Sequence[Rule], path: str = "path", content: str = "content") -> DataFrame:
        """Scans what is unseen and commits it; (path, blob) of every version.

        An update that was committed before scans nothing.
        """
        marker = f"{self.path}/commits/{update_id}"
        texts = versions.select(versions[path].alias("path"), blob(versions[content]).alias("blob"), versions[content].alias("text"))
        digests = saved(texts.select("path", "blob"), "ledger-digests")
        if read_marker(self.spark, marker):
            return digests
        todo = saved(self.unseen(digests, rules), "ledger-unseen")
        n = todo.count()
        if n:
            name = f"{update_id}~{uuid.uuid4().hex[:12]}"
            chosen = self._chosen(texts, todo, n, digests.count())
            chosen.mapInArrow(_scanner(rules), LEDGER).write.parquet(f"{self.path}/scans/{name}")
            if not claim(self.spark, marker, name):
                drop(self.spark, f"{self.path}/scans/{name}")
                raise RuntimeError(f"another writer has committed update {update_id!r}")
        return digests

    @staticmethod
    def _chosen(texts: DataFrame, todo: DataFrame, n: int, total: int) -> DataFrame:
        """(blob, text, lacks): of the versions of each unseen blob those at its chosen path."""
        same = (F.col("t.blob") == F.col("u.blob")) & F.col("t.path").eqNullSafe(F.col("u.path"))
        if n > BROADCAST:
            # copies of a blob with a large share of the rows stay where they are; fewer than HOT blobs have one
            hot = F.broadcast(todo.filter(F.col("copies") * HOT > total).select(F.col("blob").alias("of"), F.col("path").alias("at")))
            texts = texts.join(hot, (F.col("blob") == F.col("of")) & ~F.col("path").eqNullSafe(F.col("at")), "left_anti")
        out = texts.alias("t").join(todo.alias("u").hint("broadcast" if n <= BROADCAST else "merge"), same)
        return out.select("t.blob", "t.text", "u.lacks")

    def findings(self, digests: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """(path, blob, found) for every version: the spans of ``rules`` in its blob, sorted."""
        names = [r.name for r in rules]
        mine = F.filter("found", lambda x: x["rule"].isin(names))
        spans = self.entries().select("blob", mine.alias("found")).filter(F.size("found") > 0)
        # repeated rows of the chosen version scan alike
        spans = spans.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
        counts = digests.groupBy("blob").agg(F.count("*").alias("rows"))
        by_blob = counts.join(spans, "blob", "left").select("blob", "rows", F.coalesce("found", F.array().cast(SPANS)).alias("found"))
        return join_spread(digests, by_blob, ["blob"], "rows", digests.count())


def _joined(found: Column, rules: Sequence[Rule]) -> Column:
    """kind:start:end of the spans by start, then in the order of ``rules``, joined by commas."""
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    rows = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.element_at(order, x["rule"]).alias("k"), x["end"].alias("end"), F.element_at(kind, x["rule"]).alias("kind")))
    return F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document, as the first update of a new ledger."""
    ledger, rules = Ledger(docs.sparkSession), (*BASE, *ADDED)
    digests = ledger.update("0001-documents", docs, rules, "doc_id", "text")
    base = [r.name for r in BASE]
    count = lambda rule: F.size(F.filter("found", lambda x: x["rule"] == rule.name)).cast("long").alias(f"n_{rule.kind}")
    own = _joined(F.filter("found", lambda x: x["rule"].isin(base)), BASE)
    return ledger.findings(digests, rules).select(F.col("path").alias("doc_id"), *map(count, BASE), F.sha2(own, 256).alias("base_sha256"), _joined(F.col("found"), rules).alias("spans"))


ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
rules(ord, kind, re, least, grp) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6, 2),
  (1, 'access', 'AKIA[A-Z0-9]+', 20, 0), (2, 'hex', '[0-9a-f]+', 24, 0),
  (3, 'pem', '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----', 27, 0), (4, 'github', 'gh[opsur]_[A-Za-z0-9]+', 40, 0),
  (5, 'slack', 'xox[abeprs]-[A-Za-z0-9-]+', 16, 0), (6, 'google', 'AIza[A-Za-z0-9_-]+', 39, 0),
  (7, 'jwt', 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', 40, 0)),
pieces AS (
  SELECT k, ord, kind, least, grp, re, unnest(string_split_regex(text, re)) AS gap, unnest(list_append(regexp_extract_all(text, re), NULL)) AS hit,
         generate_subscripts(list_append(regexp_extract_all(text, re), NULL), 1) AS i
  FROM texts, rules),
laid AS (
  SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY k, ord ORDER BY i) - coalesce(length(hit), 0) AS start FROM pieces),
hits AS (
  SELECT k, ord, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(hit) AS BIGINT) AS span
  FROM laid WHERE hit IS NOT NULL AND length(CASE WHEN grp = 2 THEN regexp_extract(hit, re, 2) ELSE hit END) >= least),
sums AS (
  SELECT k, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans
  FROM hits GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN sums USING (k)
"""

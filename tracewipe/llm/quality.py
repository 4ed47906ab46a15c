"""Quality classifier: a sparse ensemble of rules over text statistics.

1. One map pass reduces each whole text to a few statistics (numpy over its bytes and word hashes).
2. On a bounded sample of labelled documents (``SAMPLE`` at most, by a hash of the id) small trees
   are boosted for the logistic loss; each path from a root to a node is a conjunctive rule.
3. Lasso logistic regression weighs the rules; most weights are exactly 0 and go.
4. The rules that stay are compiled into one Spark column expression, evaluated in generated code.

Defined results: null and empty texts have all statistics 0 and are scored like any other; without
labelled rows, or with one class only, every score is the (smoothed) share of label 1. Of several
labels of one id the smallest counts. Null ids hash like the text ``null`` and have no label.
Repeated rows score alike. Very long texts are measured whole. An empty table
gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import whole_row
from .language_id import fold
from .textvec import word_hashes

SAMPLE = 8_000
TREES, DEPTH, BINS, RATE, SHARE = 24, 3, 32, 0.3, 0.6
PENALTY = 0.002
STEPS = 250
CUT = 0.3
SEED = 7

STATISTICS = (
    "words", "word_length", "distinct", "repeats", "top_word", "upper", "symbols", "marks", "bars", "digits", "ends", "lines", "line_words",
)

_CLASS = np.zeros(256, np.uint8)  # 1 capital, 2 symbol, 3 exclamation or question mark, 4 bar, 5 digit, 6 full stop or comma, 7 line end
_CLASS[65:91] = 1
for _k, _chars in ((2, b"#$%&*@^~=<>_\\{}[]"), (3, b"!?"), (4, b"|"), (5, b"0123456789"), (6, b".,;:"), (7, b"\n")):
    _CLASS[list(_chars)] = _k


def statistics(text: bytes) -> list[float]:
    """The values of ``STATISTICS`` for a whole text in UTF-8."""
    b = np.frombuffer(text, np.uint8)
    w = word_hashes(text)
    if not len(w):
        return [0.0] * len(STATISTICS)
    seen = np.zeros(8, np.int64)
    capitals = spaces = follow = 0
    for at in range(0, len(b), 1 << 20):
        c = b[at : at + (1 << 20)]
        seen += np.bincount(_CLASS[c], minlength=8)
        spaces += int(((c == 32) | ((c >= 9) & (c <= 13))).sum())
        follow += int(((c & 0xC0) == 0x80).sum())
        capitals += int(((c[:-1] == 0xC3) & (c[1:] >= 0x80) & (c[1:] <= 0x9E)).sum())
    n, chars = len(w), max(1, len(b) - spaces - follow)
    _, counts = np.unique(w, return_counts=True)
    lines = int(seen[7]) + 1
    return [
        float(n), chars / n, len(counts) / n, float((w[1:] == w[:-1]).sum()) / n, float(counts.max()) / n, (seen[1] + capitals) / chars, seen[2] / chars,
        seen[3] / n, seen[4] / n, seen[5] / chars, seen[6] / n, float(lines), n / lines,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t.encode("utf-8", "surrogatepass")) if (t := x.as_py()) else [0.0] * len(STATISTICS) for x in b.column(1)]
        stats = [pa.array(c, pa.float64()) for c in np.array(rows, float).reshape(-1, len(STATISTICS)).T]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(2, b.num_columns)), *stats], [*b.schema.names[2:], *(f"_stat_{s}" for s in STATISTICS)])


def measured(docs: DataFrame, **keep: Column) -> DataFrame:
    """The ``keep`` columns of each document and its statistics, as ``_stat_`` columns."""
    kept = docs.select(F.lit(0).alias("_"), F.col("text").alias("_text"), *[c.alias(n) for n, c in keep.items()])
    return kept.mapInArrow(_measure, StructType([*kept.schema.fields[2:], *(StructField(f"_stat_{s}", DoubleType()) for s in STATISTICS)]))


# --- trees, rules and weights ------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold) each


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, depth: int, out: list[Rule], value: np.ndarray) -> None:
    g, h = grad[rows].sum(), hess[rows].sum()
    value[rows] = g / (h + 1.0)
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 20:
        return
    best, split = 1e-6, None
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        at = np.searchsorted(edges, x[rows, f], side="left")  # number of edges below the value
        gl = np.cumsum(np.bincount(at, grad[rows], len(edges) + 1))[:-1]
        hl = np.cumsum(np.bincount(at, hess[rows], len(edges) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, split = float(gain[k]), (f, float(edges[k]))
    if split:
        f, edge = split
        above = x[rows, f] > edge
        for side in (False, True):
            part = rows[above == side]
            if len(part):
                _grow(x, cuts, grad, hess, part, (*path, (f, side, edge)), depth - 1, out, value)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    return reduce(and_, ((x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in rule))


def boosted_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    rng = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < SHARE)
        if not len(rows):
            rows = np.arange(len(y))
        found: list[Rule] = []
        value = np.zeros(len(y))
        _grow(x, cuts, y - p, p * (1 - p), rows, (), DEPTH, found, value)
        # rows outside the sample take the value of the last rule that holds for them
        for rule in found:
            hold = _holds(x, rule)
            inside = rows[hold[rows]]
            if len(inside):
                value[hold] = (y - p)[inside].sum() / ((p * (1 - p))[inside].sum() + 1.0)
        score = score + RATE * value
        rules += found
    return list(dict.fromkeys(rules))


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is free."""
    n, k = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    step = 4 * n / np.linalg.norm(a, 2) ** 2
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ z)))
        new = z - step * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


@dataclass
class Model:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        """The probability of label 1 over ``_stat_`` columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            terms = [(F.col(f"_stat_{STATISTICS[f]}") > t) if above else (F.col(f"_stat_{STATISTICS[f]}") <= t) for f, above, t in rule]
            total = total + F.when(reduce(and_, terms), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[f]} {'>' if above else '<='} {t:.4g}" for f, above, t in r) for r, w in self.rules]


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(p / (1 - p))), [])
    rules = boosted_rules(x, y)
    holds = np.stack([_holds(x, r) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    share = holds.mean(axis=0)
    keep = np.flatnonzero((share > 0.002) & (share < 0.998))
    if not len(keep):
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(p / (1 - p))), [])
    intercept, w = lasso_logistic(holds[:, keep], y)
    return Model(intercept, [(rules[k], float(v)) for k, v in zip(keep, w, strict=True) if v != 0])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from labelled documents that are not held out; ``sample`` of them by hash at most."""
    known = labels.filter("doc_id is not null and quality is not null").filter(fold(F.col("doc_id"), 5) != 0)
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    got = measured(rows, doc_id=F.col("doc_id"), quality=F.col("quality")).orderBy("doc_id").limit(2 * sample).toPandas()
    x = got[[f"_stat_{s}" for s in STATISTICS]].to_numpy(float)
    return fit_arrays(x, (got["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Model, **keep: Column) -> DataFrame:
    """The ``keep`` columns of each document and ``_score``, the probability of label 1."""
    return measured(docs, **keep).select(*keep, model.score().alias("_score"))


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    out = score(docs, learn(docs, labels), doc_id=F.col("doc_id"))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score at least ``CUT``, with their columns."""
    out = score(docs, learn(docs, labels), row=whole_row(docs))
    return out.filter(F.col("_score") >= CUT).select("row.*")

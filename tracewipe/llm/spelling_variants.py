"""Spelling variants: words at distance one, by a trie self-join with active-node sets.

Words are runs of letters with their counts. Two words at distance one agree before the place of the
edit and after it. For pairs whose shorter word has L letters the place is one of 0 to L; the interval
of places is halved, and a word goes to the group of its first half (edits in the second) and to that of
its last half (edits in the first). Groups of more than ``MOST`` words have their interval halved again,
so that their keys grow at both ends, until a single place is left, where the alphabet bounds them: a
prefix, or prefix and suffix, that a third of all words share is split like any other, and no group is
capped.

Within a group the words form a trie. A node's active nodes are those one edit away; they are born at
places of the group's interval (a sibling: replaced letter; a child: inserted letter) and handed down
along equal labels, level by level, over all tries of a chunk at once. Pairs of active nodes that both
end a word are emitted. A pair is born only where its words first differ, so each pair comes out once.

Each word then takes as its form the near word of largest count, where that is ``RATIO`` times its own
or more; counts grow by that factor along a chain of forms, so chains end after a few steps.

Defined results: null texts have no words; a null id counts as the text ``null``; repeated rows count
again; an empty table gives an empty table. Letters are those up to U+00FF, and only A-Z is lowered.
Runs are read whole, however long. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, remove, saved

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
TYPO = 199  # a run loses a letter where this divides its hash
MOST = 20_000  # words of a group
MOST_LETTERS = 1 << 20  # letters of a group
CHUNK = 50_000  # words whose tries are built at once
HELD = 200_000  # distinct words a task counts before it hands them on
BROADCAST = 1_000_000

#: Letters A-Z a-z and U+00C0 to U+00FF keep their byte in Latin-1, A-Z lowered; all else becomes a space.
_LETTERS = bytes(c if c >= 0xC0 or (c < 0x80 and chr(c).isalpha()) else 0x20 for c in range(256)).lower()


def _counted(least: int, typo: int):
    def flushed(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                runs = Counter((text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split())
                seed = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                for word, n in runs.items():
                    if len(word) < least:
                        continue
                    h = zlib.crc32(word.decode("latin-1").encode(), seed)
                    if h % typo == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield flushed(held)
                    held.clear()
        yield flushed(held)

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n): words of ``least_letters`` letters that occur ``least_count`` times, summed in tasks before the shuffle."""
    counts = docs.select(docs["doc_id"], docs["text"]).mapInArrow(_counted(least_letters, typo), "word string, n long")
    return saved(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count), "spelling-words")


def _halves(short: Column, low: Column, high: Column) -> Column:
    """The two halves of the interval [low, high) as structs."""
    mid = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(short.alias("short"), low.alias("low"), mid.alias("high")), F.struct(short.alias("short"), mid.alias("low"), high.alias("high")))


def _keyed(rows: DataFrame) -> DataFrame:
    """(word, n, short, low, high, key): the key holds all that a pair with its edit in [low, high) has in common."""
    rows = rows.select("word", "n", "i.short", "i.low", "i.high")
    tail = F.greatest(F.col("short") - F.col("high"), F.lit(0))
    suffix = F.when(tail > 0, F.substring(F.col("word"), F.length("word") - tail + 1, tail)).otherwise("")
    return rows.withColumn("key", F.concat_ws(":", "short", "low", "high", F.substring(F.col("word"), F.lit(1), F.col("low")), suffix))


def _expanded(group: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``size`` members of each range that starts at ``group``: index of the range, member."""
    which = np.repeat(np.arange(len(group)), size)
    within = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return which, group[which] + within


class _Level:
    """Nodes at one depth of the tries of sorted words: first word, label, parent."""

    def __init__(self, depth: int, letters: np.ndarray, sizes: np.ndarray, shared: np.ndarray, above: _Level | None):
        rows = np.flatnonzero(sizes >= depth)
        # a row opens a node where it shares fewer letters with the last row as deep; rows between are shorter and end the share
        new = shared[rows] < depth
        self.of = np.full(len(sizes), -1, np.int64)
        self.of[rows] = np.cumsum(new) - 1
        self.first = rows[new]
        self.ends = sizes[self.first] == depth
        if above is not None:
            self.parent, self.label = above.of[self.first], letters[self.first, depth - 1].astype(np.int64)
            self.key = self.parent * 256 + self.label
            self.start = np.searchsorted(self.parent, np.arange(len(above.first) + 1))


def _handed_down(n: np.ndarray, m: np.ndarray, below_n: _Level, below_m: _Level, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Active pairs one level down: children of ``n`` and ``m`` with one label, which is not ``other``'s."""
    which, child = _expanded(below_n.start[n], below_n.start[n + 1] - below_n.start[n])
    label = below_n.label[child]
    if other is not None:
        keep = label != other[which]
        which, child, label = which[keep], child[keep], label[keep]
    want = m[which] * 256 + label
    at = np.searchsorted(below_m.key, want)
    hit = at < len(below_m.key)
    hit[hit] = below_m.key[at[hit]] == want[hit]
    return child[hit], at[hit]


def near_pairs(groups: np.ndarray, words: list[bytes], short: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs at distance one, first place of difference in [low, high), within each group.

    Rows are sorted by group and word; words have ``short`` letters or one more, and of a pair the
    shorter (or the first) has ``short``.
    """
    n, width = len(words), short + 1
    letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
    sizes = np.fromiter(map(len, words), np.int64, n)
    differ = letters[1:] != letters[:-1]
    shared = np.concatenate([[-1], np.where(differ.any(1), differ.argmax(1), width)])
    shared[1:][groups[1:] != groups[:-1]] = -1
    none = np.empty(0, np.int64)
    s_n, s_m, i_n, i_m = none, none, none, none
    depth, last = int(low.min()), int(high.max())
    here = _Level(depth, letters, sizes, shared, None)
    below = _Level(depth + 1, letters, sizes, shared, here)
    out = []
    while True:
        if depth == short:
            keep = here.ends[s_n] & here.ends[s_m]
            out += [(here.first[s_n[keep]], here.first[s_m[keep]])]
            keep = here.ends[i_n]
            out += [(here.first[i_n[keep]], below.first[i_m[keep]])]
            ended = here.ends[below.parent] & (high[here.first[below.parent]] > short)  # a letter more at the end
            out += [(here.first[below.parent[ended]], below.first[ended])]
            break
        under = _Level(depth + 2, letters, sizes, shared, below) if depth + 2 <= width else None
        s_n, s_m = _handed_down(s_n, s_m, below, below)
        i_n, i_m = _handed_down(i_n, i_m, below, under)
        if depth < last:
            open_ = (low[here.first] <= depth) & (depth < high[here.first])
            child = np.flatnonzero(open_[below.parent])
            a, b = _expanded(child + 1, below.start[below.parent[child] + 1] - child - 1)
            s_n, s_m = np.concatenate([s_n, child[a]]), np.concatenate([s_m, b])
            born_n, born_m = _handed_down(below.parent[child], child, below, under, below.label[child])
            i_n, i_m = np.concatenate([i_n, born_n]), np.concatenate([i_m, born_m])
        elif not len(s_n) and not len(i_n):
            break
        here, below, depth = below, under, depth + 1
    a, b = (np.concatenate([p[k] for p in out] or [none]) for k in (0, 1))
    return a, b


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, both ways, of whole groups; rows come sorted by length class, key and word."""

    def settled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        keys = rows.column("key").to_numpy(zero_copy_only=False)
        group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
        many = np.bincount(group)[group] > 1
        words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
        n, short, low, high = (rows.column(c).to_numpy() for c in ("n", "short", "low", "high"))
        for size in np.unique(short[many]):
            at = np.flatnonzero(many & (short == size))
            a, b = near_pairs(group[at], [words[i] for i in at], int(size), low[at], high[at])
            a, b = at[a], at[b]
            word, near = np.concatenate([a, b]), np.concatenate([b, a])
            text = rows.column("word")
            yield pa.RecordBatch.from_arrays([text.take(word).combine_chunks(), text.take(near).combine_chunks(), pa.array(n[near])], ["word", "near", "near_n"])

    held: list[pa.Table] = []
    size = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        size += b.num_rows
        if size >= CHUNK:
            rows = pa.concat_tables(held)
            last = rows.column("key")[-1].as_py()
            keys = rows.column("key").to_pylist()
            cut = len(keys)
            while cut and keys[cut - 1] == last:
                cut -= 1
            if cut:
                yield from settled(rows.slice(0, cut))
            held = [rows.slice(cut)]
            size = len(keys) - cut
    if size:
        yield from settled(pa.concat_tables(held))


def near_words(words: DataFrame, most: int = MOST, most_letters: int = MOST_LETTERS) -> DataFrame:
    """(word, near, near_n) for all pairs of ``words`` (word, n; each word once) at distance one, both ways."""
    classes = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short")
    rows = words.select("word", "n", classes).select("word", "n", F.explode(_halves(F.col("short"), F.lit(0), F.col("short") + 1)).alias("i"))
    parts = None
    while True:
        rows = _keyed(rows)
        sizes = rows.groupBy("key").agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("letters"), F.max(F.col("high") - F.col("low")).alias("width"))
        large = saved(sizes.filter((F.col("width") > 1) & ((F.col("words") > most) | (F.col("letters") > most_letters))).select("key"), "spelling-large")
        n = large.count()
        small = rows.join(large.hint("broadcast" if n <= BROADCAST else "merge"), "key", "left_anti") if n else rows
        parts = small if parts is None else parts.unionByName(small)
        if not n:
            break
        again = rows.join(large.hint("broadcast" if n <= BROADCAST else "merge"), "key", "left_semi")
        rows = saved(again.select("word", "n", F.explode(_halves(F.col("short"), F.col("low"), F.col("high"))).alias("i")), "spelling-again")
    dealt = parts.select("key", "word", "n", "short", "low", "high").repartition("key").sortWithinPartitions("short", "key", "word")
    return dealt.mapInArrow(_joined, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``forms`` (word, form)."""
    links = saved(forms, "spelling-forms")
    at = links.select("word", F.col("form").alias("root"))
    every, step, left = at.withColumn("step", F.lit(0)), 0, links.count()
    while left:
        step += 1
        ends = at.groupBy("root").agg(F.count("*").alias("rows")).join(links.select(F.col("word").alias("root"), F.col("form").alias("next")), "root")
        at = saved(join_spread(at, ends, ["root"], "rows", left).select("word", F.col("next").alias("root")), "spelling-roots")
        left = at.count()
        every = every.unionByName(at.withColumn("step", F.lit(step)))
    return every.groupBy("word").agg(F.max_by("root", "step").alias("root"))


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the vocabulary."""
    words = vocabulary(docs)
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("most"), "near")).alias("best"))
    rows = words.join(near, "word", "left")
    good = -F.col("best.most") >= F.col("n") * ratio
    rows = saved(rows.select("word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, -F.col("best.most")).alias("form_n")), "spelling-near")
    for path in {f.rsplit("/", 1)[0] for f in words.inputFiles()}:
        remove(docs.sparkSession, path)
    roots = _roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, s: xor(a >> 1, 3988292384 * (a & 1))) AS v FROM range(256) t(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents))
  WHERE length(run) >= 6 GROUP BY ALL),
spelt AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS b FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(b) // 2), lambda i: CAST('0x' || substr(b, 2 * i + 1, 2) AS BIGINT))),
         lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]))) AS h
  FROM spelt, tab),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word),
best AS (
  SELECT w.word, w.n, count(near) AS n_near, first(near ORDER BY near_n DESC, near) AS near, first(near_n ORDER BY near_n DESC, near) AS near_n
  FROM words w LEFT JOIN near USING (word) GROUP BY w.word, w.n),
formed AS (SELECT word, n, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM best),
chain AS (
  SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN roots USING (word)
"""

"""Similarity self-join of documents on their sets of word n-grams, by vertical partitioning.

1. Every distinct n-gram set is a *class*; copies share it, so they are one row of all later work. Texts
   are hashed once. Map tasks pack their classes' n-grams into one binary row for each of many parts of
   the hash space; reducers stream part after part, drop n-grams of one class (they overlap with nothing)
   and send the others back to their classes with their document frequency.
2. The global order of n-grams is (document frequency, hash). It is cut into ``FRAGMENTS`` ranges at
   fixed frequencies, the lowest ones again by hash: each class is a row of segments, one per fragment.
3. Classes that reach the threshold share an n-gram among their first ``n - need(n) + 1`` in that order,
   so pairs are born in the low fragments. An n-gram of at most ``SMALL`` classes gives its pairs as rows
   (a class is in at most ``SMALL - 1`` of them per n-gram). The partial overlap of each pair is counted
   fragment by fragment, each a join of its own on (class, fragment), and the counts are summed per pair.
   Each class is counted against its leader first, the smallest it meets: pairs of classes that turn out
   linked with one leader are connected and need no count, so m near copies cost m counts.
4. Classes that meet in n-grams of more than ``SMALL`` classes form *families*, parted by size: sizes in a
   ratio below the threshold cannot link. A family is compared in blocks within tasks, fragment by
   fragment with the partial overlaps summed for all pairs of the block; tasks emit one tie per linked
   class, never pairs. Blocks that turn out to be linked go on as one class each to the next round, so
   a group of m near copies costs about m * ``BLOCK`` overlaps. Only components of a family that stay
   apart are then compared across, all with all: a family of m classes that do not link costs m² / 2
   overlaps of arithmetic and m² / ``BLOCK`` shuffled rows. No link between components is missed.

N-grams that one flush of a map task sees in ``HOT`` classes or more are heavy: they bypass the
parts, spread by class, and come last in the order, so no reducer gathers them. A reducer holds one
part at a time; parts are as many as keep one at some ``PART_BYTES`` of text, whatever the size of all.
Beyond ``MOST_ROWS`` parts a flush is packed by groups of parts, and a second shuffle deals each group's
n-grams to its parts, so that rows stay large.

What "equal" means: classes are told by 128 bits of their sets (a clash of the first 64 is found by the
others, and all begins again with another salt); n-grams by 48 bits of their hash beside the number of
their part (by all 64 beyond 65 536 parts), so a false overlap needs a collision within one part of one
pair of documents.

Defined results: null or wordless text has an empty set, links with nothing and is its own component
(``n_shingles`` 0). Fewer words than the width: the whole sequence is one n-gram. Repeated rows are
copies of each other. A null id stays in its row; ``component_id`` is then the smallest non-null id
of the component, or null. Very long texts are hashed in parts. Extra columns are ignored, whatever
their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_spread, saved, shuffle_partitions, whole_row
from .components import connected_components
from .textvec import mix, set_digests, shingle_set

WIDTH = 5
NUM, DEN = 80, 100
FLUSH = 1_000_000
HOT = 256
SMALL = 16
BLOCK = 512
COLUMNS = 4096
PART_BYTES = 64 << 20
MOST_ROWS = 1 << 15  # that a flush is packed into; more parts are dealt in two steps
BROADCAST_CLASSES = BROADCAST_ROWS = 2_000_000
#: Upper ends of the frequency ranges of the fragments; n-grams of two and of three classes are cut by hash too.
FREQUENCIES = (2, 3, 4, 8, 16, 64, 2**31 - 2, 2**31 - 1)
BY_HASH = {2: 4, 3: 2}
FRAGMENTS = len(FREQUENCIES) + sum(k - 1 for k in BY_HASH.values())
_HEAVY_FREQ = np.int32(2**31 - 1)
_FIRST = np.cumsum([0] + [BY_HASH.get(f, 1) for f in FREQUENCIES])[:-1]
_RANGES = np.array([BY_HASH.get(f, 1) for f in FREQUENCIES])


def _bits(parts: int) -> np.uint64:
    """The bits of a hash that its part takes the place of."""
    return np.uint64(max(16, (parts - 1).bit_length()))


def _part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    return (grams >> (np.uint64(64) - _bits(parts))).astype(np.int64)


def fragment_of(freqs: np.ndarray, grams: np.ndarray, parts: int) -> np.ndarray:
    """The range of the global order (frequency, n-gram) in which each n-gram lies."""
    k = np.searchsorted(FREQUENCIES, freqs)
    place = _part_of(grams, parts) * _RANGES[k] // parts
    return _FIRST[k] + place


def _set_of(text: str | None, width: int) -> np.ndarray:
    return shingle_set(text.encode("utf-8", "surrogatepass"), width) if text else np.array([], np.uint64)


def need(n, num: int = NUM, den: int = DEN):
    """The least overlap that a set of ``n`` can have with one it is similar to."""
    return (num * n + den - 1) // den


def row_key(docs: DataFrame) -> Column:
    """A hash of a document's id and text: rows that repeat both share it."""
    return F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.coalesce(docs["text"], F.lit("")))


# --- sets, and the frequencies of their n-grams ---------------------------------------------------

_PACKED = "part int, kind int, ids binary, sizes binary, counts binary, grams binary, marks binary, target int"
_RARE, _HOT, _MEMBERS = 0, 1, -1  # kinds of rows; members of classes travel beside the n-grams
_PACKED_TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int32()]


def _batch(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in schema.split(", ")])


def _to_bytes(grams: np.ndarray) -> bytes:
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_bytes(raw: bytes, part: int, parts: int) -> np.ndarray:
    """The hashes of one part: what is above its number comes from 6 bytes each."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    above = np.uint64(64) - _bits(parts)
    return (out.reshape(-1).view("<u8") & ((np.uint64(1) << above) - np.uint64(1))) | (np.uint64(part) << above)


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.array([], np.int64)
    return at, np.diff(np.append(at, len(owner)))


def _class_part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _by_part(kind: int, ids: np.ndarray, sizes: np.ndarray, grams: np.ndarray, marks: np.ndarray, parts: int, split: int, reducers: int) -> Iterator[tuple]:
    """N-grams of classes (one entry for each) packed into one row for each ``split`` parts; whole hashes where that is not one."""
    part, marks_part = _part_of(grams, parts) // split, _part_of(marks, parts) // split
    order = np.argsort(part, kind="stable")
    ids, sizes, grams, part = ids[order], sizes[order], grams[order], part[order]
    raw = _to_bytes if split == 1 else np.ndarray.tobytes
    for p in np.union1d(part, marks_part).tolist():
        lo, hi = np.searchsorted(part, [p, p + 1])
        at, n = _runs(ids[lo:hi])
        own = ids[lo:hi][at]
        target = int(own[0] % reducers) if kind == _HOT else p % reducers
        yield p, kind, own.tobytes(), sizes[lo:hi][at].astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), raw(grams[lo:hi]), raw(marks[marks_part == p]), target


def _pack(width: int, parts: int, split: int, reducers: int, salt: int = 0):
    """(doc_id, key, text) rows to n-grams by ``split`` parts of the hash space, and members by part of their class."""

    def grams_of(sets: dict[int, np.ndarray]) -> Iterator[tuple]:
        sizes = np.fromiter((len(s) for s in sets.values()), np.int64, len(sets))
        ids, size, grams = np.repeat(np.fromiter(sets, np.int64, len(sets)), sizes), np.repeat(sizes, sizes), np.concatenate(list(sets.values()))
        bits = _bits(parts)
        below = grams & ((np.uint64(1) << bits) - np.uint64(1))
        grams = (grams >> bits) | (below * np.uint64(parts) >> bits << (np.uint64(64) - bits))
        values, counts = np.unique(grams, return_counts=True)
        heavy = values[counts >= HOT]
        is_heavy = np.isin(grams, heavy) if len(heavy) else np.zeros(len(grams), bool)
        for kind, mask, marks in ((_RARE, ~is_heavy, heavy), (_HOT, is_heavy, heavy[:0])):
            yield from _by_part(kind, ids[mask], size[mask], grams[mask], marks, parts, split, reducers)

    def members_of(rows: list[tuple[int, bool, int, int, int, int]]) -> Iterator[tuple]:
        docs, nulls, keys, sizes, classes, checks = (np.array(c) for c in zip(*rows, strict=True))
        part = np.where(sizes > 0, _class_part(classes, parts), _class_part(keys, parts))
        for p in np.unique(part).tolist():
            mine = part == p
            yield p, _MEMBERS, docs[mine].tobytes(), sizes[mine].tobytes(), nulls[mine].tobytes(), classes[mine].tobytes(), np.concatenate([checks[mine], keys[mine]]).tobytes(), p % reducers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        members: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            return _batch([*(grams_of(sets) if sets else ()), *members_of(members)], _PACKED_TYPES, _PACKED)

        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = _set_of(text.as_py(), width)
                name, check = set_digests(s, salt) if len(s) else (0, 0)
                members.append((0 if doc is None else doc, doc is None, key, len(s), name, check))
                if len(s) and name not in sets:
                    sets[name] = s
                    total += len(s)
                if total >= FLUSH or len(members) >= FLUSH:
                    yield flush()
                    sets, members, total = {}, [], 0
        if members:
            yield flush()

    return run


_BACK = "part int, member boolean, ids binary, sizes binary, counts binary, grams binary, freqs binary, target int"
_BACK_TYPES = [pa.int32(), pa.bool_(), *[pa.binary()] * 5, pa.int32()]


def _by_class(parts: int, split: int, reducers: int, ids, sizes, grams, freqs) -> Iterator[pa.RecordBatch]:
    """The n-grams packed into one row for each ``split`` parts of the classes."""
    part = _class_part(ids, parts) // split
    order = np.lexsort((ids, part))
    ids, sizes, grams, freqs, part = (x[order] for x in (ids, sizes, grams, freqs, part))
    rows = []
    for lo, n in zip(*_runs(part), strict=True):
        hi = lo + n
        at, counts = _runs(ids[lo:hi])
        rows.append((int(part[lo]), False, ids[lo:hi][at].tobytes(), sizes[lo:hi][at].astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), grams[lo:hi].tobytes(), freqs[lo:hi].astype(np.int32).tobytes(), int(part[lo]) % reducers))
    if rows:
        yield _batch(rows, _BACK_TYPES, _BACK)


def _part_by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that share their first column; they come sorted by it."""
    rows: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and rows[0][0] != row[0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _finer(parts: int, split: int, reducers: int):
    """Rows of ``split`` parts of the hash space to rows of one part, ``FLUSH`` n-grams at a time; members as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {_RARE: [], _HOT: []}
        total, now = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            out = []
            for kind, rows in held.items():
                if rows:
                    out += _by_part(kind, *(np.concatenate(x) for x in zip(*rows, strict=True)), parts, 1, reducers)
                    rows.clear()
            if out:
                yield _batch(out, _PACKED_TYPES, _PACKED)

        for b in batches:
            passed = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part, kind, i, s, c, g, m, _ = row
                if kind == _MEMBERS:
                    passed.append(row)
                    continue
                if total >= FLUSH or part != now:
                    yield from flush()
                    total, now = 0, part
                n = np.frombuffer(c, np.int32)
                held[kind].append((np.repeat(np.frombuffer(i, np.int64), n), np.repeat(np.frombuffer(s, np.int32), n), np.frombuffer(g, np.uint64), np.frombuffer(m, np.uint64)))
                total += len(g) // 8
            if passed:
                yield _batch(passed, _PACKED_TYPES, _PACKED)
        yield from flush()

    return run


def _finer_classes(parts: int, reducers: int):
    """Rows of several parts of the classes to rows of one part, ``FLUSH`` n-grams at a time; members as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, now = 0, None
        for b in batches:
            passed = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part, member, i, s, c, g, f, _ = row
                if member:
                    passed.append(row)
                    continue
                if held and (total >= FLUSH or part != now):
                    yield from _by_class(parts, 1, reducers, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, total = [], 0
                now, n = part, np.frombuffer(c, np.int32)
                held.append((np.repeat(np.frombuffer(i, np.int64), n), np.repeat(np.frombuffer(s, np.int32), n), np.frombuffer(g, np.uint64), np.frombuffer(f, np.int32)))
                total += len(g) // 8
            if passed:
                yield _batch(passed, _BACK_TYPES, _BACK)
        if held:
            yield from _by_class(parts, 1, reducers, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _shared(parts: int, split: int, reducers: int):
    """N-grams of two classes or more, with their frequency, for the reducers of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _part_by_part(batches):
            ids, sizes, grams, marks, passed = [], [], [], [], []
            for part, kind, i, s, c, g, m, target in rows:
                if kind == _MEMBERS:
                    passed.append((part, True, i, s, c, g, m, target))
                    continue
                counts = np.frombuffer(c, np.int32)
                i, s, g = np.repeat(np.frombuffer(i, np.int64), counts), np.repeat(np.frombuffer(s, np.int32), counts), _from_bytes(g, part, parts)
                if kind == _HOT:
                    yield from _by_class(parts, split, reducers, i, s, g, np.full(len(g), _HEAVY_FREQ))
                    continue
                ids.append(i), sizes.append(s), grams.append(g), marks.append(_from_bytes(m, part, parts))
            if passed:
                yield _batch(passed, _BACK_TYPES, _BACK)
            if not ids:
                continue
            ids, sizes, grams, heavy = (np.concatenate(x) for x in (ids, sizes, grams, marks))
            order = np.lexsort((ids, grams))
            ids, sizes, grams = ids[order], sizes[order], grams[order]
            first = np.ones(len(ids), bool)
            first[1:] = (grams[1:] != grams[:-1]) | (ids[1:] != ids[:-1])
            ids, sizes, grams = ids[first], sizes[first], grams[first]
            _, n = _runs(grams)
            freq = np.repeat(n, n).astype(np.int32)
            if len(heavy):
                freq[np.isin(grams, heavy)] = _HEAVY_FREQ
            keep = freq > 1
            yield from _by_class(parts, split, reducers, ids[keep], sizes[keep], grams[keep], freq[keep])

    return run


_INDEXED = "doc_id long, key long, n long, class long, check long, size int, lone int, rare array<long>, common array<long>, segments array<array<long>>"
_INDEXED_TYPES = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]


def _index(parts: int, num: int, den: int):
    """Each class's prefix in the global order and its segments by fragment (``size`` set), and the members (``n`` set)."""

    def members(i: bytes, s: bytes, nulls: bytes, g: bytes, f: bytes) -> pa.RecordBatch:
        n = np.frombuffer(s, np.int64)
        checks, keys = np.split(np.frombuffer(f, np.int64), 2)
        empty = n == 0
        cols = [pa.array(np.frombuffer(i, np.int64), mask=np.frombuffer(nulls, bool)), pa.array(keys), pa.array(n), pa.array(np.frombuffer(g, np.int64), mask=empty), pa.array(checks, mask=empty)]
        return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(n), t) for t in _INDEXED_TYPES[5:])], [c.split()[0] for c in _INDEXED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _part_by_part(batches):
            ids, sizes, grams, freqs = [], [], [], []
            for _, member, i, s, c, g, f, _ in rows:
                if member:
                    yield members(i, s, c, g, f)
                    continue
                n = np.frombuffer(c, np.int32)
                ids.append(np.repeat(np.frombuffer(i, np.int64), n)), sizes.append(np.repeat(np.frombuffer(s, np.int32), n))
                grams.append(np.frombuffer(g, np.uint64)), freqs.append(np.frombuffer(f, np.int32))
            if ids:
                yield from indexed(*(np.concatenate(x) for x in (ids, sizes, grams, freqs)))

    def indexed(ids, sizes, grams, freqs) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((grams, freqs, ids))
        ids, sizes, grams, freqs = ids[order], sizes[order], grams[order], freqs[order]
        first = np.ones(len(ids), bool)  # heavy ones come once from each flush that saw the class
        first[1:] = (grams[1:] != grams[:-1]) | (ids[1:] != ids[:-1])
        ids, sizes, grams, freqs = ids[first], sizes[first], grams[first], freqs[first]
        fragment = fragment_of(freqs, grams, parts)
        common, slots = freqs > SMALL, np.arange(1, FRAGMENTS)
        out: list[tuple] = []
        for at, n in zip(*_runs(ids), strict=True):
            size = int(sizes[at])
            lone = size - n
            take = min(n, size - need(size, num, den) + 1 - lone)
            if take <= 0:
                continue
            own = grams[at : at + n].view(np.int64)
            rare = take - int(common[at : at + take].sum())  # the order puts them first
            cuts = np.searchsorted(fragment[at : at + n], slots)
            out.append((None, None, None, int(ids[at]), None, size, lone, own[:rare], own[rare:take], np.split(own, cuts)))
            if len(out) >= 2000:
                yield _batch(out, _INDEXED_TYPES, _INDEXED)
                out = []
        if out:
            yield _batch(out, _INDEXED_TYPES, _INDEXED)

    return run


def indexed_classes(docs: DataFrame, width: int, num: int, den: int, salt: int) -> DataFrame:
    """One table of two kinds of rows: members of classes, and classes with their segments."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"), "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = n * max(1, -(-size // (n * PART_BYTES)))
    split = -(-parts // MOST_ROWS)
    parts = -(-parts // split) * split

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(n, "target").sortWithinPartitions("part")

    packed = dealt(rows.mapInArrow(_pack(width, parts, split, n, salt), _PACKED))
    if split > 1:
        packed = dealt(packed.mapInArrow(_finer(parts, split, n), _PACKED))
    back = dealt(packed.mapInArrow(_shared(parts, split, n), _BACK))
    if split > 1:
        back = dealt(back.mapInArrow(_finer_classes(parts, n), _BACK))
    return saved(back.mapInArrow(_index(parts, num, den), _INDEXED), "ngram-index")


# --- pairs that rare n-grams give ----------------------------------------------------------------


def _born(index: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs: classes that share a rare n-gram of both prefixes, where sizes and places allow the threshold."""
    post = index.select("class", "size", "lone", F.posexplode("rare").alias("i", "gram"))
    post = post.groupBy("gram").agg(F.collect_list(F.struct("class", "size", (F.col("lone") + F.col("i")).alias("place"))).alias("who"))  # SMALL at most
    post = post.filter(F.size("who") > 1).select(F.explode("who").alias("x"), "who").select("x", F.explode(F.filter("who", lambda y: y["class"] > F.col("x")["class"])).alias("y"))
    na, nb, ia, ib = (F.col(f"{s}.{c}") for c in ("size", "place") for s in "xy")
    least = F.ceil((na + nb) * num / (num + den))
    able = (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (F.least(ia, ib) + F.least(na - ia, nb - ib) >= least)
    return post.filter(able).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def _of(classes: DataFrame, index: DataFrame) -> DataFrame:
    """The index rows of ``classes`` (one column, of a saved table): found without a shuffle up to ``BROADCAST_CLASSES``, all rows beyond that."""
    wanted = saved(classes.toDF("class").distinct(), "ngram-wanted")
    return index.join(F.broadcast(wanted), "class", "left_semi") if wanted.count() <= BROADCAST_CLASSES else index


def _verified(pairs: DataFrame, index: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose overlap, counted fragment by fragment and summed, reaches the threshold."""
    index = _of(pairs.select(F.explode(F.array("a", "b"))), index)
    seg = index.select("class", "size", F.posexplode("segments").alias("fragment", "grams")).filter(F.size("grams") > 0)
    left = seg.select(F.col("class").alias("a"), "fragment", F.col("grams").alias("ga"), F.col("size").alias("na"))
    right = seg.select(F.col("class").alias("b"), "fragment", F.col("grams").alias("gb"), F.col("size").alias("nb"))
    split = pairs.select("a", "b", F.explode(F.lit(list(range(FRAGMENTS)))).alias("fragment"))
    part = split.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
    part = part.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("shared"))
    total = part.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.filter(F.col("shared") * den >= (F.col("na") + F.col("nb") - F.col("shared")) * num).select("a", "b")


def _rare_links(index: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) that connect what is similar among the pairs of rare n-grams, leaders first."""
    pairs = saved(_born(index, num, den), "ngram-pairs")
    led = saved(pairs.groupBy("b").agg(F.min("a").alias("leader")), "ngram-led")
    found = saved(_verified(led.select(F.col("leader").alias("a"), "b"), index, num, den), "ngram-leaders")
    linked = found.select(F.col("b").alias("class"), F.col("a").alias("leader"))  # one row a class
    of_a, of_b = linked.select(F.col("class").alias("a"), F.col("leader").alias("la")), linked.select(F.col("class").alias("b"), F.col("leader").alias("lb"))
    rest = pairs.join(led, "b").filter("a <> leader").join(of_a, "a", "left").join(of_b, "b", "left")
    rest = saved(rest.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"), "ngram-rest")
    return found.unionByName(_verified(rest, index, num, den)) if rest.limit(1).count() else found


# --- families that common n-grams make -------------------------------------------------------------


def _overlaps(sets: list[np.ndarray], n: int, overlap: np.ndarray) -> None:
    """Adds the partial overlaps of the pairs i < j within one fragment."""
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    if not len(owner):
        return
    code, k = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    order = np.argsort(code, kind="stable")
    owner, at = owner[order], np.cumsum(k) - k
    for times in range(2, 9):  # n-grams of few sets: their pairs one by one
        few = at[k == times]
        if len(few):
            who = owner[few[:, None] + np.arange(times)]
            i, j = np.triu_indices(times, 1)
            np.add.at(overlap, (who[:, i].ravel(), who[:, j].ravel()), 1)
    many = np.flatnonzero(k > 8)
    for lo in range(0, len(many), COLUMNS):  # the others as dense columns
        part = many[lo : lo + COLUMNS]
        dense = np.zeros((n, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), k[part])
        dense[owner[np.concatenate([np.arange(at[c], at[c] + k[c]) for c in part])], column] = 1
        overlap += np.triu(dense @ dense.T, 1)


def _linked(segments: list[list[np.ndarray]], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set (a list of segments) the first set of the group that it is connected with, itself included."""
    n = len(segments)
    overlap = np.zeros((n, n), np.float32)
    for fragment in range(FRAGMENTS):
        _overlaps([s[fragment] for s in segments], n, overlap)
    overlap = np.rint(overlap + overlap.T).astype(np.int64)
    link = den * overlap >= num * (sizes[:, None] + sizes[None] - overlap)
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        new = np.where(link, label[None], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(num: int, den: int):
    """Rows of one (one, two), the first two columns, come together; (a, b) ties each linked class to the first of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            ids = np.asarray(t.column("class"))
            segments = [[np.asarray(g.values) for g in s.values] for s in t.column("segments")]
            label = _linked(segments, np.asarray(t.column("size")).astype(np.int64), num, den)
            tied = np.flatnonzero(label != np.arange(len(ids)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[label[tied]])], ["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    key, parts = None, []
    for b in batches:
        k = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(2)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo < hi:
                if key is not None and (now := tuple(k[lo])) != key:
                    yield pa.Table.from_batches(parts)
                    parts = []
                key = tuple(k[lo])
                parts.append(b.slice(lo, hi - lo))
    if parts:
        yield pa.Table.from_batches(parts)


def _dealt(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) ties within the groups of (one, two)."""
    rows = rows.select("one", "two", "class", "size", "segments").repartition(shuffle_partitions(rows.sparkSession), "one", "two")
    return saved(rows.sortWithinPartitions("one", "two", "class").mapInArrow(_compare(num, den), "a long, b long"), "ngram-ties")


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(3)), blocks).cast("int")


def _families(index: DataFrame, num: int, den: int) -> DataFrame:
    """(family, class): classes that meet in common n-grams of their prefixes, by band of sizes.

    Classes and n-grams are nodes of one graph, even and odd. Bands are powers of the threshold, so sizes
    that can link are in one band or in neighbours; a family holds two neighbouring bands. One that lacks
    its lower band lies within the next and goes.
    """
    met = connected_components(index.select(F.col("class").alias("a"), F.explode(F.transform("common", lambda g: F.shiftleft(g, 1) + 1)).alias("b")))
    node = met.filter(F.pmod("node", F.lit(2)) == 0).select(F.col("node").alias("class"), "component")
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(den / num)) + 1e-9).cast("int")
    row = node.join(index.select("class", "size"), "class").select("class", "component", band.alias("band"))
    row = row.select("class", "component", "band", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("low"))
    row = saved(row.select("class", "band", "low", F.xxhash64("component", "low").alias("family")), "ngram-families")
    full = row.groupBy("family").agg(F.count("*").alias("n"), F.min("band").alias("band"), F.first("low").alias("low"))
    full = full.filter((F.col("band") == F.col("low")) & (F.col("n") > 1)).select("family", "n")
    return saved(join_spread(row.select("class", "family"), full, ["family"], "n", row.count()), "ngram-families")


def _family_links(index: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) that connect what is similar within the families."""
    segments = index.select("class", "size", "segments")
    member = _families(index, num, den)
    open_, total = member, member.count()
    ties, whole = _none(index), True
    while total:
        size = open_.groupBy("family").agg(F.count("*").alias("n"))
        blocks = size.select("family", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        placed = saved(join_spread(open_, blocks, ["family"], "n", total), "ngram-blocks")
        row = placed.join(_of(placed.select("class"), segments), "class").select(F.col("family").alias("one"), _block(F.col("class"), F.col("blocks")).alias("two"), "class", "size", "segments")
        found = _dealt(row, num, den)
        ties = ties.unionByName(found)
        # a block that is all of its family settles it; of the others each linked group goes on as its first class
        cut = placed.filter("blocks > 1").select("class", "family")
        was = cut.count()
        whole = whole and not was
        open_ = saved(cut.join(found.select(F.col("a").alias("class")).distinct(), "class", "left_anti"), "ngram-open")
        total = open_.count()
        if total * 2 > was:
            break
    return ties if whole else ties.unionByName(_across(member, segments, ties, num, den))


def _none(index: DataFrame) -> DataFrame:
    return index.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)


def _across(member: DataFrame, segments: DataFrame, ties: DataFrame, num: int, den: int) -> DataFrame:
    """Ties between different components of large families: all blocks meet, but those of one component."""
    known = connected_components(ties).select(F.col("node").alias("class"), F.col("component").alias("group"))
    rows = saved(member.join(known, "class", "left").select("family", "class", F.coalesce("group", "class").alias("group")), "ngram-groups")
    n = rows.count()
    groups = rows.groupBy("family", "group").agg(F.count("*").alias("n"))
    whole = groups.groupBy("family").agg(F.sum("n").alias("n"), F.count("*").alias("groups")).filter((F.col("n") > BLOCK) & (F.col("groups") > 1))
    if not whole.limit(1).count():
        return _none(member)
    rows = saved(join_spread(rows, whole.select("family", "n"), ["family"], "n", n), "ngram-groups")
    n = rows.count()
    # groups beyond a block have blocks of their own, the others share some; all are numbered within the family
    sizes = rows.groupBy("family", "group").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > BLOCK)
    small = sizes.filter(F.col("n") <= BLOCK).groupBy("family").agg(F.sum("n").alias("n")).select("family", F.lit(None).cast("long").alias("group"), "n")
    order = Window.partitionBy("family").orderBy(F.col("group").asc_nulls_first())
    own = large.unionByName(small).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = own.withColumn("start", (F.sum("blocks").over(order) - F.col("blocks")).cast("int")).withColumn("all", F.sum("blocks").over(Window.partitionBy("family")).cast("int"))
    own = saved(own, "ngram-own-blocks")
    big = join_spread(rows, own.filter("group is not null"), ["family", "group"], "n", n).select("family", "class", "blocks", "start", "all", F.lit(True).alias("large"))
    rest = rows.join(large.select("family", "group"), ["family", "group"], "left_anti")
    rest = join_spread(rest, own.filter("group is null").drop("group"), ["family"], "n", n).select("family", "class", "blocks", "start", "all", F.lit(False).alias("large"))
    placed = big.unionByName(rest).withColumn("block", F.col("start") + _block(F.col("class"), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda o: ~F.col("large") | (o < F.col("start")) | (o >= F.col("start") + F.col("blocks")))
    placed = saved(placed, "ngram-placed")
    met = placed.withColumn("other", F.explode(others)).withColumn("pair", F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")))
    return _dealt(met.join(_of(placed.select("class"), segments), "class").select(F.col("family").alias("one"), F.col("pair").alias("two"), "class", "size", "segments"), num, den)


# --- components ------------------------------------------------------------------------------------


def class_components(index: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(node, component) of the classes that link with another class."""
    index = index.filter("size is not null")
    links = _rare_links(index, num, den).unionByName(_family_links(index, num, den))
    return connected_components(saved(links, "ngram-links"))


def similar_components(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, key, n_shingles, class, group, component_id) for every document.

    ``group`` is the same for the documents of one component, ``key`` for rows of one id and text.
    """
    for salt in range(4):
        index = indexed_classes(docs, width, num, den, salt)
        members = index.filter("n is not null").select("doc_id", "key", "n", "class", "check")
        own = members.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min("check").alias("low"), F.max("check").alias("high"))
        own = saved(own, "ngram-own")
        if not own.filter("low <> high").limit(1).count():
            break
    else:
        raise RuntimeError("different n-gram sets share their digest under every salt")
    linked = class_components(index, num, den)
    tied = saved(linked.join(own.select("class", "least"), linked["node"] == own["class"]).select("class", "least", "component"), "ngram-tied")
    low = tied.groupBy("component").agg(F.min("least").alias("low"), F.count("*").alias("n"))
    named = join_spread(tied.select("class", "component"), low, ["component"], "n", tied.count())
    least = own.select("class", "least", "copies").join(named, "class", "left").select("class", "copies", F.coalesce("component", "class").alias("group"), F.coalesce("low", "least").alias("component_id"))
    total = own.agg(F.sum("copies")).first()[0] or 0
    out = join_spread(members.filter("class is not null"), saved(least, "ngram-least"), ["class"], "copies", total)
    alone = members.filter("class is null").select("*", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", "key", F.col("n").alias("n_shingles"), "class", "group", "component_id")


def keep_first(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one row of each component: of its smallest id (null last), and there of the smallest text hash.

    Of rows that repeat that id and text one stays, the same on every run. Documents without words stay
    all. Only what goes is looked up: no text is shuffled while that is at most ``BROADCAST_ROWS`` rows.
    """
    found = similar_components(docs.select("doc_id", "text"), width, num, den).filter("group is not null")
    rows = saved(found.groupBy("group", "doc_id", "key").agg(F.count("*").alias("copies")), "ngram-rows")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.count("*").alias("n"))
    rows = join_spread(rows, first, ["group"], "n", rows.count())
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    marked = saved(rows.select("doc_id", "key", stays.alias("stays"), "copies").filter("not stays or copies > 1").select("doc_id", "key", "stays"), "ngram-marked")
    all_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("key"), whole_row(docs).alias("row")).alias("d")
    few = marked.count() <= BROADCAST_ROWS  # texts stay where they are then; beyond that they are shuffled
    met = all_rows.join(marked.hint("broadcast" if few else "merge").alias("m"), (F.col("d.key") == F.col("m.key")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), "left").select("d.*", "m.stays")
    out = met.filter("stays is null").select("row")
    if marked.filter("stays").limit(1).count():
        once = met.filter("stays").groupBy("doc_id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.unionByName(once.select("row"))
    return out.select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) < 5 THEN list_filter([array_to_string(ws, ' ')], lambda g: g <> '')
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 80 * (a.n + b.n - k)),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS a, x AS b FROM steps UNION SELECT r.a, t.y FROM reach r JOIN steps t ON r.b = t.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(reach.b), d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

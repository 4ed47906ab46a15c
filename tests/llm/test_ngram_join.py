import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewipe.llm import ngram_join, textvec
from tracewipe.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), low[root(i)]) for i, r in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    common = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 and rows:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 9, 40, 120]))]
            if kind > 0.8:
                w = common + w
        t = " ".join(w)
        rows.append((i * 3 + 1, t.upper() if rng.random() < 0.1 else t, "en", "s"))
    return rows


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(documents, seed):
    rows = corpus(seed, 160)
    assert got(ngram_join.similar_components(documents(rows))) == brute(rows)


@pytest.mark.parametrize(("hot", "flush", "parts", "split"), [(3, 400, 8, 1), (256, 10**6, 8, 1), (3, 400, 40, 1), (3, 400, 42, 7), (3, 400, 100_000, 1000)])
def test_frequencies_through_the_parts(documents, monkeypatch, hot, flush, parts, split):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    rows = corpus(5, 120)
    texts = [r[1] for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(range(120)), pa.array(texts)], ["doc_id", "key", "text"])

    def dealt(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
        assert all(r["target"] == r["part"] % 4 for r in rows if r.get("kind") != ngram_join._HOT)
        out = pa.RecordBatch.from_pylist(rows)
        return rows, out.set_column(0, "part", out.column(0).cast(pa.int32()))

    rows, packed = dealt(ngram_join._pack(5, parts, split, 4)(iter([batch])))
    assert any(r["kind"] == ngram_join._HOT for r in rows) == (hot == 3)
    if split > 1:
        assert max(r["part"] for r in rows if r["kind"] != ngram_join._MEMBERS) < parts // split
        rows, packed = dealt(ngram_join._finer(parts, split, 4)(iter([packed])))
        assert max(r["part"] for r in rows) > parts // split
    frequency = {}
    for s in {frozenset(shingles(t)) for t in texts}:
        for g in s:
            frequency[g] = frequency.get(g, 0) + 1
    want = {}
    for t in texts:
        want[textvec.set_digests(textvec.shingle_set(t.encode()))[0]] = sum(frequency[g] > 1 for g in shingles(t))
    have, members = {}, 0
    back = dealt(ngram_join._shared(parts, split, 4)(iter([packed])))[1]
    if split > 1:
        back = dealt(ngram_join._finer_classes(parts, 4)(iter([back])))[1]
    for b in [back]:
        for r in b.to_pylist():
            if r["member"]:
                members += len(r["ids"]) // 8
                continue
            assert (ngram_join._class_part(np.frombuffer(r["ids"], np.int64), parts) == r["part"]).all()
            for i, g in zip(np.repeat(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"], np.int32)).tolist(), np.frombuffer(r["grams"], np.uint64).tolist()):
                have.setdefault(i, set()).add(g)
    assert {k: len(v) for k, v in have.items()} == {k: v for k, v in want.items() if v} and members == 120


@pytest.mark.parametrize(("most", "size"), [(3, 4000), (8, 500)])
def test_more_parts_than_a_flush_is_packed_into(documents, monkeypatch, most, size):
    monkeypatch.setattr(ngram_join, "MOST_ROWS", most)
    monkeypatch.setattr(ngram_join, "PART_BYTES", size)
    rows = corpus(3, 160)
    assert got(ngram_join.similar_components(documents(rows))) == brute(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_leaders_and_what_they_leave(documents, seed):
    """Small groups of one origin at all distances around the threshold: some link with the smallest, some only with each other."""
    rng = random.Random(seed)
    rows = []
    for k in range(25):
        base = [f"g{k}x{i}" for i in range(100)]
        for m in range(rng.choice([2, 3, 6, 12])):
            w = list(base)
            for at in rng.sample(range(100), rng.choice([0, 1, 2, 3])):
                w[at] = f"g{k}m{m}a{at}"
            rows.append((len(rows), " ".join(w), None, None))
    rng.shuffle(rows)
    assert got(ngram_join.similar_components(documents(rows))) == brute(rows)


def test_fragments_are_ranges_of_the_global_order():
    rng = np.random.default_rng(1)
    freqs = rng.choice([2, 3, 4, 5, 8, 9, 16, 17, 64, 65, 300, 2**31 - 1], 5000).astype(np.int32)
    grams = rng.integers(0, 2**48, 5000, np.uint64) | (rng.integers(0, 37, 5000, np.uint64) << np.uint64(48))
    f = ngram_join.fragment_of(freqs, grams, 37)
    order = np.lexsort((grams, freqs))
    assert (np.diff(f[order]) >= 0).all() and set(f.tolist()) == set(range(ngram_join.FRAGMENTS))


def families(seed, n):
    """Groups of near copies of several sizes around passages they share, and loners with the passages."""
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(4000)]
    shared = [[rng.choice(vocab) for _ in range(40)] for _ in range(2)]
    rows = []
    for k, size in enumerate((n, n // 2, n // 3)):
        base = [rng.choice(vocab) for _ in range((60, 75, 200)[k])] + shared[k % 2]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(w)
    rows += [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 12, 60]))] + rng.choice(shared) for _ in range(n)]
    rng.shuffle(rows)
    return [(i, " ".join(w), None, None) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("block", "small"), [(512, 16), (16, 4), (5, 2)])
def test_families_in_blocks_lose_no_link(documents, monkeypatch, block, small):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows = families(7, 60)
    assert got(ngram_join.similar_components(documents(rows))) == brute(rows)


def test_families_that_stay_apart_are_compared_across(documents, monkeypatch):
    """Links only between blocks: a chain in which every document is near the next one alone."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    w, rows = [f"c{i}" for i in range(90)], []
    for k in range(40):
        rows.append((k, " ".join(w), None, None))
        w = w[3:] + [f"n{k}a", f"n{k}b", f"n{k}c"]
    assert got(ngram_join.similar_components(documents(rows))) == brute(rows)


def test_clashing_digests_begin_again(documents, monkeypatch):
    real = ngram_join.set_digests
    monkeypatch.setattr(ngram_join, "set_digests", lambda s, salt=0: (2, real(s)[1]) if not salt else real(s, salt))
    index = ngram_join.indexed_classes
    monkeypatch.setattr(ngram_join, "indexed_classes", lambda docs, width, num, den, salt: index(docs, width, num, den, salt))
    own = ngram_join._pack

    def pack(width, parts, split, reducers, salt=0):  # the tasks' functions are pickled with the module, so the clash is made here
        run = own(width, parts, split, reducers, salt)

        def clash(batches):
            for b in run(batches):
                if not salt:
                    rows = b.to_pylist()
                    for r in rows:
                        if r["kind"] == ngram_join._MEMBERS:
                            r["grams"] = np.full(len(r["grams"]) // 8, 2, np.int64).tobytes()
                    b = pa.RecordBatch.from_pylist(rows, b.schema)
                yield b

        return clash

    monkeypatch.setattr(ngram_join, "_pack", pack)
    rows = corpus(11, 60)
    assert got(ngram_join.similar_components(documents(rows))) == brute(rows)


def test_chain_of_near_copies_is_one_component(documents):
    base = [f"t{i}" for i in range(100)]
    rows, w = [], list(base)
    for k in range(12):
        rows.append((100 - k, " ".join(w), None, None))
        w = list(w)
        w[8 * k] = f"new{k}"
    assert got(ngram_join.similar_components(documents(rows))) == brute(rows)


def test_edge_rows(documents):
    rows = [(1, None, None, None), (2, "", None, None), (3, " \t\n", None, None), (4, "one two", None, None), (5, "ONE  two", None, None), (6, "é É", None, None), (7, "é é", None, None), (8, "one two", None, None), (8, "one two", None, None)]
    assert got(ngram_join.similar_components(documents(rows))) == brute(rows)
    assert ngram_join.similar_components(documents([])).count() == 0


def test_null_id_and_extra_columns(documents):
    df = documents([(None, "a b c", None, None), (3, "a b c", None, None), (4, "x", None, None)]).withColumn("class", F.lit("x")).withColumn("component", F.lit(1))
    out = {(r.doc_id, r.component_id) for r in ngram_join.similar_components(df).collect()}
    assert out == {(None, 3), (3, 3), (4, 4)}


def test_keep_first_keeps_one_of_each_group(documents):
    rows = corpus(9, 80)
    kept = {r.doc_id for r in ngram_join.keep_first(documents(rows)).collect()}
    assert kept == {c for _, _, c in brute(rows)}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_keep_first_goes_by_row(documents, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
    monkeypatch.setattr(ngram_join, "BROADCAST_CLASSES", most)
    near = " ".join(f"a{i}" for i in range(40))
    rows = [(3, near + " x", "en", "s"), (7, near + " y", "en", "s"), (7, "quite another text that is alone here", "de", "t"), (3, near + " x", "en", "s"), (3, near + " x", "de", "u")]
    rows += [(None, "no id but one text", "en", "s"), (None, "no id but one text", "en", "s"), (None, "no id, other text", None, None), (5, None, None, None), (5, None, None, None), (6, "", "en", "s")]
    docs = documents(rows)
    for own in ("key", "row", "group", "class", "stays", "component_id", "copies", "a.b"):
        docs = docs.withColumn(own, F.lit("own"))
    out = ngram_join.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted(
        [(3, near + " x"), (7, "quite another text that is alone here"), (0, "no id but one text"), (0, "no id, other text"), (5, ""), (5, ""), (6, "")]
    )
    assert ngram_join.keep_first(docs.limit(0)).count() == 0


def test_long_text_equals_its_chunks(monkeypatch):
    text = ("ab cd efg  h\n" * 5000 + "x" * 3000 + " end").encode()
    whole = textvec.word_hashes(text)
    monkeypatch.setattr(textvec, "CHUNK", 1000)
    assert np.array_equal(textvec.word_hashes(text), whole)


def test_components(sp):
    links = sp.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 6), (6, 5), (None, 3), (3, 1)], "a long, b long")
    assert sorted(map(tuple, connected_components(links).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 4)]
    assert connected_components(links.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1, 8, 10**6])
def test_components_with_hubs(sp, monkeypatch, hot):
    """Stars around small and great nodes, a chain, and hubs joined by broadcast or not."""
    from tracewipe.llm import components

    monkeypatch.setattr(components, "HOT", hot)
    rng = random.Random(3)
    pairs = [(5, 1000 + i) for i in range(60)] + [(5000, 2000 + i) for i in range(60)] + [(i, i + 1) for i in range(3000, 3030)] + [(rng.randrange(10**4, 10**4 + 80), rng.randrange(10**4, 10**4 + 80)) for _ in range(50)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    low = {}
    for x in up:
        low[root(x)] = min(low.get(root(x), x), x)
    want = {(x, low[root(x)]) for p in pairs for x in p if p[0] != p[1]}
    assert {tuple(r) for r in connected_components(sp.createDataFrame(pairs, "a long, b long")).collect()} == want

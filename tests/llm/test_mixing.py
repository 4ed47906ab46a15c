import hashlib
import random
import re
from collections import Counter, defaultdict

from tracewipe.llm import mixing


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    total = defaultdict(int)
    for r, s in zip(rows, size):
        total[r[3]] += s
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            goal[s] = 2.0 * total[s]
            left -= goal[s]
        open_ -= full
    h = [int(hashlib.md5(("null" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16) for r in rows]
    taken = [0] * len(rows)
    for s in names:
        rounds = int(goal[s] // max(total[s], 1))
        budget, run = goal[s] - rounds * total[s], 0
        groups = defaultdict(list)
        for i, r in enumerate(rows):
            if r[3] == s:
                taken[i] = rounds * size[i]
                groups[h[i]].append(i)
        for k in sorted(groups):
            own = sum(size[i] for i in groups[k])
            if budget > 0 and (run + own <= budget or run <= budget and run + own - budget < budget - run):
                for i in groups[k]:
                    taken[i] += size[i]
            run += own
    return Counter((r[0], r[3], size[i], total[r[3]], round(goal[r[3]], 6), taken[i]) for i, r in enumerate(rows))


def corpus(seed, n=300):
    rng = random.Random(seed)
    sources = ["a"] * 8 + ["b", "c", "Z", None, "é"]
    return [(rng.choice([i, i, 7]), rng.choice([None, "", " ".join("x" * rng.randrange(1, 9) for _ in range(rng.choice([1, 5, 50, 400])))]), "en", rng.choice(sources)) for i in range(n)]


def got(df):
    return Counter((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_matches_brute_force(documents):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(mixing.mix(documents(rows))) == brute(rows)


def test_one_source_and_no_words(documents):
    rows = [(1, "a b", None, "s"), (2, "c", None, "s")]
    assert got(mixing.mix(documents(rows))) == brute(rows)
    rows = [(1, None, None, None), (None, "", None, "x")]
    assert all(r.taken == 0 for r in mixing.mix(documents(rows)).collect())
    assert mixing.mix(documents([])).count() == 0


def test_larger_budget_takes_a_superset(documents, sp):
    items = mixing.mix(documents(corpus(3))).select("source", "size", mixing.doc_hash(mixing.F.col("doc_id")).alias("hash"))
    cuts = []
    for part in (0.2, 0.6):
        budgets = items.groupBy("source").agg((mixing.F.sum("size") * part).alias("budget")).filter("budget > 0")
        cuts.append({r.source: r.threshold for r in mixing.thresholds(items, budgets).collect()})
    assert all(cuts[0][s] <= cuts[1][s] for s in cuts[0])


def test_mixed_documents_repeat_what_is_taken(documents):
    rows = [(i, "w " * (i + 1), None, "big" if i % 3 else "small") for i in range(40)]
    docs = documents(rows)
    for own in ("turn", "times", "row", "hash", "rounds", "threshold", "_mix", "_times", "_turn", "size", "target", "a.b"):
        docs = docs.withColumn(own, mixing.F.lit("own"))
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in want.items() if v})

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewipe.llm import spelling_variants as sv


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    forms, out = {}, []
    near_of = {w: [x for x in words if near(w, x)] for w in words}
    for w, close in near_of.items():
        best = min(close, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, words[w], len(near_of[w]), words.get(forms[w])))
    return sorted(out, key=repr)


def got(frame):
    return sorted([tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()], key=repr)


def corpus(seed, size=160):
    r = random.Random(seed)
    stems = ["".join(r.choice("abé×") for _ in range(r.randint(6, 9))) for _ in range(30)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa"]
    rows = []
    for i in range(size):
        words = []
        for _ in range(60):
            w = r.choice(stems)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                at = r.randrange(len(w) + 1)
                w = r.choice([w[:at] + r.choice("abÿZ") + w[at:], w[:at] + w[at + 1 :], w[:at] + r.choice("abé") + w[at + 1 :]])
            words.append(w if r.random() < 0.9 else w.upper())
        rows.append((i, r.choice([" ", ", ", "\n", "ř", "1"]).join(words), "en", "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_plain_python(sp, documents, seed):
    rows = corpus(seed) + [(None, "abcdef " * 9 + "abcdeg " * 50 + "abcxeg " * 300, None, None), (5, None, "en", "s"), (6, "", "en", "s")] + [(7, "zzzzzz zzzzzy", "en", "s")] * 6
    want = plain([r[:2] for r in rows])
    assert got(sv.variants(documents(rows).repartition(5))) == want
    assert len({r[2] for r in want}) < len(want) and any(r[1] and r[2] != r[1] for r in want)


def test_large_groups_are_halved_until_they_fit(sp):
    r = random.Random(3)
    words = {"".join(["pre", *(r.choice("abc") for _ in range(5)), "post"][: r.choice([8, 9, 9])]) for _ in range(600)}
    words |= {"common" + "".join(r.choice("abcd") for _ in range(4)) for _ in range(300)}
    frame = sp.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    want = {(a, b) for a in words for b in words if near(a, b)}
    for most in (2, 40, 20_000):
        rows = [(x.word, x.near) for x in sv.near_words(frame, most=most).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert sv.near_words(frame, most_letters=100).count() == len(want)


def test_tries_of_many_groups_at_once():
    r = random.Random(4)
    words = sorted({(g, "".join(r.choice("ab") for _ in range(r.choice([6, 7])))) for g in range(9) for _ in range(40)})
    groups = np.array([g for g, _ in words])
    low, high = np.zeros(len(words), np.int64), np.full(len(words), 7)
    a, b = sv.near_pairs(groups, [w.encode() for _, w in words], 6, low, high)
    want = {(words[i], words[j]) for i in range(len(words)) for j in range(len(words)) if words[i][0] == words[j][0] and near(words[i][1], words[j][1]) and len(words[i][1]) == 6 and (len(words[j][1]) == 7 or i < j)}
    pairs = [(words[i], words[j]) for i, j in zip(a, b, strict=True)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_long_runs_small_chunks_and_empty_tables(sp, documents, monkeypatch):
    assert got(sv.variants(documents([]))) == []
    monkeypatch.setattr(sv, "CHUNK", 10)
    monkeypatch.setattr(sv, "HELD", 10)
    long = "abcdefghij" * 300
    rows = [(i, f"{long} {long[:1500]}x{long[1500:]} {long[:-1]}" * 1 + " letter letters lettter" * (1 + i % 3), "en", "s") for i in range(40)]
    docs = documents(rows).selectExpr("*", "1 as word", "2 as n", "3 as key", "4 as short")
    assert got(sv.variants(docs)) == plain([r[:2] for r in rows])

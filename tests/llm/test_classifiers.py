import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewipe.llm import language_id, quality

SYLLABLES = {"aa": ["ka", "ro", "mi", "tan"], "bb": ["zu", "ble", "wor", "ich"], "cc": ["é", "ñon", "qua", "sse"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(seed=0, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, text(rng, lang, rng.choice([3, 20, 60])), lang if rng.random() < 0.9 else None, "s"))
    return rows


ODD = [(900, None, "aa", None), (901, "", None, None), (902, "123 !! 45", "bb", "s"), (None, "karomi tanka", None, None), (903, "Zz", None, None)]


def test_languages(documents):
    rows = corpus()
    docs = documents(rows + ODD).withColumn("lang_pred", F.lit("x")).withColumn("known", F.lit(1))
    out = language_id.identify(docs).toPandas()
    assert len(out) == len(rows) + len(ODD) and ((out.score >= 0) & (out.score <= 1)).all()
    by_id = out.dropna(subset=["doc_id"]).set_index("doc_id")
    for i in by_id.index:
        assert by_id.held_out[i] == (zlib.crc32(str(int(i)).encode()) % 4 == 2)
    assert all(by_id.lang_pred[i] == "und" and by_id.score[i] == 0 for i in (900, 901, 902))
    true = [(by_id.lang_pred[i], lang) for i, _, lang, _ in rows if lang and by_id.held_out[i]]
    assert np.mean([a == b for a, b in true]) > 0.95
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.95 * len(rows)


def test_held_out_rows_do_not_teach(documents):
    rows = corpus()
    changed = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in rows]
    a, b = (language_id.learn(documents(r)) for r in (rows, changed))
    assert a.words == b.words and np.array_equal(a.logs, b.logs) and np.array_equal(a.langs, b.langs)


def test_unseen_words_back_off(documents):
    m = language_id.learn(documents(corpus()))
    assert m.languages[int(np.argmax(m.unseen("karotanmikaro")))] == "aa"
    # no language has a Han letter: the n-grams that end in one fall to the floor, the one that ends in a space to the space
    floor, end = m.absent[1] - 3 * language_id.BACKOFF, m.gram(" ") - 3 * language_id.BACKOFF
    assert np.allclose(m.unseen("漢漢漢"), (floor + end) / 2)


def test_each_language_backs_off_for_itself(documents, monkeypatch):
    """One language has the word's 4-grams, the other only ends of them: how much that costs decides the scores."""
    m = language_id.model_of([("aa", 0, "x", 1), ("bb", 0, "x", 1), ("aa", 4, " kat", 9), ("aa", 4, "kato", 9), ("aa", 4, "ato ", 9), *(("bb", 3, g, 9) for g in ("kat", "ato", "to "))])
    shares = []
    for backoff in (0.0, 1.0, 4.0):
        monkeypatch.setattr(language_id, "BACKOFF", backoff)
        m.met.clear()
        aa, bb = m.unseen("kato")
        assert np.isclose(aa, np.log(9.5 / (27 + 1.5))) and np.isclose(bb, np.log(9.5 / (27 + 1.5)) - backoff)
        shares.append(language_id._Scorer(m).score("kato")[1])
    assert shares[0] < shares[1] < shares[2]


def test_scores_against_plain_counting(documents, monkeypatch):
    """The whole of it again over dicts and floats: counts, smoothing, back-off, tempering."""
    monkeypatch.setattr(language_id, "CACHE", 40)
    rows = corpus(3, 120)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[2]]
    counts = {}
    for _, t, lang, _ in train:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            counts.setdefault((0, lang), {}).setdefault(w, 0)
            counts[0, lang][w] += 1
    for (_, lang), c in [x for x in counts.items()]:
        for w, n in c.items():
            for size in range(1, 5):
                for i in range(len(w) + 3 - size):
                    g = counts.setdefault((size, lang), {})
                    g[f" {w} "[i : i + size]] = g.get(f" {w} "[i : i + size], 0) + n
    langs = sorted({lang for _, lang in counts})

    def log(kind, lang, term):
        c = counts[kind, lang]
        types = len(set().union(*(counts[kind, x] for x in langs)))
        return math.log((c.get(term, 0) + 0.5) / (sum(c.values()) + 0.5 * types))

    def word(w, lang):
        if any(w in counts[0, x] for x in langs):
            return log(0, lang, w)
        padded = f" {w} "
        size = min(4, len(padded))

        def gram(g):
            if g in counts[len(g), lang]:
                return log(len(g), lang, g)
            return gram(g[1:]) - language_id.BACKOFF if len(g) > 1 else log(1, lang, g)

        each = [gram(padded[i : i + size]) for i in range(len(padded) - size + 1)]
        return sum(each) / len(each)

    extra = [(700, "Zzyx kato, ROMI½mitan ²", None, None), (701, "½ ² ① Ⅷ ٣ 12", None, None), (702, "一 二", None, None), (703, "karo " * 70 + "zuble", None, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(documents(rows + extra)).collect()}
    assert got[701] == ("und", 0.0)
    for i, t, _, _ in rows + [e for e in extra if e[0] != 701]:
        ws = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        total = {x: sum(word(w, x) for w in ws) * min(len(ws), 50) / len(ws) for x in langs}
        best = max(langs, key=lambda x: total[x])
        assert got[i][0] == best and abs(got[i][1] - 1 / sum(math.exp(v - total[best]) for v in total.values())) < 1e-9


def test_many_languages_share_the_terms(documents):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} common", f"l{i:03d}", "s") for i in range(200)]
    m = language_id.fit(documents(rows), terms=400)
    assert len(m.languages) == 200 and len(m.langs) <= 2 * 400 + 4 * 200


def test_no_training_rows(documents):
    out = language_id.identify(documents([(1, "abc", None, None)])).first()
    assert (out.lang_pred, out.score) == ("und", 0.0)
    assert language_id.identify(documents([])).count() == 0


def test_words_of_long_texts(monkeypatch):
    t = "ab cd, efg1hi " * 1000 + "x" * 5000
    whole = [w for part in language_id.words_of(t) for w in part]
    monkeypatch.setattr(language_id, "PART", 100)
    assert [w for part in language_id.words_of(t) for w in part] == whole


def quality_rows(seed=1, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        t = text(rng, rng.choice(["aa", "bb"]), rng.choice([30, 80]))
        if not good:
            t = rng.choice([t.upper().replace(" ", "!! "), " ".join(["Buy now"] * 30), t.replace(" ", "$$ ")])
        rows.append((i, t, "en", "s"))
        if rng.random() < 0.8:
            labels.append((i, int(good), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality(documents, sp):
    rows, labels = quality_rows()
    odd = [(900, None, None, None), (901, "", None, None), (902, "x" * 3_000_000, None, None), (None, "a b", None, None)]
    docs = documents(rows + odd).withColumn("score", F.lit("own"))
    out = quality.assess(docs, sp.createDataFrame([*labels, (900, None, None), (None, 1, 1)], LABELS)).toPandas()
    assert len(out) == len(rows) + 4 and ((out.score >= 0) & (out.score <= 1)).all()
    by_id = out.dropna(subset=["doc_id"]).set_index("doc_id")
    assert (by_id.predicted == (by_id.score >= 0.3)).all()
    held = [(by_id.predicted[i], q) for i, q, _ in labels if by_id.held_out[i]]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    assert all(by_id.held_out[i] == (zlib.crc32(str(int(i)).encode()) % 5 == 0) for i in by_id.index)


def test_rules_as_columns_equal_rules_in_numpy(documents, sp):
    rows, labels = quality_rows(2)
    docs = documents(rows)
    m = quality.learn(docs, sp.createDataFrame(labels, LABELS))
    assert 0 < len(m.rules) and m.describe()
    got = quality.score(docs, m, doc_id=F.col("doc_id"), text=F.col("text")).toPandas()
    x = np.array([quality.statistics(t.encode()) for t in got.text])
    total = m.intercept + sum(w * quality._holds(x, r) for r, w in m.rules)
    assert np.allclose(got["_score"], 1 / (1 + np.exp(-total)))


def plain_statistics(text):
    """The thirteen statistics, counted character by character."""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not ws:
        return [0.0] * 13
    folded = ["".join(c.lower() if c < "\x80" else c for c in w) for w in ws]
    seen = Counter(folded)
    chars = sum(map(len, ws))
    upper = sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in text)
    n, lines = len(ws), text.count("\n") + 1
    return [
        n, chars / n, len(seen) / n, sum(a == b for a, b in zip(folded, folded[1:])) / n, max(seen.values()) / n, upper / chars, sum(c in "#$%&*@^~=<>_\\{}[]" for c in text) / chars,
        sum(c in "!?" for c in text) / n, text.count("|") / n, sum("0" <= c <= "9" for c in text) / chars, sum(c in ".,;:" for c in text) / n, lines, n / lines,
    ]


def test_statistics_against_a_plain_recount():
    rng = random.Random(3)
    texts = ["", " \n\t ", "x", "A b\nB b b!?", "É Ünï ñ Þ ÿ|a|b", "1.5, 2;3: #$ {x}\r\n\x0b~"]
    texts += ["".join(rng.choice("abAB éÉß漢🙂 1!?|.,#\n\t ") for _ in range(rng.randrange(1, 300))) for _ in range(200)]
    for t in texts:
        assert np.allclose(quality.statistics(t.encode()), plain_statistics(t)), t


def test_columns_named_like_the_operators_own_come_through(documents, sp):
    rows, labels = quality_rows(5, 150)
    docs = documents([(i, t, "en" if i % 2 else "de", s) for i, t, _, s in rows])
    for own in ("_score", "_lang_pred", "_stat_words", "_text", "_", "row", "score", "quality", "id", "n", "a.b"):
        docs = docs.withColumn(own, F.lit("own"))
    kept = language_id.accepted(docs, least=0.0)
    assert kept.columns == docs.columns and kept.count() == 150
    kept = quality.accepted(docs, sp.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns and 50 < kept.count() < 150 and {r["_score"] for r in kept.collect()} == {"own"}


def test_without_labels_or_rows(documents, sp):
    none = sp.createDataFrame([], LABELS)
    assert {r.score for r in quality.assess(documents([(1, "a", None, None), (2, None, None, None)]), none).collect()} == {0.5}
    assert quality.assess(documents([]), none).count() == 0


def test_lasso_is_sparse():
    rng = np.random.default_rng(0)
    r = (rng.random((400, 20)) < 0.5).astype(float)
    y = (r[:, 3] > 0).astype(float)
    b, w = quality.lasso_logistic(r, y, penalty=0.02)
    assert np.argmax(np.abs(w)) == 3 and (w == 0).sum() >= 10

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewipe.llm import license_scan, packing, token_rollup


def test_all_wordings_are_found_as_themselves(documents):
    rows, want = [], set()
    for name, wordings in license_scan.TEMPLATES.items():
        for w in wordings:
            parts = w.split(" ")
            wide = "\n".join(" ".join(parts[i : i + 12]) for i in range(0, len(parts), 12))  # as source files wrap them
            for form in (w, w.upper(), "\n".join(parts[:3]) + "\n" + " ".join(parts[3:]), wide, "\n\n".join(parts), "// " + wide.replace("\n", "\n//   ")):
                rows.append((len(rows), f"Some prose.\n\n{form}\n\nMore prose here.", None, None))
                want.add((rows[-1][0], name))
    out = license_scan.scan(documents(rows)).collect()
    assert {(r.doc_id, r.license) for r in out} == want and len(out) == len(want)
    assert all(r.first_line == 3 and r.words_missing == 0 for r in out)


@pytest.mark.parametrize("part", [1 << 20, 700])
def test_wordings_at_every_depth_of_one_line(documents, monkeypatch, part):
    monkeypatch.setattr(license_scan, "PART", part)
    rng = random.Random(1)
    story = "ships and stars were seen by the old harbour with a license to sail under any flag as software is made".split(" ")
    found, want = [], []
    for name, wordings in license_scan.TEMPLATES.items():
        for w in wordings:
            for depth in (0, 5, 60, 200, 1500):
                text = " ".join([*(rng.choice(story) for _ in range(depth)), w, *(rng.choice(story) for _ in range(depth // 2))])
                found.append([(f[0], f[1], f[3]) for f in license_scan.findings(text)])
                want.append([(name, 1, 0)])
    assert found == want


def test_gates_are_in_every_acceptable_wording():
    for t in license_scan._templates():
        assert sum(any(g in w for g in license_scan.gates()) for w in t.places) > t.allowed


def test_missing_words_anywhere_are_allowed_up_to_their_share():
    for t in license_scan._templates():
        plain = [i for i, w in enumerate(t.words) if not any(c.isdigit() for c in w)]
        for at in range(0, len(plain), 3):
            for more in (0, 1):
                gone = set(plain[at : at + t.allowed + more])
                text = "a story of ships " + " ".join("xyzzy" if i in gone else w for i, w in enumerate(t.words)) + " and stars"
                got = [f[3] for f in license_scan.findings(text) if f[0] == t.name]  # the shorter wording of a license may be whole
                assert bool(got) if len(gone) <= t.allowed else len(gone) not in got, (t.name, gone)


def test_words_between_words_decide_nothing():
    """One other word after each of a wording's words, which may compress worse with the template than without."""
    for t in license_scan._templates():
        text = " ".join(f"{w} qx{i}j" for i, w in enumerate(t.words))
        assert (t.name, 0) in [(f[0], f[3]) for f in license_scan.findings(text)], (t.name, t.words)


def test_rows_and_columns(documents):
    mit = license_scan.TEMPLATES["MIT"][0]
    docs = documents([(1, mit, None, None), (1, mit, None, None), (None, mit, None, None), (2, None, None, None), (3, "", None, None)])
    out = license_scan.scan(docs.withColumn("license", F.lit(1)).withColumn("gain", F.lit("x"))).collect()
    assert sorted((r.doc_id or 0, r.license) for r in out) == [(0, "MIT"), (1, "MIT"), (1, "MIT")]


def test_very_long_lines_take_bounded_blocks(documents):
    text = "licensed under software permission " * 60_000 + license_scan.TEMPLATES["ISC"][0]
    assert [f[0] for f in license_scan.findings(text)] == ["ISC"]


def test_versions_decide_and_prose_is_left_alone(documents):
    texts = [None, "", "A licence to write about copyright and warranty.", "This work is licensed under the GNU General Public License, version 9.", "I bought a fishing license in 2004.\nNo license, no fish."]
    assert license_scan.scan(documents([(i, t, None, None) for i, t in enumerate(texts)])).count() == 0
    assert license_scan.scan(documents([])).count() == 0


def test_small_differences_are_named(documents):
    text = license_scan.TEMPLATES["ISC"][0].replace("fee", "charge")
    r = license_scan.scan(documents([(1, "x\n" + text, None, None)])).first()
    assert (r.license, r.first_line, r.words_missing, r.missing) == ("ISC", 2, 1, ["fee"])


def total(rollup):
    return Counter({(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()})


def test_batches_commit_once(documents, sp):
    docs = documents([(1, "a b", "en", "s"), (2, "c", "en", "s"), (3, None, None, None), (3, None, None, None)])
    r = token_rollup.Rollup(sp)
    assert total(r) == {}
    load = token_rollup.inserts(token_rollup.counted(docs, "words-1"))
    assert r.commit("1", load) and not r.commit("1", load)
    assert total(r) == {("s", "en", "words-1"): (2, 3), (None, None, "words-1"): (2, 0)}
    r.compact()
    assert not r.commit("1", load)
    gone = docs.filter("doc_id = 2")
    assert r.commit("2", token_rollup.deletes(token_rollup.counted(gone, "words-1")))
    new = documents([(1, "a b c d", "en", "s")])
    assert r.commit("3", token_rollup.revisions(token_rollup.counted(docs.filter("doc_id = 1"), "words-1"), token_rollup.counted(new, "words-1")))
    assert total(r) == {("s", "en", "words-1"): (1, 4), (None, None, "words-1"): (2, 0)}
    r.compact()
    r.compact()
    assert total(r)[("s", "en", "words-1")] == (1, 4) and all(map(r.is_committed, "123")) and not r.is_committed("4")
    assert r.commit("4", load.limit(0)) and total(r)[("s", "en", "words-1")] == (1, 4)
    with pytest.raises(ValueError):
        r.commit("../x", load)


def test_counts_by_tokenizer(documents):
    rows = token_rollup.counted_by(documents([(1, "hello world", "en", "s"), (2, None, "en", "s")]), "bpe", packing.default_tokenizer()).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 2]


def test_replayed_rollup_of_nothing(documents, sp):
    labels = sp.createDataFrame([], "doc_id long, quality int, toxic int")
    assert token_rollup.replayed_rollup(documents([]), labels).count() == 0


def replay(rows, labels):
    """The query's totals, from plain Python and the tokenizers library."""
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    counters = {"words-1": lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)), "bytes-1": lambda t: len(t.encode()), token_rollup.BPE: lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)}
    toxic = {i for i, _, x in labels if x == 1}
    low = {i for i, q, _ in labels if q == 0}
    out = {}
    for i, text, lang, source in rows:
        if i is not None and i in toxic:
            continue
        text = text or ""
        if i is not None and i in low:
            text = text.partition("\n")[2]
        for v, count in counters.items():
            n, t = out.get((source, lang, v), (0, 0))
            out[source, lang, v] = n + 1, t + count(text)
    return out


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_replayed_rollup_against_brute_force(documents, sp, monkeypatch, most):
    monkeypatch.setattr(token_rollup, "BROADCAST_MARKS", most)
    texts = ["a line\nand <|endoftext|> more", "one line", None, "", "\nx", "é ñ\n\n漢字 12", "w " * 5000 + "\n" + "v" * 3000]
    rows = [(i % 40, texts[i % 7], ("en", "de", None)[i % 3], ("s", None, "t")[i % 4 % 3]) for i in range(90)] + [(None, "no id\nat all", "en", "s")]
    labels = [(i, (0, 1, None)[i % 3], (0, 0, 1, None)[i % 4]) for i in range(0, 40, 2)] + [(3, 1, 0), (3, 0, 0), (5, 0, 1), (None, 0, 1)]
    docs = documents(rows).withColumn("version", F.lit("own")).withColumn("sign", F.lit(7)).withColumn("toxic", F.lit(1)).withColumn("low", F.lit(True)).withColumn("id", F.lit(0))
    got = token_rollup.replayed_rollup(docs, sp.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("x")))
    assert {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in got.collect()} == replay(rows, labels)


def test_a_lost_writer_is_ignored(documents, sp):
    load = token_rollup.inserts(token_rollup.counted(documents([(1, "a b", "en", "s")]), "words-1"))
    r = token_rollup.Rollup(sp)
    load.groupBy(*token_rollup.KEYS).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{r.path}/batches/1~dead")
    assert total(r) == {} and not r.is_committed("1")
    assert r.commit("1", load) and not r.commit("1", load)
    assert total(r) == {("s", "en", "words-1"): (1, 2)}


def test_a_compaction_that_comes_second_changes_nothing(documents, sp, monkeypatch):
    load = token_rollup.inserts(token_rollup.counted(documents([(1, "a b", "en", "s")]), "words-1"))
    r = token_rollup.Rollup(sp)
    r.commit("1", load)
    real, sum_ = r._state, r._sum
    stale = [real()]
    assert r.compact()
    monkeypatch.setattr(r, "_state", lambda: stale.pop() if stale else real())
    monkeypatch.setattr(r, "_sum", lambda *_: sp.createDataFrame([], token_rollup.SCHEMA))
    assert not r.compact()
    monkeypatch.setattr(r, "_sum", sum_)
    assert total(r) == {("s", "en", "words-1"): (1, 2)}


class Lost(Exception):
    pass


def replayed(sp, path, deltas):
    r = token_rollup.Rollup(sp, path)
    for name, delta in deltas:
        r.commit(name, delta)
        r.compact()
    return r


@pytest.mark.parametrize("fails", ["before", "after", "silent"])
def test_stopped_at_every_step(documents, sp, monkeypatch, fails):
    """A run dies before or right after each write, claim and removal, or a removal does nothing; the next run goes on from there."""
    texts = [("1", "a " * 10), ("2", "b " * 100), ("3", "c " * 1000)]
    deltas = [(n, token_rollup.inserts(token_rollup.counted(documents([(1, t, "en", "s")]), "words-1")).coalesce(1)) for n, t in texts]
    want = {("s", "en", "words-1"): (3, 1110)}
    operations = {n: getattr(token_rollup, n) for n in (("drop",) if fails == "silent" else ("write", "claim", "drop"))}
    at, step = 0, 0
    while True:
        step, at = step + 1, 0

        def stopping(operation):
            def run(*args):
                nonlocal at
                at += 1
                if at != step:
                    return operation(*args)
                if fails == "silent":
                    return False
                if fails == "after":
                    operation(*args)
                raise Lost

            return run

        for n, f in operations.items():
            monkeypatch.setattr(token_rollup, n, stopping(f))
        r = token_rollup.Rollup(sp)
        try:
            replayed(sp, r.path, deltas)
        except Lost:
            assert set(total(r).values()) <= {(1, 10), (2, 110), (3, 1110)}
        for n, f in operations.items():
            monkeypatch.setattr(token_rollup, n, f)
        if at < step:
            break
        assert total(replayed(sp, r.path, deltas)) == want, step
    assert step > (4 if fails == "silent" else 12)


def test_wordings_far_along_a_line_and_two_on_one(documents):
    prose = "these are words of a story about ships and stars " * 60
    mit, apache = license_scan.TEMPLATES["MIT"][0], license_scan.TEMPLATES["Apache-2.0"][0]
    texts = [prose + mit + " " + prose, prose + "a license here " + prose + apache, mit + " " + apache, f"{prose} {mit} {prose} {apache} {mit}"]
    out = license_scan.scan(documents([(i, t, None, None) for i, t in enumerate(texts)])).collect()
    assert Counter((r.doc_id, r.license) for r in out) == {(0, "MIT"): 1, (1, "Apache-2.0"): 1, (2, "MIT"): 1, (2, "Apache-2.0"): 1, (3, "MIT"): 2, (3, "Apache-2.0"): 1}
    assert all((r.first_line, r.last_line, r.words_missing) == (1, 1, 0) for r in out)


def test_every_wrapped_form_is_found(documents):
    rows, want = [], set()
    for name, wordings in license_scan.TEMPLATES.items():
        for w in wordings:
            parts = w.split(" ")
            for at in range(1, len(parts)):
                for mark in ("", " * "):
                    rows.append((len(rows), "Some prose.\n\n" + mark + " ".join(parts[:at]) + "\n" + mark + " ".join(parts[at:]), None, None))
                    want.add((rows[-1][0], name, 3, 4, 0))
    out = license_scan.scan(documents(rows)).collect()
    assert {(r.doc_id, r.license, r.first_line, r.last_line, r.words_missing) for r in out} == want and len(out) == len(want)

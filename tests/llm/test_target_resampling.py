import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tracewipe.llm import target_resampling as tr

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, longest=1, buckets=tr.BUCKETS, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text, longest)[1]))
    for text in target:
        t.update(map(bucket, features(text, longest)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in {*s, *t}}
    rows = []
    for doc_id, text in docs:
        words, found = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted([r for r in rows if r[5] >= least], key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in rows], key=repr)


def got(frame):
    return sorted([tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()], key=repr)


TEXTS = ["The Cat sat on the mat. " * 4, "äÖ 'x' don't 42nd été\x00b\x7fc", "", None, "word " * 30, "only", "Zebra ÀB c " * 9, "of the " * 15 + "end"]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_as_plain_python(sp, documents, longest):
    rows = [(i, TEXTS[i % len(TEXTS)] and f"{TEXTS[i % len(TEXTS)]} tail{i % 5}", "en", "s") for i in range(70)] + [(3, "the mat " * 12, "en", "s")] * 2 + [(None, "the cat " * 12, None, None)]
    goal = ["the cat sat", "on the mat", None, "été"]
    target = sp.createDataFrame([(i, t) for i, t in enumerate(goal)], "item_id long, text string")
    found = tr.resample(documents(rows).repartition(3), target, longest, percent=30)
    want = plain([r[:2] for r in rows], goal, longest, percent=30)
    assert got(found) == want
    assert any(r[4] for r in want)


def test_blocks_and_slices_change_nothing(sp, documents, monkeypatch):
    rows = [(i, ("lorem ipsum dolor " * i) + "x" * (i * 3) + "é" * 40, "en", "s") for i in range(40)]
    target = sp.createDataFrame([(1, "lorem dolor")], "item_id long, text string")
    monkeypatch.setattr(tr, "BLOCK", 500)
    monkeypatch.setattr(tr, "SLICE", 16)
    blocks = tr.encoded(documents(rows), target).count()
    assert blocks > 8
    words = [w for w in tr._word_slices(b"Ab cd" + b"e" * 40 + b" f" + b"g" * 50)]
    assert [x for part in words for x in part] == [b"ab", b"cd" + b"e" * 40, b"f" + b"g" * 50]
    assert got(tr.resample(documents(rows), target, 2)) == plain([r[:2] for r in rows], ["lorem dolor"], 2)


def test_empty_tables_and_clashing_columns(sp, documents):
    target = sp.createDataFrame([(1, "a b")], "item_id long, text string")
    assert got(tr.resample(documents([]), target)) == []
    rows = [(1, "a b c " * 10, "en", "s"), (2, "b " * 25, "en", "s")]
    docs = documents(rows).selectExpr("*", "1 as block", "2 as at", "3 as weight", "'x' as word", "4 as target")
    none = sp.createDataFrame([], "item_id long, text string, goal int")
    assert got(tr.resample(docs, none, percent=50)) == plain([r[:2] for r in rows], [], percent=50)


def test_one_hot_word_and_one_long_text(sp, documents):
    rows = [(i, "hot " * 50, "en", "s") for i in range(300)] + [(1000, " ".join(f"w{i}" for i in range(200_000)), "en", "s")]
    target = sp.createDataFrame([(1, "hot w7")], "item_id long, text string")
    assert got(tr.resample(documents(rows), target)) == plain([r[:2] for r in rows], ["hot w7"])


def test_a_file_holds_one_block(sp, documents, monkeypatch):
    """Blocks are large rows: a file of many would be buffered and decoded as a whole."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(tr, "BLOCK", 2000)
    docs = documents([(i, f"word{i} and others " * 20, "en", "s") for i in range(60)]).coalesce(1)
    blocks = tr.encoded(docs, docs.select("text").limit(3))
    sizes = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata.num_rows for f in blocks.inputFiles()]
    assert len(sizes) > 5 and max(sizes) == 1

"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mnemolake.llm import resample as module
from mnemolake.llm.resample import op13_resample, resample, word_runs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text, longest):
    words = WORD.findall(lowered(text))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20, seed="2024"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(doc, *features(text, longest)) for doc, text in docs]
    s = Counter(bucket(f) for _, fs, _ in own for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, longest)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for doc, fs, words in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def run(spark, docs, target, tasks=3, **options):
    df = spark.createDataFrame([(*d, "r", 1, 2) for d in docs], "doc_id long, text string, row string, bucket int, gain int").repartition(tasks)
    aim = spark.createDataFrame([(t, 5) for t in target], "text string, n int")
    return sorted((tuple(r) for r in resample(df, aim, **options).collect()), key=str)


def sample(seed, n):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "ÄRGER", "ärger", "x1", "naïve", "the", "of", "Ω", "w" * 90, "q" * 200]
    odds = np.array([1, 1, 1, 1, 1, 1, 12, 6, 1, 1, 1]) / 27
    return [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=odds)) + rng.choice([".", "", "\n- "])) for i in range(n)]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 50)])
def test_equals_plain_python(spark, monkeypatch, longest, buckets):
    monkeypatch.setattr(module, "SHARE_ROWS", 8)  # the frequent words' buckets are dealt
    docs = sample(1, 120) + [(500, None), (501, ""), (502, " .,\x00"), (None, "the of the"), (None, "the " * 30), (503, "beta " * 5000)]
    target = [t for _, t in sample(2, 9)] + [None, ""]
    assert run(spark, docs, target, longest=longest, buckets=buckets, percent=40) == brute(docs, target, longest, buckets, 40)


def test_repeated_rows_and_ids_each_count(spark):
    docs = [(7, "the " * 25)] * 5 + [(8, "of " * 25)] * 5
    got = run(spark, docs, ["the"], percent=50)
    assert got == brute(docs, ["the"], percent=50) and sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4, 5]


def test_empty_tables(spark):
    assert run(spark, [], ["the"]) == []
    docs = sample(3, 30)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [(1, None)], []) == [(1, 0, 0, brute([(1, None)], [])[0][3], None)]


def test_layout_does_not_matter(spark):
    docs, target = sample(4, 80), ["the alpha beta"] * 3
    assert run(spark, docs, target, tasks=1) == run(spark, docs, target, tasks=7)


def test_runs_stay_inside_their_text():
    found = [(crc.tolist(), text.tolist()) for crc, text in word_runs([b"a b", b"", b"C-d e"], 2)]
    assert found[1] == ([zlib.crc32(x) for x in (b"a b", b"c d", b"d e")], [0, 2, 2])


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert sorted((tuple(r) for r in op13_resample(spark, sf).collect()), key=str) == brute(docs, target)

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from mnemolake.llm import neardup as N
from mnemolake.llm.common import mix
from mnemolake.llm.neardup import classify, components, dart_signatures, dedup

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def brute_classes(texts):
    """Component number of each text by comparing all pairs."""
    sets = brute_sets(texts)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in index[x]}:
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
        for x in s:
            index[x].append(i)
    return [find(i) for i in range(len(texts))]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("scale", [1.0, 0.2, 30.0])
def test_signatures_agree_as_often_as_weighted_jaccard(scale):
    rng = np.random.default_rng(2)
    k, n = 4000, 50
    u = mix(rng.integers(0, 1 << 63, n).astype(np.uint64))
    a = rng.choice([0, 0.3, 1, 2.5, 7], n) * scale
    b = np.where(rng.random(n) < 0.6, a, rng.choice([0, 0.3, 1, 2.5, 7], n) * scale)
    e, w = np.concatenate([u[a > 0], u[b > 0]]), np.concatenate([a[a > 0], b[b > 0]])
    o = np.repeat([0, 2], [(a > 0).sum(), (b > 0).sum()])
    d = dart_signatures(e, w, o, 3, k)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((d[0] == d[2]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)
    assert not d[1].any() and d[0].all() and d[2].all()


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(3)
    e, o = mix(rng.integers(0, 1 << 63, 900).astype(np.uint64)), np.repeat(np.arange(3), [1, 99, 800])
    whole = dart_signatures(e, np.ones(900), o, 3, 130)
    for s in range(3):
        m = o == s
        assert (dart_signatures(e[m], np.ones(m.sum()), np.zeros(m.sum(), int), 1, 130)[0] == whole[s]).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [(rng.randrange(700, 760), rng.randrange(700, 760)) for _ in range(50)]
    got = {r["nid"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in classify(docs).collect()}
    assert same_partition([got[r["doc_id"]]["class_id"] for r in rows], brute_classes([r["text"] for r in rows]))
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())


def test_planted_chains_and_edge_cases(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    texts = [None, "", "!!!", "One two", "one  TWO!", "one two three four five", "one two three four five six"]
    base = words(120)
    for _ in range(40):  # a chain: each step changes two more words, so that ends are far apart
        base = list(base)
        for at in rng.sample(range(120), 1):
            base[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(base))
    shared = words(60)
    texts += [" ".join(shared + words(rng.randrange(20, 60))) for _ in range(40)]  # a common passage, too little to link
    texts += [" ".join(words(30000))] * 2
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[7], "n"), (None, "alone in having no id at all", "n"), (3, "One two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(4)
    got = classify(df).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text_hash"]): r["class_id"] for r in got}
    hashed = {r["doc_id"]: r["h"] for r in df.selectExpr("doc_id", "xxhash64(text) h").collect() if r["doc_id"] is not None}
    want = brute_classes(texts[3:])
    assert same_partition([by[i, hashed[i]] for i in range(3, len(texts))], want)
    assert [by[i, hashed[i]] for i in range(3)] == [0, 1, 2]
    left = dedup(df).collect()
    assert df.columns == dedup(df).columns
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == [0, 1, 2] + sorted(set(3 + x for x in want))
    assert sum(r["doc_id"] is None for r in left) == 1


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert classify(df).count() == 0 and dedup(df).count() == 0
    assert N.WORDS == 5 and N.SIMILAR == (4, 5)

import numpy as np

from mnemolake.llm import quality as Q


def test_em_finds_accuracies_of_planted_labellers():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.8
    catch = [0.6, 0.5, 0.4, 0.7]
    v = np.stack([np.where(rng.random(len(y)) < 0.2, 0, np.where(~y & (rng.random(len(y)) < c), -1, 1)) for c in catch], 1)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = Q.estimate(patterns, counts)
    assert np.allclose(model.accuracies()[:, 0], catch, atol=0.08)
    assert abs(model.prior - y.mean()) < 0.05
    caught = (v == -1).any(1)
    assert ((model.posterior(v) < 0.5) == caught).mean() > 0.99


def test_measures_by_hand():
    m = Q.measures([b"One two two.\nOne two two.", b"", "ÀB!! $$$$".encode()])
    assert m[0].tolist()[:1] == [6.0] and m[0, 3] == 2 / np.sqrt(6) and m[0, 4] == 4 / 6 and m[0, 6] == 0.5 and m[0, 9] == 2 / 6
    assert not m[1].any() and m[2, 2] == 0.5 and m[2, 5] == 2


def test_chunks_do_not_matter(monkeypatch):
    texts = [b"a b c d " * k for k in range(40)] + [b"x" * 3000]
    whole = Q.measures(texts)
    monkeypatch.setattr(Q, "in_chunks", lambda t: ((i, t[i : i + 3]) for i in range(0, len(t), 3)))
    assert np.allclose(Q.measures(texts), whole)


def test_against_held_labels(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in Q.op6_quality(spark, sf).collect()}
    assert len(got) == 1000
    good = [got[d]["keep"] for d, q in truth.items() if q == 1]
    bad = [got[d]["keep"] for d, q in truth.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "ok text here. " * 50000, "c"), (3, "$$$$ ####", "d")], "doc_id long, text string, quality string")
    model = Q.learn(docs)
    got = Q.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["quality"] <= 1 for r in got)
    empty = docs.limit(0)
    assert Q.score(empty, Q.learn(empty)).count() == 0


def test_features_by_hand():
    texts = [b"abcdab", b"", b"xyz", "éa é".encode()]
    m = Q.measures(texts)
    rows, cols, vals = Q.features(texts, m)
    for i, t in enumerate(texts):
        want = {}
        grams = [t[k : k + 4] for k in range(len(t) - 3)]
        for g in grams:
            b = int(Q.mix(np.array([int.from_bytes(g, "little")], np.uint64))[0] % np.uint64(Q.BUCKETS))
            want[b] = want.get(b, 0.0) + 1 / len(grams)
        got = {}
        for c, v in zip(cols[rows == i].tolist(), vals[rows == i].tolist(), strict=True):
            got[c] = got.get(c, 0.0) + v
        steps = {b: got[b] - want.get(b, 0.0) for b in got}
        assert np.isclose(sum(steps.values()), len(Q.LABELLERS) / 3) and all(v > -1e-12 for v in steps.values())
        assert set(want) <= set(got)


def test_training_ends_where_no_step_helps():
    """At the end the gradient of the weighted log-loss, by plain sums, is small; classes weigh alike."""
    rng = np.random.default_rng(4)
    n = 300
    y = np.where(rng.random(n) < 0.1, 0.02, 0.97)
    cols = np.where(y < 0.5, rng.integers(0, 40, n), rng.integers(20, 60, n))
    w, b = Q.train(np.arange(n), cols, np.ones(n), y)
    p = 1 / (1 + np.exp(-(w[cols] + b)))
    weight_good, weight_bad = y / y.sum(), (1 - y) / (1 - y).sum()
    for c in np.unique(cols):
        at = cols == c
        assert abs((p[at] * (weight_good + weight_bad)[at] - weight_good[at]).sum() + 1e-4 * w[c]) < 0.02
    assert p[y < 0.5].mean() + 0.3 < p[y > 0.5].mean()


def test_query_equals_each_text_on_its_own(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = Q.learn(docs)
    got = {r["doc_id"]: r for r in Q.op6_quality(spark, sf).collect()}
    for r in docs.collect():
        t = [(r["text"] or "").encode()]
        m = Q.measures(t)
        v = Q.votes(m)
        rows, cols, vals = Q.features(t, m)
        z = sum(float(x) * float(model.weights[c]) for c, x in zip(cols, vals, strict=True)) + model.bias
        one = got[r["doc_id"]]
        assert abs(one["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and one["keep"] == (one["score"] >= 0.5)
        assert abs(one["label_posterior"] - model.labels.posterior(v)[0]) < 1e-9 and one["votes"] == "".join("-0+"[x + 1] for x in v[0])

from itertools import combinations

import numpy as np
import pytest

from mnemolake.llm import toxicity as T


def brute_kernel(a: bytes, b: bytes) -> float:
    """Sum over common subsequences, by the codes of letters, of both weights."""

    def table(w):
        codes, out = [T.BEGIN] + [int(T.CODES[x]) for x in w if T.CODES[x]], {}
        for at in combinations(range(len(codes)), T.LENGTH):
            if at[-1] - at[0] < T.WINDOW:
                u = tuple(codes[i] for i in at)
                out[u] = out.get(u, 0) + T.DECAY ** (at[-1] - at[0] - T.LENGTH + 1)
        return out

    x, y = table(a), table(b)
    return sum(v * y.get(u, 0) for u, v in x.items())


@pytest.mark.parametrize("a,b", [(b"idiot", b"id-i.o.t"), (b"stupid", b"stuupxid"), (b"worthless", b"worth"), (b"abcd", b"dcba"), ("éèçà".encode(), "ÉÈÇÀ".encode())])
def test_subsequence_weights_equal_the_kernel(a, b):
    dense = np.zeros(T.ALPHABET**T.LENGTH)
    x = T.letters([b])
    for place, number, weight in T.subsequences(x):
        np.add.at(dense, number, weight)
    got = T.margins([a], dense, 0.0)[0] * T.size_of(len(T.letters([a]).code))
    assert np.isclose(max(0.0, got), brute_kernel(a, b))


def test_tokens_and_sentences():
    x = T.letters([b"you i d i o t. Next l.o.s.e.r one\nline", b"", b"A b"])
    words = ["".join(" abcdefghijklmnopqrstuvwxyz"[c] for c in x.code[x.token == t][1:]) for t in range(x.token.max() + 1)]
    assert words == ["you", "idiot", "next", "loser", "one", "line", "ab"]
    assert x.text.tolist() == [0, 0, 0, 2]


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = T.op1_toxicity(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.95


def test_precision_and_recall_by_language(spark):
    """Held out on the larger table, where German and French insults are made of these languages' morphemes."""
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [(r["predicted"], truth[r["doc_id"]], lang[r["doc_id"]]) for r in T.op1_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]

    def rates(rows):
        both, called, toxic = sum(p and t for p, t, _ in rows), sum(p for p, _, _ in rows), sum(t for _, t, _ in rows)
        return both / max(1, called), both / max(1, toxic)

    precision, recall = rates(held)
    assert precision > 0.8 and recall > 0.85, (precision, recall)
    for name, least in (("en", (0.99, 0.85)), ("de", (0.6, 0.9)), ("fr", (0.6, 0.9))):
        assert all(x > y for x, y in zip(rates([r for r in held if r[2] == name]), least, strict=True)), name


def test_density_joins_only_where_it_tells_more():
    rng = np.random.default_rng(5)
    toxic = np.arange(400) < 200
    sure = np.stack([np.where(toxic, 2.0, -1.0) + rng.normal(0, 0.2, 400), rng.normal(-5, 0.5, 400)], 1)
    assert T.calibrate(sure, toxic, np.ones(3))[0][1] == 0.0
    vague = np.stack([np.where(toxic, 1.8, 1.4) + rng.normal(0, 0.5, 400), np.where(toxic, -3.0, -6.0) + rng.normal(0, 0.5, 400)], 1)
    slopes, offset = T.calibrate(vague, toxic, np.ones(3))
    assert slopes[1] > 0 and (((vague @ np.array(slopes) + offset) >= 0) == toxic).mean() > 0.95


def brute_fit_scores(texts, model):
    """Texts' signs from plain sums over all subsequences of each token."""
    weight_of = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    out = []
    for t in texts:
        x = T.letters([t])
        best, hits, tokens = model.bias, 0, 0
        for k in np.unique(x.token):
            codes = x.code[x.token == k].tolist()
            total = size = 0.0
            for at in combinations(range(len(codes)), T.LENGTH):
                if at[-1] - at[0] < T.WINDOW:
                    w = T.DECAY ** (at[-1] - at[0] - T.LENGTH + 1)
                    a, b, c, d = (codes[i] for i in at)
                    total += w * weight_of.get(a * T.ALPHABET**3 + b * T.ALPHABET**2 + c * T.ALPHABET + d, 0.0)
                    size += w * w
            f = total / np.sqrt(size if size > 0 else 1.0) + model.bias
            best, hits, tokens = max(best, f), hits + (f > 0), tokens + 1
        out.append((best, np.log((hits + 0.5) / (tokens + 20.0))))
    return np.array(out)


def test_fitted_machine_equals_plain_sums():
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abdefgimnoprstu"), rng.integers(2, 9)))
    texts, toxic = [], []
    for i in range(160):
        words = [word() for _ in range(12)]
        if i % 4 == 0:
            words[rng.integers(12)] = ["zackwibble", "quorkfatz"][i // 4 % 2]
        texts.append(" ".join(words).encode())
        toxic.append(i % 4 == 0)
    model = T.fit(texts, np.array(toxic))
    dense = np.zeros(T.ALPHABET**T.LENGTH)
    dense[model.features] = model.weights
    got = T.signs(texts[:40], dense, model.bias)
    assert np.allclose(got, brute_fit_scores(texts[:40], model), atol=1e-6)
    assert ((model.chance(T.signs(texts, dense, model.bias)) >= 0.5) == np.array(toxic)).mean() > 0.98
    # Projected features are the landmarks' kernel values times the inverse root of the landmarks' own: the kernel comes back from them.
    one = T.fit(texts, np.array(toxic))
    assert np.array_equal(one.features, model.features) and np.allclose(one.weights, model.weights)


def test_gaps_and_insertions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = T.learn(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    cases = ["such an i.d.i.o.t here", "such an i d i o t here", "sttupid", "worth-less", "patheticc", "", None, "the and of", "12 34", "a" * 200_000]
    df = spark.createDataFrame([(i, c, 9) for i, c in enumerate(cases)], "doc_id long, text string, toxicity int")
    got = [r["toxicity"] >= 0.5 for r in T.score(df, model).orderBy("doc_id").collect()]
    assert got == [True] * 5 + [False] * 5


def test_little_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "bad"), (2, None), (None, "x")], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, 0), (2, None), (None, 1)]):
        model = T.learn(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert all(0 <= r["toxicity"] <= 1 for r in T.score(docs, model).collect())
    assert T.score(docs.limit(0), model).count() == 0

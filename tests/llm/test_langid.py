import math
from collections import defaultdict

import numpy as np
import pytest

from mnemolake.llm.common import utf8
from mnemolake.llm.langid import Coder, identify, learn, op3_language_id, train

WORDS = {"a": {b"the": 3, b"then": 1, b"hat": 2}, "b": {b"le": 4, b"la": 1, "thé".encode(): 2}}


def brute_bits(counts: dict[bytes, int], word: bytes, order: int) -> float:
    tree = defaultdict(lambda: defaultdict(int))
    for w, n in counts.items():
        s = b" " + w + b" "
        for p in range(1, len(s)):
            for d in range(min(order, p) + 1):
                tree[s[p - d : p]][s[p]] += n
    bits, s = 0.0, b" " + word + b" "
    for p in range(1, len(s)):
        for d in range(min(order, p), -1, -1):
            here = tree.get(s[p - d : p])
            if here is None:
                continue
            total, kinds = sum(here.values()), len(here)
            if s[p] in here:
                bits -= math.log2(here[s[p]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [0, 1, 2, 4])
def test_code_lengths_equal_the_tree_walk(order):
    model = train(["a", "b"], [(list(w), np.array(list(w.values()), float)) for w in WORDS.values()], order)
    coder = Coder(model, order)
    words = [b"the", b"then", b"hat", b"la", "thé".encode(), b"zebra", b"q", b"thethethe", "ßé".encode()]
    got = coder.texts(words + [b"the la, THE! 12 zebra", b"", b"1 2 !"])
    for w, row in zip(words, got, strict=False):
        assert np.allclose(row, [brute_bits(WORDS[x], w, order) for x in "ab"], rtol=1e-5)
    assert np.allclose(got[-3], got[0] * 2 + got[3] + got[5], rtol=1e-5)
    assert not got[-2:].any()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edge_cases(spark):
    train_rows = [(1, "the cat and the hat " * 20, "en"), (2, "le chat et la souris " * 20, "fr"), (3, None, "fr"), (4, "no language", None)]
    docs = spark.createDataFrame(train_rows, "doc_id long, text string, lang string")
    model = learn(docs)
    assert model.languages == ["en", "fr"]
    cases = [(10, None), (11, ""), (12, "123 !? …"), (13, "the hat"), (14, "la souris"), (14, "la souris"), (None, "THE CAT"), (15, "the cat " * 40000), (16, "漢字")]
    got = identify(spark.createDataFrame([(*c, "x") for c in cases], "doc_id long, text string, lang_pred string"), model).collect()
    assert [r["lang_pred"] for r in got][:8] == ["und", "und", "und", "en", "fr", "fr", "en", "en"]
    assert got[-1]["lang_pred"] in ("en", "fr") and got[0]["lang_score"] == 0
    empty = docs.limit(0)
    assert {r["lang_pred"] for r in identify(docs, learn(empty)).collect()} == {"und"}
    assert identify(empty, model).count() == 0


def test_bytes_of_null():
    import pyarrow as pa

    assert utf8(pa.array([None, "é"])) == [b"", "é".encode()]

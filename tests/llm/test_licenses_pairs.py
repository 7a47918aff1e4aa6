from itertools import permutations

from mnemolake.llm import licenses as L
from mnemolake.llm.licenses import scan


def test_several_whole_passages_keep_every_label(spark):
    """Every ordered pair of passages in one file, and all of them at once: no label is lost."""
    files = [[a, b] for a, b in permutations(range(len(L.TEMPLATES)), 2)] + [list(range(len(L.TEMPLATES)))]
    text = [" ".join(["some words before", *("and " + L.TEMPLATES[k][1] + " then other words" for k in ks)]) for ks in files]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (set(r["labels"]), r["score"]) for r in scan(df).collect()}
    for i, ks in enumerate(files):
        assert {L.TEMPLATES[k][0] for k in ks} <= got[i][0]
        assert 0 < got[i][1] <= 1

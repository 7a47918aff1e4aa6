import numpy as np

from mnemolake.operators import vectors


def around(seed, centres, each, noise, dim=16):
    rng = np.random.default_rng(seed)
    m = np.repeat(rng.normal(size=(centres, dim)), each, axis=0) + noise * rng.normal(size=(centres * each, dim))
    m = m[rng.permutation(len(m))]
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_sums_give_the_linkage_of_pairs():
    for seed in range(12):
        for cut in (0.1, 0.3, 0.5, 0.78):
            m = around(seed, 9, 9, 0.8)
            assert vectors.linkage_by_sums(m, cut).tolist() == vectors.average_linkage(m @ m.T, cut).tolist()


def test_large_scopes_cluster_as_whole_ones(spark):
    """A scope above the block keeps every cluster that it has in one piece."""
    m = around(5, 60, 6, 0.35)
    df = spark.createDataFrame([(i, "s", x.tolist()) for i, x in enumerate(m)], "id long, scope string, embedding array<double>").repartition(3)
    want = {r["id"]: r["cluster"] for r in vectors.cluster(df, ["scope"], 0.7).collect()}
    assert len(want) > 200
    for block in (4, 50, 200):
        assert {r["id"]: r["cluster"] for r in vectors.cluster(df, ["scope"], 0.7, block=block).collect()} == want

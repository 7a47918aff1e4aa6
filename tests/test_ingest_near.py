import numpy as np
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS
from mnemolake.engine import MemoryEngine
from mnemolake.sources.embeddings import HashEncoder


class Pairs(HashEncoder):
    """Texts 'a <n> ...' and 'b <n> ...' have vectors at cosine 0.96; other numbers are far."""

    def encode(self, texts):
        out = []
        for t in texts:
            side, n = t.split("near ")[1].split()[:2]
            u, v = (np.random.default_rng([int(n), k]).standard_normal(self.dim) for k in (1, 2))
            u /= np.linalg.norm(u)
            v -= (v @ u) * u
            v /= np.linalg.norm(v)
            out.append(u if side == "a" else 0.96 * u + np.sqrt(1 - 0.96**2) * v)
        return np.array(out, np.float32).reshape(len(texts), self.dim)


def test_near_duplicates_are_all_refused(spark, tmp_path):
    engine = MemoryEngine(spark, f"file://{tmp_path}/store", DEFAULTS.override(dim=64), Pairs(64))
    batch = lambda side: spark.createDataFrame([(f"near {side} {n}",) for n in range(60)], "content string")
    assert engine.ingest(batch("a"), "2024-01-01").filter("status = 'stored'").count() == 60
    got = engine.ingest(batch("b"), "2024-01-02")
    assert got.filter("status = 'duplicate'").count() == 60
    names = {r["id"]: r["content"] for r in engine.catalog.read("episodes").collect()}
    assert sorted(names[r[0]] for r in got.select("duplicate_of").collect()) == sorted(f"near a {n}" for n in range(60))
    assert engine.catalog.read("vectors").agg(F.count("*")).first()[0] == 60

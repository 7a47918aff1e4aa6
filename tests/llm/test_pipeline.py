import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P

from mnemolake.llm.common import materialize, shared_dir
from mnemolake.llm.packing import encoder
from tests.llm.test_neardup import brute_classes


def documents(spark):
    rng = random.Random(6)
    vocabulary = {"en": [f"the{i}" for i in range(400)], "fr": [f"éle{i}" for i in range(400)]}
    make = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "fr"
        rows.append((i, make(lang, rng.randrange(1, 90)), lang, f"src{i % 4}", i))
    rows += [(200 + i, rows[i][1].upper(), rows[i][2], "src0", 1) for i in range(0, 30, 3)]  # equal texts, in capitals
    for i in range(20):  # near copies
        words = make("en", 80).split()
        rows.append((300 + 2 * i, " ".join(words), "en", "src1", 2))
        words[rng.randrange(80)] = "changed"
        rows.append((301 + 2 * i, " ".join(words), "en", "src2", 2))
    rows += [(400, None, "en", "src0", 0), (401, "", None, None, 0), (402, "12 !?", "fr", "src3", 0), (403, make("en", 3000), None, None, 9), (404, "x", "en", "src1", 9), (404, "x", "en", "src1", 9)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)


def test_stages_equal_brute_force(spark):
    rows, docs = documents(spark)
    steps = []
    for k, (_, stage) in enumerate(C.STAGES):
        docs = materialize(stage(spark, docs, ""), "test")
        steps.append(docs.collect())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    language, exact, near, mixed, packed = steps
    assert Counter(r["doc_id"] for r in language) == Counter(r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    assert all(r["lang"] == ("fr" if "éle" in r["text"].lower() else "en") for r in language if len(r["text"]) > 60)
    best = defaultdict(int)
    for r in language:
        best[r["text"].encode().lower()] = max(best[r["text"].encode().lower()], r["doc_id"])
    assert Counter(r["doc_id"] for r in exact) == Counter(best.values())
    order = sorted(exact, key=lambda r: r["doc_id"])
    assert sorted(r["doc_id"] for r in near) == sorted({order[c]["doc_id"] for c in brute_classes([r["text"] for r in order])})
    size = {r["doc_id"]: len(r["text"].split()) for r in near}
    words = Counter()
    for r in mixed:
        words[r["source"]] += len(r["text"].split())
    total = Counter()
    for r in near:
        total[r["source"]] += size[r["doc_id"]]
    assert abs(sum(words.values()) - 1.5 * sum(total.values())) <= len(total)
    assert all(words[s] <= 2 * total[s] for s in total)
    original = {r["doc_id"]: r["text"] for r in near}
    cut = [r for r in mixed if r["text"] != original[r["doc_id"]]]
    assert len(cut) <= len(total) and all(original[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split() for r in cut)
    encode = encoder(P.path("byte_bpe_50k.json"), None, None)
    want = Counter((r["doc_id"], len(encode(r["text"])) + 1) for r in mixed)
    got = defaultdict(int)
    for r in packed:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got == {(d, n): n * c for (d, n), c in want.items()}
    one = next(r for r in packed if r["start"] == 0 and r["length"] == r["doc_tokens"] and Counter(x["doc_id"] for x in mixed)[r["doc_id"]] == 1)
    text = next(r["text"] for r in mixed if r["doc_id"] == one["doc_id"])
    assert one["ids_crc32"] == zlib.crc32(np.append(encode(text), [0]).astype("<u4").tobytes())


def test_stages_on_nothing(spark):
    _, docs = documents(spark)
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_extra_columns_survive(spark):
    """Columns of any name and type come through every stage as they are; the last one ignores them."""
    _, docs = documents(spark)
    names = ["mixed", "kept", "class_id", "lang_pred", "size", "row", "hash", "words", "id", "maybe", "key", "text_hash", "doc_tokens", "__maybe", "__kept", "__part", "__hash", "__coded", "__size", "__n"]
    wide = docs.limit(60).selectExpr("*", *[f"named_struct('v', doc_id) AS `{n}`" for n in names])
    for name, stage in C.STAGES[:4]:
        out = stage(spark, wide, "")
        assert out.dtypes == wide.dtypes, name
        assert all(r[n]["v"] == r["doc_id"] for r in out.collect() for n in names), name
    assert C.STAGES[4][1](spark, wide, "").columns == C.STAGES[4][1](spark, docs, "").columns


def test_cut_documents_keep_their_spaces(spark):
    rows = [(i, " a\tb\n\nc  d\n" + "x y\n" * i, None, f"s{i % 3}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    original = {r[0]: r[1] for r in rows}
    out = C.STAGES[3][1](spark, docs, "").collect()
    cut = [r for r in out if r["text"] != original[r["doc_id"]]]
    assert cut and all(original[r["doc_id"]].startswith(r["text"]) and not r["text"][-1].isspace() for r in cut)


def test_run_leaves_only_what_its_result_reads(spark, tmp_path):
    _, docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    n = C.run(spark, str(tmp_path)).count()
    left = {x for x in shared.iterdir() if not x.name.startswith(".")} - before
    assert n > 100 and [x.name.rsplit("-", 1)[0] for x in left] == ["stage-mix_sources"]

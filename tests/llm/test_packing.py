import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemolake.llm.packing import best_fill, encoder, op7_packing, pack, packed_digest, public_50k, windows

TEXTS = [None, "", "one two three " * 900, "mêlée façade ñandú straße", "日本語 текст 🙂", "<|endoftext|> end", "x" * 5000, "a b\u0085c\x1cd", "  \n\n\t 12 3's"] + [f"word{i} " * (i % 61) for i in range(300)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=6), st.integers(20, 40))
def test_best_fill_equals_all_subsets(counts, capacity):
    chosen = best_fill(counts, capacity)
    top = max(counts)
    assert chosen[top] >= 1 and all(chosen[n] <= counts[n] for n in chosen)
    sums = {sum(n * c for n, c in zip(counts, pick, strict=True)) for pick in itertools.product(*(range(c + 1) for c in counts.values())) if dict(zip(counts, pick, strict=True))[top]}
    assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= capacity)


def test_windows_use_everything():
    counts = {7: 100, 13: 57, 40: 9, 64: 2}
    used = Counter()
    for chosen, times in windows(counts, 64):
        assert sum(n * c for n, c in chosen.items()) <= 64
        used.update({n: c * times for n, c in chosen.items()})
    assert used == counts


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "é <|endoftext|> 語", "<|endoftext"]


def test_ids_are_the_libraries_own_by_default():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))  # no setting is changed
    fast = encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for x in TEXTS + SPECIAL:
        assert fast(x or "").tolist() == t.encode(x or "", add_special_tokens=False).ids
    assert fast("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_held_tails_are_bounded_and_whole(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 90)) for i in range(600)] + [(1000 + i, "same tail") for i in range(400)], "doc_id long, text string").coalesce(1)
    whole = {(r["doc_id"], r["doc_tokens"]): 0 for r in pack(docs, public_50k).collect()}
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in pack(docs, public_50k, held_bytes=1 << 14).collect():
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
        spans[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append(r["length"])
    assert all(n == got for (_, n), got in whole.items()) and len(whole) == 1000
    assert all(sum(x) <= 1024 and (sum(x) == 1024 or sum(x) & sum(x) - 1 == 0) for x in sequences.values())


def test_query_equals_brute_force(spark, tmp_path):
    """Every id of every document, as the library gives it with no setting changed, lies in one piece; clashing columns change nothing."""
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(i, x, "s", 7, b"z") for i, x in enumerate(TEXTS + SPECIAL)], "doc_id long, text string, sequence_id string, length int, ids binary")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(TEXTS + SPECIAL)}
    got = defaultdict(list)
    for r in op7_packing(spark, str(tmp_path)).collect():
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        got[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
    assert {d: sorted(x) for d, x in got.items()} == {d: list(range(len(x))) for d, x in ids.items()}


def test_pieces_lie_gapless_and_lose_nothing(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string").repartition(3)
    encode = encoder(P.path("byte_bpe_50k.json"), None, None)
    ids = {i: np.append(encode(t or ""), [0]).astype("<u4") for i, t in enumerate(TEXTS)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed_digest(docs).collect():
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, spans in pieces.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == len(ids[d])
    assert len(pieces) == len(TEXTS)
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & at - 1 == 0 else 1024 - at
    assert padding == 0
    again = packed_digest(docs).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, packed_digest(docs).collect()))


def test_no_rows(spark):
    assert packed_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0

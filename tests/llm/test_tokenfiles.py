"""Token files: ids against the tokenizer on whole texts, the files' layout, and selective reads."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from mnemolake.llm import tokenfiles
from mnemolake.llm.tokenfiles import checksums, encoder, layout, op11_token_files, public_49k, read, read_span, write


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_49k())


ODD = ["", None, " ", "  a  b ", "A\tb\nc  d", "I'll don't  'S", "naïve é ́x ΣΑΣ Σ", "a<|endoftext|>b <|startoftext|> c", "x" * 500, "日本語のテキスト", "1234 5.6", " nb sp\x1c\x85z", "😀 ok‍👩", "İstanbul ﬁ", "J̌ J̌. H̱! W̊ x", "End., (stop)! a.b. 'tis. it's, WHY?! $$$ a$$$ 9 99 a9. <|x|>", "<|ENDOFTEXT|>", "x.\u0301 A\u0301. =\u0338"]


def whole(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def brute(tokenizer, docs):
    """Rows in file order without the order of rows that share a doc_id."""
    out, at = [], 0
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = whole(tokenizer, text)
        out.append((doc, at, ids))
        at += len(ids)
    return out


@pytest.mark.parametrize(("together", "known"), [(8, 1 << 18), (1 << 19, 5), (1 << 19, 1 << 18)])
def test_pieces_between_spaces_give_the_ids_of_whole_texts(monkeypatch, tokenizer, together, known):
    monkeypatch.setattr(tokenfiles, "TOGETHER", together)
    monkeypatch.setattr(tokenfiles, "KNOWN_PIECES", known)
    encoder.cache_clear()
    texts = [t or "" for t in ODD] + [" ".join(t or "" for t in ODD)] + [" ".join(t for t in ODD if t and "<|" not in t)]
    raw = [t.encode() for t in texts]
    for _ in range(3):
        ids, size = encoder(public_49k(), True, 2)(raw)
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [whole(tokenizer, t) for t in texts]
        ids, size = encoder(public_49k(), True, 2)([])
        assert not len(ids) and not len(size)
    encoder.cache_clear()
    ids, size = encoder(public_49k(), False, 2)(raw)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [whole(tokenizer, t) for t in texts]
    encoder.cache_clear()


def test_pieces_of_the_documents_give_the_ids_of_whole_texts(tokenizer):
    encoder.cache_clear()
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    ids, size = encoder(public_49k(), True, 2)([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [whole(tokenizer, t) for t in texts]


def stored(spark, tmp_path, docs, **options):
    df = spark.createDataFrame([(*d, "p", 1) for d in docs], "doc_id long, text string, part string, first int").repartition(3)
    write(df, f"file://{tmp_path}/t", public_49k, 2, between_spaces=True, **options)
    return f"file://{tmp_path}/t"


def test_documents_in_order(spark, tmp_path, tokenizer):
    docs = [(int(i), ODD[i % len(ODD)] or "word " * i) for i in np.random.default_rng(1).permutation(60)] + [(100, None), (101, "long text " * 20_000)]
    at = stored(spark, tmp_path, docs)
    got = sorted((r.doc_id, r.start, list(r.ids)) for r in read(spark, at).collect())
    assert got == brute(tokenizer, docs)
    sums = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in checksums(read(spark, at)).collect()}
    assert sums == {(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, s, x in got}


def test_null_and_repeated_ids(spark, tmp_path, tokenizer):
    docs = [(None, "a"), (None, "b c"), (5, "same"), (5, "same"), (5, "other one"), (-3, "x")]
    rows = sorted((r.start, r.doc_id, list(r.ids)) for r in read(spark, stored(spark, tmp_path, docs)).collect())
    assert [r[1] for r in rows] == [None, None, -3, 5, 5, 5]
    assert [r[0] for r in rows] == [0, *np.cumsum([len(r[2]) for r in rows])[:-1]]
    assert sorted(map(str, (r[1:] for r in rows))) == sorted(str((d, whole(tokenizer, t))) for d, t in docs)


def test_no_documents(spark, tmp_path):
    at = stored(spark, tmp_path, [])
    assert read(spark, at).collect() == [] and read_span(spark, at, 0, 10).collect() == []


@pytest.mark.parametrize(("ids", "encoding"), [("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_layout(spark, tmp_path, ids, encoding):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.integers(0, 1000, 400).astype(str))) for i in range(3000)]
    at = stored(spark, tmp_path, docs, options=layout(ids, row_group=1 << 17, page=1 << 13, page_rows=200))
    groups = 0
    for f in Path(f"{tmp_path}/t/tokens").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert encoding in columns["ids.list.element"].encodings
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
    assert groups > len(list(Path(f"{tmp_path}/t/tokens").glob("*.parquet")))
    assert read(spark, at).count() == 3000


def test_selective_reads(spark, tmp_path, tokenizer):
    docs = [(i, f"document number {i} " * (i % 7)) for i in range(300)]
    at = stored(spark, tmp_path, docs)
    plan = lambda df: df._jdf.queryExecution().toString()
    meta = read(spark, at).select("doc_id", "start", "n_tokens")
    assert "ids" not in plan(meta).split("== Physical Plan ==")[1]
    one = read(spark, at).filter("doc_id = 77")
    assert "EqualTo(doc_id,77)" in plan(one)
    every = [x for _, _, ids in brute(tokenizer, docs) for x in ids]
    for begin, end in [(0, 1), (500, 777), (len(every) - 3, len(every) + 50), (10, 10), (0, len(every))]:
        rows = sorted((r.start, list(r.ids)) for r in read_span(spark, at, begin, end).collect())
        assert [x for _, ids in rows for x in ids] == every[begin:end]
        assert not rows or rows[0][0] == begin


def test_query_equals_the_tokenizer(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, s, x in brute(tokenizer, docs)]
    assert sorted(tuple(r) for r in op11_token_files(spark, sf).collect()) == want

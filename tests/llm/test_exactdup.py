import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemolake.llm.exactdup import CountingQuotientFilter as CQF
from mnemolake.llm.exactdup import classify, dedup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**64 - 1)), min_size=1), min_size=1, max_size=4), st.integers(1, 12))
def test_filters_merge_without_loss(parts, qbits):
    filters = [CQF.loads(CQF.of(np.array(p, np.uint64), qbits).dumps()) for p in parts]
    fp, n = CQF.merged(filters).items()
    assert dict(zip(fp.tolist(), n.tolist(), strict=True)) == Counter(x for p in parts for x in p)
    assert (np.diff(fp.astype(object)) > 0).all()


def rows():
    out = [(i, f"Text {i % 23}" if i % 2 else f"tExT {i % 23}", "x") for i in range(300)]
    out += [(900 + i, t, "y") for i, t in enumerate([None, "", None, "É", "é", " ", "long " * 30000, "LONG " * 30000])]
    return out + [(5, "Text 5", "x"), (None, "Text 7", "n"), (None, "only null", "n")]


def test_classify_equals_brute_force(spark):
    data = rows()
    groups = defaultdict(list)
    low = lambda t: (t or "").encode().lower()
    for d, t, _ in data:
        groups[low(t)].append(d)
    want = Counter()
    for d, t, _ in data:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[d, keep, len(g), d == keep, hashlib.sha256(low(t)).hexdigest()] += 1
    df = spark.createDataFrame(data, "doc_id long, text string, keep_id string").repartition(5)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in classify(df).collect())
    assert got == want


def test_dedup_keeps_one_whole_row_of_each_text(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, sha string").repartition(5)
    out = dedup(df)
    assert out.columns == df.columns
    low = [(r["text"] or "").encode().lower() for r in out.collect()]
    assert len(low) == len(set(low)) == len({(t or "").encode().lower() for _, t, _ in rows()})
    assert sum(r["doc_id"] is None for r in out.collect()) == 1


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert classify(df).count() == 0 and dedup(df).count() == 0

"""Vector codes against plain Python integers."""

import hashlib

import numpy as np
import pytest

from mnemolake.llm import codebooks
from mnemolake.llm.codebooks import compress, nearest, usable


def brute(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = [[(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    pick = lambda x, book: min(range(len(book)), key=lambda c: (far(x, book[c]), c))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut:
                groups.setdefault(pick(x[p], books[p]), []).append(x[p])
            books[p] = [[sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)] if c in groups else entry for c, entry in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, by = [], {}
    for (i, _, label), x in zip(kept, cut, strict=True):
        codes = [pick(x[p], books[p]) for p in range(parts)]
        error = sum(far(x[p], books[p][c]) for p, c in enumerate(codes))
        by[label] = by.get(label, 0) + error
        out.append((i, "".join(f"{c:02x}" for c in codes), error, label))
    return sorted(((i, c, e, by[label], sha) for i, c, e, label in out), key=str)


def run(spark, rows, parts=4, entries=256, rounds=4, tasks=3):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, id string")
    return sorted((tuple(r) for r in compress(usable(df.repartition(tasks)), parts, entries, rounds).collect()), key=str)


def f32(rng, n, scale=1.0):
    return [float(np.float32(x)) for x in rng.normal(size=n) * scale]


@pytest.mark.parametrize("entries", [256, 7])
def test_equals_plain_integers(spark, monkeypatch, entries):
    monkeypatch.setattr(codebooks, "TILE", 16)
    rng = np.random.default_rng(3)
    rows = [(int(i), f32(rng, 8), int(i) % 3 or None) for i in rng.permutation(90)]
    rows += [(200 + i, [0.25] * 8, 1) for i in range(40)]  # a hot vector and label
    rows += [(300, None, 1), (301, [1.0] * 7 + [None], 1), (302, [float("nan")] * 8, 1), (303, [float("-inf")] * 8, 1)]
    rows += [(5, f32(rng, 8), 2), (5, f32(rng, 8), None), (None, f32(rng, 8), 7), (400, [0.5, -0.5], None), (401, [], 9)]
    assert run(spark, rows, entries=entries) == brute(rows, 4, entries, 4)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f32(rng, 8, 5e4), 0) for i in range(30)]
    assert run(spark, rows, entries=5) == brute(rows, 4, 5, 4)
    assert run(spark, [(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0)], entries=1, rounds=0)[1][2] == 8 * (2 * codebooks.LIMIT) ** 2


def test_few_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 2)]) == []
    one = run(spark, [(9, [1.0, 2.0, 3.0, 4.0], None)])
    assert one[0][:4] == (9, "00000000", 0, 0)


def test_the_first_of_equal_entries():
    x = np.array([[0, 0], [4, 4]])
    assert nearest(x, np.array([[1, 1], [1, 1], [-1, -1]]))[0].tolist() == [0, 0]


def test_entries_must_fit_a_byte(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, [1.0] * 4, 0)], entries=257)

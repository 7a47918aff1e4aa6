import random
from collections import defaultdict

from mnemolake.llm import linededup as L
from mnemolake.llm.linededup import chunks, compared, strip


def brute(rows):
    """Texts that stay, by all chunks of all documents."""
    seen = defaultdict(set)
    for d, h, t in rows:
        for first, n, body in compared((t or "").encode().split(b"\n")):
            seen[body].add((d is not None, d, h, first))
    out = []
    for d, h, t in rows:
        lines = (t or "").split("\n")
        gone = [(first, n) for first, n, body in compared((t or "").encode().split(b"\n")) if len(seen[body]) > 1 and (d is not None, d, h, first) != min(seen[body], key=lambda x: (x[0], x[1] if x[1] is not None else 0, x[2], x[3]))]
        for first, n in reversed(gone):
            del lines[first : first + n]
        out.append((d, len((t or "").split("\n")), gone, "\n".join(lines)))
    return out


def corpus():
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passages = [[line(9) for _ in range(8)] for _ in range(3)]
    long_line = line(70)
    out = []
    for i in range(60):
        own = [line(rng.randrange(1, 12)) for _ in range(rng.randrange(1, 9))]
        at = rng.randrange(len(own) + 1)
        if i % 2:
            own[at:at] = passages[i % 3]
        if i % 5 == 0:
            own.insert(rng.randrange(len(own) + 1), long_line)
        out.append((i, "\n".join(own)))
    out += [(100, None), (101, ""), (102, "\n\n\n"), (103, "x"), (None, "\n".join(passages[0])), (104, "same " * 60 + "\n" + "same " * 60), (105, "}\n}\n}\n}"), (106, "\n".join("é" * 9 + " b" * 5 for _ in range(2000))), (7, out[7][1])]
    return out, passages, long_line


def test_boundaries_resist_shifts():
    rows, passages, _ = corpus()
    base = [x.encode() for x in passages[0] * 3]
    shifted = [b"new line"] + base
    ends = {first + n for first, n in chunks(base)}
    moved = {first + n - 1 for first, n in chunks(shifted)}
    assert {e for e in ends if e > 1} == {e for e in moved if e > 1}
    assert sum(n for _, n in chunks(base)) == len(base)


def test_strip_equals_brute_force(spark):
    rows, passages, long_line = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, first string").repartition(5)
    named = [(r["doc_id"], r["text_hash"], r["text"]) for r in L._listed(df).collect()]
    got = [(r["doc_id"], r["n_lines"], [(x["first"], x["lines"]) for x in r["removed"]], r["text"]) for r in strip(df).collect()]
    assert sorted(got, key=str) == sorted(brute(named), key=str)
    assert sum(long_line in r[3] for r in got) == 1
    assert sum(len(r[2]) > 0 for r in got) > 20


def test_no_rows(spark):
    assert strip(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import random

from mnemolake.llm import linededup as L


def least_runs(lines):
    """(first, lines, run) of the least runs of LONG_LINE words from each line and up to each line, by trying all."""
    n = [len(x.split()) for x in lines]
    every = [(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1) if sum(n[i:j]) >= L.LONG_LINE]
    return sorted({(i, j - i, tuple(lines[i:j])) for i, j in every if (i, j) == min(x for x in every if x[0] == i) or (i, j) == max(x for x in every if x[1] == j)})


def planted(seed=11):
    """200 documents, 120 of them with one of 20 passages of 2 to 5 lines and 60 to 90 words."""
    rng = random.Random(seed)
    line = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    passages = [[line(rng.randrange(60, 91) // n + 1) for _ in range(n)] for n in [2, 3, 4, 5] * 5]
    out = []
    for i in range(200):
        own = [line(rng.randrange(3, 20)) for _ in range(rng.randrange(2, 7))]
        at = rng.randrange(len(own) + 1)
        if i < 120:
            own[at:at] = passages[i % 20]
        out.append((i, own, (at, passages[i % 20]) if i < 120 else None))
    return out, passages


def stripped(spark, rows):
    df = spark.createDataFrame([(d, "\n".join(lines)) for d, lines in rows], "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["text"] for r in L.strip(df, whole_runs=True).collect()}


def test_planted_passages_go_whole(spark):
    rows, passages = planted()
    got = stripped(spark, [r[:2] for r in rows])
    for i, own, _ in rows:
        kept = own if i < 20 or i >= 120 else [x for x in own if x not in passages[i % 20]]
        assert got[i] == "\n".join(kept)


def test_runs_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"p{k}" for _ in range(rng.randrange(0, 30))) for k in range(12)]
    rows = [(i, [rng.choice(pool) for _ in range(rng.randrange(1, 14))]) for i in range(80)]
    rows += [(90, ["same words here again in ten words or so now"] * 30)]
    df = spark.createDataFrame([(d, "\n".join(x)) for d, x in rows], "doc_id long, text string")
    hashes = {r["doc_id"]: r["text_hash"] for r in L._listed(df).collect()}
    places = {}
    for d, lines in rows:
        spans = {(f, n, run) for f, n, run in least_runs(lines)} | {(f, n, tuple(lines[f : f + n])) for f, n, _ in L.compared([x.encode() for x in lines])}
        for f, n, run in spans:
            places.setdefault(run, []).append((d, hashes[d], f, n))
    gone = {d: set() for d, _ in rows}
    for found in places.values():
        d0, _, f0, n0 = min(found)
        for d, _, f, n in found:
            if d != d0 or f >= f0 + n0:
                gone[d].update(range(f, f + n))
    want = {d: "\n".join(x for k, x in enumerate(lines) if k not in gone[d]) for d, lines in rows}
    assert stripped(spark, rows) == want
    assert sum(map(len, gone.values())) > 50

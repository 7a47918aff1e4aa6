import re
from collections import Counter

from mnemolake.llm import licenses as L
from mnemolake.llm.licenses import op9_licenses, scan

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return PATTERN.findall((text or "").translate(lower))


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def brute(texts):
    files = [split(t) for t in texts]
    df = Counter(w for ws in files for w in set(ws) & set(L.VOCABULARY))
    order = sorted(L.VOCABULARY, key=lambda w: (df[w], w))
    out = []
    for ws in files:
        found = sorted((s, label) for p, label in L.BASE_PHRASES.items() for s in places(ws, p))
        held = set(ws)
        rare = set([w for w in order if w in held][: L.RARE])
        labels, share = {label for _, label in found}, 0.5 if found else 0.0
        for k, (label, text, keys) in enumerate(L.TEMPLATES):
            posts = [p for p in L.POSTINGS if p.template == k]
            shifts = Counter(i - p.at for i, w in enumerate(ws) if w in rare for p in posts if p.word == w)
            most = max(shifts.values(), default=0)
            if most >= L.AGREEING and all(places(ws, x) for x in keys):
                labels.add(label)
                share = max(share, min(1.0, most / min(L.RARE, len(posts))))
        out.append((len(ws), found, sorted({x for _, x in found}), sorted(labels), share))
    return out


CASES = [
    None, "", "x", "Released under the MIT License.", "MIT\nlicense; mit-license MIT licence", "licensed under the Apache License, Version 2.0 and the GNU General Public License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "hereby granted free",
    "Licensed under CC BY-NC 4.0.", "cc by sa 4.0 licensed under", "Été MITé license générale", "mit license " * 3000, "word " * 60000 + "general public license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MİT license", "public general license", "Released under the MIT License.",
]


def test_scan_equals_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id long, text string, labels string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], [(p["start"], p["label"]) for p in r["places"]], r["base_labels"], r["labels"], r["score"]) for r in scan(df).collect()}
    assert [got[i] for i in range(len(CASES))] == brute(CASES)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in op9_licenses(spark, sf).collect()}
    for r, (n, found, base, labels, score) in zip(rows, brute([r["text"] for r in rows]), strict=True):
        g, starts = got[r["doc_id"]], [s for s, _ in found]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (n, len(found), min(starts, default=None), max(starts, default=None))
        assert (g["base_labels"], g["labels"], g["score"]) == (",".join(base), ",".join(labels), score)


def test_no_rows(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0

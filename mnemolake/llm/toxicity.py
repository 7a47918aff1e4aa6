"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import documents, in_chunks, in_fold, small_batches, table

#: Subsequences have four letters within six; each letter skipped costs a factor of DECAY.
LENGTH, WINDOW, DECAY = 4, 6, 0.5
#: Documents learned from, at most: (toxic, other).
SAMPLE = (800, 2400)
#: Landmark tokens: (most telling of toxic documents, drawn from the others).
LANDMARKS = (48, 24)
#: Weight of the machine's squared norm against its errors.
HOLD = 10.0
#: Weight of a telling token spoilt by one more letter; each is a positive example too.
SPOILT = 8.0
#: Codes in all; the last one stands before a token's first letter, so that how words begin counts.
ALPHABET = 41
BEGIN = ALPHABET - 1
#: Letters by code: a-z 1 to 26 in either case, digits used as letters, UTF-8 continuation bytes 27 to 39.
#: 0: no letter. An accented capital and its small form end in bytes 32 apart and share a code.
CODES = np.zeros(256, dtype=np.int32)
CODES[97:123] = CODES[65:91] = np.arange(1, 27)
for _digit, _letter in zip(b"013457", b"oieast", strict=True):
    CODES[_digit] = CODES[_letter]
CODES[128:192] = 27 + (np.arange(128, 192) & 31) % 13
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
#: (last letter's distance, distances of the two between, weight)
_SHAPES = [(span, a, b, DECAY ** (span - LENGTH + 1)) for span in range(LENGTH - 1, WINDOW) for a, b in combinations(range(1, span), LENGTH - 2)]



def size_of(letters_in_token: np.ndarray) -> np.ndarray:
    """What a token's kernel values are divided by: the root of its subsequences' squared weights, each counted by itself."""
    n = np.asarray(letters_in_token)
    total = sum(np.maximum(0, n - span) * weight**2 for span, _, _, weight in _SHAPES)
    return np.sqrt(np.where(total > 0, total, 1.0))


class Letters(NamedTuple):
    """Letters of texts in order: code, token, sentence; per sentence its text."""

    code: np.ndarray
    token: np.ndarray
    sentence: np.ndarray
    text: np.ndarray


def letters(texts: list[bytes]) -> Letters:
    """Tokens end at white space, sentences at line ends and at . ! ? before white space.

    Signs inside a token are passed over, and tokens of one letter join with their like, so that a word
    split by signs or spaces is one token again.
    """
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    code, space = CODES[buf], _SPACE[buf]
    stop = (buf == 10) | np.concatenate(([False], _STOP[buf[:-1]] & space[1:])) if buf.size else np.zeros(0, bool)
    at = np.flatnonzero(code)
    if not at.size:
        return Letters(*[np.zeros(0, np.int64)] * 4)
    sentence = np.cumsum(stop)[at]
    sentence = np.cumsum(np.concatenate(([0], sentence[1:] != sentence[:-1])))
    token = np.cumsum(space)[at]
    first = np.concatenate(([True], token[1:] != token[:-1]))
    begin = np.flatnonzero(first)
    single = np.diff(np.append(begin, at.size)) == 1
    joins = np.concatenate(([False], single[1:] & single[:-1])) & (np.concatenate(([-1], sentence[begin[:-1]])) == sentence[begin])
    first[begin[joins]] = False
    starts = np.cumsum(np.array([0] + [len(t) + 1 for t in texts[:-1]], dtype=np.int64))
    heads = at[np.concatenate(([True], sentence[1:] != sentence[:-1]))]
    begin, token = np.flatnonzero(first), np.cumsum(first) - 1
    code, sentence, token = np.insert(code[at], begin, BEGIN), np.insert(sentence, begin, sentence[begin]), np.insert(token, begin, token[begin])
    return Letters(code, token, sentence, np.searchsorted(starts, heads, side="right") - 1)


def subsequences(x: Letters) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Per shape: places of first letters, subsequence numbers, weight. No subsequence leaves its token."""
    last = -1
    for span, a, b, weight in _SHAPES:
        if span != last:
            place = np.flatnonzero(x.token[:-span] == x.token[span:]) if len(x.token) > span else np.zeros(0, np.int64)
            ends, last = x.code[place] * ALPHABET**3 + x.code[place + span], span
        yield place, ends + x.code[place + a] * ALPHABET**2 + x.code[place + b] * ALPHABET, weight


class Model(NamedTuple):
    """Weights of the subsequences that landmarks hold, the machine's bias, and the logistic's slopes and offset.

    slopes: by a text's highest margin and by how dense its toxic tokens stand (0 where density tells nothing more).
    """

    features: np.ndarray
    weights: np.ndarray
    bias: float
    slopes: tuple[float, float]
    offset: float

    def chance(self, told: np.ndarray) -> np.ndarray:
        """Chance that a text is toxic, from `signs`."""
        return 1 / (1 + np.exp(-np.clip(told @ np.array(self.slopes) + self.offset, -500, 500)))


def signs(texts: list[bytes], table_: np.ndarray, bias: float) -> np.ndarray:
    """Per text: the highest margin of its tokens, and the logarithm of its share of tokens with a margin above 0.

    The machine's function of a token, times the token's size, is linear in its subsequences: landmark by landmark,
    kernel values times coefficients add up to one weight per subsequence. A sentence is as toxic as its most toxic token,
    and a text as its most toxic sentence; sums would let long or repetitive sentences add up to an insult. Half a token more and
    twenty others keep the share of short texts in bounds. A text without letters has the empty token's margin.
    """
    best, hits, tokens = np.full(len(texts), bias, np.float64), np.zeros(len(texts)), np.zeros(len(texts))
    for first, part in in_chunks(texts):
        x = letters(part)
        score = np.zeros(len(x.code), np.float64)
        for place, number, weight in subsequences(x):
            score[place] += weight * table_[number]
        if len(x.code):
            heads = np.flatnonzero(np.concatenate(([True], x.token[1:] != x.token[:-1])))
            margin = np.add.reduceat(score, heads) / size_of(np.diff(np.append(heads, len(x.code)))) + bias
            own = first + x.text[x.sentence[heads]]
            np.maximum.at(best, own, margin)
            hits += np.bincount(own, margin > 0, minlength=len(texts))
            tokens += np.bincount(own, minlength=len(texts))
    return np.stack([best, np.log((hits + 0.5) / (tokens + 20.0))], 1)


def margins(texts: list[bytes], table_: np.ndarray, bias: float) -> np.ndarray:
    """Highest margin of each text's tokens."""
    return signs(texts, table_, bias)[:, 0]


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rows: int = 20_000) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps on its active rows; last weight: bias, hardly held back."""
    n = x.shape[1] + 1
    hold = np.full(n, HOLD)
    hold[-1] = 1e-3
    w = np.zeros(n)
    for _ in range(40):
        left, right = np.diag(hold), np.zeros(n)
        for at in range(0, len(x), rows):
            part = np.hstack([x[at : at + rows], np.ones((len(x[at : at + rows]), 1))])
            active = y[at : at + rows] * (part @ w) < 1
            held = part[active] * cost[at : at + rows][active, None]
            left += held.T @ part[active]
            right += held.T @ y[at : at + rows][active]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, rtol=1e-6, atol=1e-8):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and offset by Newton steps on smoothed labels, so that separable margins end too."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, z @ w).sum() - t @ (z @ w) + 1e-3 * w @ w
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 2e-3 * np.eye(len(w)), z.T @ (p - t) + 2e-3 * w)
        while loss(w - step) > loss(w) + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(told: np.ndarray, toxic: np.ndarray, spoilt: np.ndarray) -> tuple[tuple[float, float], float]:
    """Slopes and offset of the logistic over texts' signs; spoilt: margins of spoilt insults, which are toxic too.

    The highest margin decides alone unless density takes a quarter off the errors on the texts learned from: where
    insults are made of a language's own morphemes, one such token says little, and many of them much.
    """
    one = _logistic(np.concatenate([told[:, 0], spoilt])[:, None], np.concatenate([toxic, np.ones(len(spoilt), bool)]).astype(float))
    alone, both = _logistic(told[:, :1], toxic.astype(float)), _logistic(told, toxic.astype(float))
    wrong = [int((((told[:, : len(w) - 1] @ w[:-1] + w[-1]) >= 0) != toxic).sum()) for w in (alone, both)]
    if wrong[1] <= 0.75 * wrong[0] and wrong[0] - wrong[1] >= 20 and (both[:2] > 0).all():
        return (float(both[0]), float(both[1])), float(both[2])
    return (float(one[0]), 0.0), float(one[1])


def fit(texts: list[bytes], toxic: np.ndarray, seed: int = 11) -> Model:
    """A machine from the labelled sentences of texts.

    Sentences carry their text's label. Every token of a clean sentence is a negative example. A toxic text need have
    but one toxic token: at first the telling ones are positive, then, three times, those that the machine so far
    finds toxic, or nearly so and more than all others of the text, unless clean sentences often have them too. A token's features are its
    kernel values with the landmarks, times the inverse root of the landmarks' own.
    """
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), 0.0, (0.0, 0.0), -4.0 if not toxic.any() else 4.0)
    if not len(texts) or toxic.all() or not toxic.any():
        return nothing
    number_of: dict[bytes, int] = {}
    parts = []
    for first, part in in_chunks(texts):
        x = letters(part)
        begin = np.flatnonzero(np.concatenate(([True], x.token[1:] != x.token[:-1]))) if len(x.code) else np.zeros(0, np.int64)
        raw, ends = x.code.astype(np.uint8).tobytes(), np.append(begin[1:], len(x.code))
        numbers = [number_of.setdefault(raw[a:b], len(number_of)) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
        parts.append(np.stack([np.array(numbers, np.int64), first + x.text[x.sentence[begin]]], 1))
    # Each token and document once; documents of either kind that hold a token.
    token, owner = np.unique(np.concatenate(parts), axis=0).T
    docs_of = [np.bincount(token[toxic[owner] == kind], minlength=len(number_of)) for kind in (False, True)]
    words = list(number_of)
    held = [{w: int(docs_of[kind][k]) for k, w in enumerate(words) if docs_of[kind][k] and len(w) >= LENGTH} for kind in (0, 1)]
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    # Telling: among toxic documents far more often than by chance (Chernoff's bound, for as many tokens as there are).
    base, odds = n1 / (n1 + n0), {}
    for w, n in held[1].items():
        other = held[0].get(w, 0)
        part = n / (n + other)
        if part > 0.8:
            bound = n * np.log(part / base) + other * np.log(max(1e-12, 1 - part) / (1 - base))
            if bound > np.log(len(held[1])) + 2 or n1 + n0 < 20:
                odds[w] = n
    telling = sorted(odds, key=lambda w: (-odds[w], w))[: LANDMARKS[0]]
    marked = set(telling)
    rest = sorted(w for w in held[0] if w not in marked)
    rng = np.random.default_rng(seed)
    drawn = [rest[i] for i in rng.permutation(len(rest))[: LANDMARKS[1]]]
    marks = telling + drawn
    if not telling:
        return nothing._replace(offset=float(np.log(n1 / n0)))
    # Landmarks' subsequences: rows of a; their products are the kernel between landmarks.
    m = Letters(np.frombuffer(b"".join(marks), np.uint8).astype(np.int32), np.repeat(np.arange(len(marks)), [len(w) for w in marks]), np.zeros(0), np.zeros(0))
    entries = [(number, m.token[place], weight) for place, number, weight in subsequences(m)]
    features = np.unique(np.concatenate([e[0] for e in entries]))
    a = np.zeros((len(features), len(marks)))
    for number, mark, weight in entries:
        np.add.at(a, (np.searchsorted(features, number), mark), weight)
    a /= size_of(np.array([len(w) for w in marks]))
    value, vector = np.linalg.eigh(a.T @ a)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    project = a @ root
    # Features of distinct tokens, a block of subsequences at a time.
    spoilt = [w[:k] + bytes([x]) + w[k:] for w in telling for k, x in enumerate(rng.integers(1, 27, len(w))) if k > 1]
    spoilt = [w for w in dict.fromkeys(spoilt) if w not in number_of]
    number_of |= {w: len(number_of) + k for k, w in enumerate(spoilt)}
    distinct = list(number_of)
    x_ = np.zeros((len(distinct), project.shape[1]), np.float32)
    index = np.full(ALPHABET**LENGTH, -1, np.int32)
    index[features] = np.arange(len(features))
    for at in range(0, len(distinct), 20_000):
        part = distinct[at : at + 20_000]
        u = Letters(np.frombuffer(b"".join(part), np.uint8).astype(np.int32), np.repeat(np.arange(at, at + len(part)), [len(w) for w in part]), np.zeros(0), np.zeros(0))
        for place, number, weight in subsequences(u):
            row = index[number]
            own, row = u.token[place[row >= 0]], row[row >= 0]
            for k in range(0, len(row), 20_000):
                first = np.flatnonzero(np.concatenate(([True], own[k + 1 : k + 20_000] != own[k : k + 20_000][:-1])))
                x_[own[k : k + 20_000][first]] += weight * np.add.reduceat(project[row[k : k + 20_000]], first, axis=0)
    x_ /= size_of(np.array([len(w) for w in distinct]))[:, None].astype(np.float32)
    docs_of = [np.append(n, np.zeros(len(spoilt))) for n in docs_of]
    chosen = np.isin(np.arange(len(distinct)), [number_of[w] for w in telling])
    chosen[len(distinct) - len(spoilt) :] = True
    for _ in range(4):
        if not chosen.any() or chosen.all():
            return nothing._replace(offset=float(np.log(n1 / n0)))
        y = np.where(chosen, 1.0, -1.0)
        # A token of many documents weighs more, to a limit.
        cost = np.minimum(20.0, np.where(chosen, docs_of[1], docs_of[0] + 0.2 * docs_of[1]))
        cost[len(distinct) - len(spoilt) :] = SPOILT
        cost[chosen] *= min(5.0, max(1.0, cost[~chosen].sum() / cost[chosen].sum()))
        w = _machine(x_, y, cost)
        f = x_ @ w[:-1] + w[-1]
        best = np.full(len(texts), w[-1])
        np.maximum.at(best, owner, f[token])
        top = np.zeros(len(distinct), dtype=bool)
        top[token[(f[token] == best[owner]) & (best[owner] > -0.5)]] = True
        chosen = (docs_of[0] < 0.25 * docs_of[1]) & ((f > 0) | top)
        chosen[len(distinct) - len(spoilt) :] = True
    weights, bias = project @ w[:-1], float(w[-1])
    dense = np.zeros(ALPHABET**LENGTH, np.float32)
    dense[features] = weights
    slopes, offset = calibrate(signs(texts, dense, bias), toxic, f[len(distinct) - len(spoilt) :])
    return Model(features, weights, bias, slopes, offset)


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """A machine from at most `sample` toxic and other documents, drawn by a hash of doc_id.

    labels: doc_id and toxic (0 or 1); rows with a null in either are passed over, of repeated ones the larger counts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64("doc_id", F.lit(23))
    ids = known.filter("toxic = 1").orderBy(draw, "doc_id").limit(sample[0]).unionByName(known.filter("toxic = 0").orderBy(draw, "doc_id").limit(sample[1]))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").toArrow()  # ids: a few thousand at most
    texts = [(t or "").encode() for t in rows.column("text").to_pylist()]
    return fit(texts, rows.column("toxic").to_numpy() > 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxicity (0 to 1; 0.5 or more: toxic) put after their own, replacing one of that name.

    A text scores as its most toxic sentence, and where training shows that it tells more, by how dense its toxic tokens
    stand; null and empty texts and texts without letters score as an empty one does. Only the text is looked at, so
    repeated rows score alike. A very long text is worked on alone, in memory of some hundred times its bytes; no rows give no rows.
    """
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    dense: list[np.ndarray] = []

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        if not dense:
            dense.append(np.zeros(ALPHABET**LENGTH, np.float32))
            dense[0][m.features] = m.weights
        for texts in parts:
            yield pd.Series(m.chance(signs([t.encode() if isinstance(t, str) else b"" for t in texts], dense[0], m.bias)))

    return docs.withColumn("toxicity", rate.asNondeterministic()(F.col("text")))  # evaluated once, whatever uses it


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    held_out = in_fold(F.col("doc_id"), 5, 0)
    model = learn(docs.filter(~held_out), labels.filter(~held_out))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))

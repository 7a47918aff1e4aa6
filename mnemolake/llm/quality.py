"""Quality classifier: a weak-label model over heuristics, and a hashed linear scorer trained on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import documents, in_chunks, mix, small_batches, word_hashes

#: Buckets of hashed features.
BUCKETS = 1 << 16
#: Documents that the scorer is fitted on, at most.
SAMPLE = 3000
#: A labeller's bad votes among its votes on good documents, at most.
FALSE_ALARMS = 1e-3
LABELLERS = ("symbols", "capitals", "variety", "commonest", "shouting", "repeated_lines", "length", "word_length", "sentences")

_CLASS = np.zeros((6, 256), dtype=np.float64)
_CLASS[0, [*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = 1  # letters, one for each character
_CLASS[1, 65:91] = 1
_CLASS[2, list(b"#$%&*|@^~<>{}[]\\/=+_`")] = 1
_CLASS[3, list(b"!")] = 1
_CLASS[4, list(b".?!")] = 1
_CLASS[5, [*range(33, 128), *range(0xC2, 0xF5)]] = 1  # visible characters


def measures(texts: list[bytes]) -> np.ndarray:
    """Per text: words, and the shares that the labellers judge by (columns as in LABELLERS, from `symbols` on)."""
    out = np.zeros((len(texts), 1 + len(LABELLERS)))
    for first, part in in_chunks(texts):
        n, m = len(part), np.zeros((len(part), 6))
        buf = np.frombuffer(b"\n".join(part), np.uint8)
        begin = np.cumsum(np.array([0] + [len(t) + 1 for t in part[:-1]], dtype=np.int64))
        if buf.size:
            for k in range(6):
                total = np.concatenate(([0.0], np.cumsum(_CLASS[k][buf])))
                m[:, k] = total[begin + [len(t) for t in part]] - total[begin]
        words, at = word_hashes(part)
        count = np.bincount(at, minlength=n).astype(float)
        order = np.lexsort((words, at))
        new = np.concatenate(([True], (words[order][1:] != words[order][:-1]) | (at[order][1:] != at[order][:-1]))) if len(words) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        distinct = np.bincount(at[order][heads], minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, at[order][heads], np.diff(np.append(heads, len(words))))
        lines = [t.split(b"\n") for t in part]
        held = [[x for x in ls if x.strip()] for ls in lines]
        one, letters_ = np.maximum(count, 1), np.maximum(m[:, 0], 1)
        o = out[first : first + n]
        o[:, 0] = count
        o[:, 1] = m[:, 2] / np.maximum(m[:, 5], 1)
        o[:, 2] = m[:, 1] / letters_
        # Share of new words falls as texts get longer, however good: it is set against the root of their number.
        o[:, 3] = distinct / np.sqrt(one)
        o[:, 4] = most / one
        o[:, 5] = m[:, 3] / one
        o[:, 6] = [1 - len(set(h)) / len(h) if h else 0.0 for h in held]
        o[:, 7] = count
        o[:, 8] = m[:, 0] / one
        o[:, 9] = m[:, 4] / one
    return out


def votes(m: np.ndarray) -> np.ndarray:
    """Votes of the labellers by document: 1 good, -1 bad, 0 no opinion."""
    words, enough = m[:, 0], m[:, 0] >= 30

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, -1, np.where(good, 1, 0))

    return np.stack([
        vote(m[:, 1] > 0.1, m[:, 1] < 0.02),
        vote(m[:, 2] > 0.4, m[:, 2] < 0.2),
        np.where(enough, vote(m[:, 3] < 1.0, m[:, 3] > 2.5), 0),
        np.where(enough, vote(m[:, 4] > 0.3, m[:, 4] < 0.15), 0),
        vote(m[:, 5] > 0.25, m[:, 5] < 0.05),
        vote(m[:, 6] > 0.5, m[:, 6] < 0.2),
        vote(words < 1, words >= 20),
        vote((m[:, 8] < 2) | (m[:, 8] > 15), (m[:, 8] > 3) & (m[:, 8] < 10)),
        np.where(enough, vote(m[:, 9] < 0.005, (m[:, 9] > 0.02) & (m[:, 9] < 0.34)), 0),
    ], 1).astype(np.int8)


class LabelModel(NamedTuple):
    """prior of good; chances[j, y]: how often labeller j, where it has an opinion, votes good on class y (0 bad, 1 good)."""

    prior: float
    chances: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        gain = np.log(self.chances[:, 1] / self.chances[:, 0])
        loss = np.log((1 - self.chances[:, 1]) / (1 - self.chances[:, 0]))
        log = np.log(self.prior / (1 - self.prior)) + (v == 1) @ gain + (v == -1) @ loss
        return 1 / (1 + np.exp(-np.clip(log, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Share of a labeller's votes that are right, by labeller, on bad and on good documents."""
        return np.stack([1 - self.chances[:, 0], self.chances[:, 1]], 1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many documents have each.

    Votes are taken as independent given the class, and having no opinion as saying nothing. The start calls a
    document bad if any labeller does, which tells the classes apart; counts are smoothed by one. Labellers are
    made to be precise rather than complete, and the model holds them to it: on good documents they vote bad with a
    chance of at most FALSE_ALARMS, and good no less often than on bad ones. Without that bound a kind of bad document
    that only one labeller knows would be taken for that labeller's mistakes.
    """
    v, n = patterns.astype(np.int64), counts.astype(float)
    q = np.where((v == -1).any(1), 0.05, 0.95)
    good, bad = (v == 1).T.astype(float), (v == -1).T.astype(float)
    for _ in range(rounds):
        right = np.maximum((good @ (n * q) + 1) / ((good + bad) @ (n * q) + 2), 1 - FALSE_ALARMS)
        wrong = (good @ (n * (1 - q)) + 1) / ((good + bad) @ (n * (1 - q)) + 2)
        model = LabelModel(float((n @ q + 1) / (n.sum() + 2)), np.stack([np.minimum(wrong, right), right], 1))
        new = model.posterior(v)
        if np.abs(new - q).max(initial=0) < 1e-7:
            break
        q = new
    return model


def features(texts: list[bytes], m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of hashed features.

    Overlapping four-byte pieces share a weight of one; each measure, cut to eight steps, has a third of one.
    """
    rows, cols, vals = [], [], []
    for first, part in in_chunks(texts):
        buf = np.frombuffer(b"\n".join(part), np.uint8).astype(np.uint64)
        size = np.array([len(t) for t in part])
        begin = np.cumsum(size + 1) - size - 1
        count = np.maximum(size - 3, 0)
        at = np.repeat(np.arange(len(part)), count)
        place = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        gram = buf[place] | buf[place + 1] << np.uint64(8) | buf[place + 2] << np.uint64(16) | buf[place + 3] << np.uint64(24) if len(place) else np.zeros(0, np.uint64)
        rows.append(first + at), cols.append((mix(gram) % np.uint64(BUCKETS)).astype(np.int32)), vals.append(1.0 / np.maximum(count, 1)[at])
    edges = np.array([[0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4], [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6], [0.5, 1, 1.5, 2, 2.5, 4, 8], [0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8], [0.005, 0.02, 0.05, 0.1, 0.25, 0.5, 0.9], [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9], [1, 5, 10, 20, 50, 200, 1000], [1, 2, 3, 5, 8, 10, 15], [0.002, 0.005, 0.02, 0.05, 0.15, 0.34, 0.6]])
    for j in range(len(LABELLERS)):
        step = np.searchsorted(edges[j], m[:, j + 1]).astype(np.uint64)
        rows.append(np.arange(len(m))), cols.append((mix(np.uint64(0xFEED << 32 | j << 8) + step) % np.uint64(BUCKETS)).astype(np.int32)), vals.append(np.full(len(m), 1 / 3))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


def train(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, target: np.ndarray, steps: int = 150, hold: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic scorer on soft labels by Adam over the whole sample; the classes weigh alike."""
    w, b = np.zeros(BUCKETS), 0.0
    if not len(target):
        return w, b
    good, bad = max(1e-9, target.sum()), max(1e-9, (1 - target).sum())
    weight = target / good + (1 - target) / bad
    mean, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, vals * w[cols], minlength=len(target)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        # Soft labels: each document pulls towards good and bad by its posterior.
        g = p * weight - target / good
        grad = np.append(np.bincount(cols, vals * g[rows], minlength=BUCKETS) + hold * w, g.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        step = 0.2 * mean / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


class Model(NamedTuple):
    labels: LabelModel
    weights: np.ndarray
    bias: float


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in texts]


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Label model from the votes on all of docs, scorer from at most `sample` of them drawn by a hash of doc_id.

    Vote patterns are counted on executors; their number is bounded by the labellers' (three votes each). No given
    label is used.
    """

    @F.pandas_udf("string")
    def pattern(texts: pd.Series) -> pd.Series:
        return pd.Series(["".join("-0+"[x + 1] for x in v) for v in votes(measures(_encoded(texts)))])

    seen = docs.select(pattern("text").alias("pattern")).groupBy("pattern").count().collect()
    total = sum(r["count"] for r in seen)
    if not total:
        return Model(LabelModel(0.5, np.full((len(LABELLERS), 2), 0.5)), np.zeros(BUCKETS), 0.0)
    patterns = np.array([["-0+".index(x) - 1 for x in r["pattern"]] for r in seen])
    labels = estimate(patterns, np.array([r["count"] for r in seen]))
    space = 1 << 30
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(space)) < int(min(1.0, 1.2 * sample / total) * space))
    texts = [(t or "").encode() for t in drawn.select("doc_id", "text").orderBy(F.xxhash64("doc_id", F.lit(31)), "text").limit(sample).toArrow().column("text").to_pylist()]
    m = measures(texts)
    rows, cols, vals = features(texts, m)
    # Equal features of a text are added up, so that the sample stays small.
    key, inverse = np.unique(rows.astype(np.int64) * BUCKETS + cols, return_inverse=True)
    weights, bias = train(key // BUCKETS, key % BUCKETS, np.bincount(inverse, vals), labels.posterior(votes(m)))
    return Model(labels, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality (0 to 1 by the scorer), quality_label (the label model's posterior) and quality_votes.

    Columns so named are replaced. Null and empty texts count as empty texts; only the text is looked at, so repeated
    rows score alike; no rows give no rows.
    """
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<quality double, label double, votes string>")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labels, weights, bias = sent.value
        for series in parts:
            texts = _encoded(series)
            m = measures(texts)
            v = votes(m)
            z = np.full(len(texts), bias)
            for first, part in in_chunks(texts):
                rows, cols, vals = features(part, m[first : first + len(part)])
                z[first : first + len(part)] += np.bincount(rows, vals * weights[cols], minlength=len(part))
            yield pd.DataFrame({"quality": 1 / (1 + np.exp(-np.clip(z, -500, 500))), "label": labels.posterior(v), "votes": ["".join("-0+"[x + 1] for x in row) for row in v]})

    got = docs.withColumn("__rated", rate.asNondeterministic()("text"))  # evaluated once, whatever uses it
    return got.withColumns({"quality": F.col("__rated.quality"), "quality_label": F.col("__rated.label"), "quality_votes": F.col("__rated.votes")}).drop("__rated")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, learn(docs)).select("doc_id", F.col("quality").alias("score"), (F.col("quality") >= 0.5).alias("keep"), F.col("quality_label").alias("label_posterior"), F.col("quality_votes").alias("votes"))

"""Language identification by prediction by partial matching over byte contexts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import documents, in_chunks, in_fold, mix, released, small_batches, utf8, word_hashes

#: Longest context, in bytes. Contexts start anew at each word: ' ' + word + ' ' is coded from its second byte on.
ORDER = 4
#: Documents learned from in each language, at most.
SAMPLE = 1000
_SPACE = 32
#: Runs of letters: ASCII letters, lower-cased, and non-ASCII bytes.
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[65:91] = _LETTER[97:123] = np.arange(97, 123, dtype=np.uint8)
_LETTER[128:] = np.arange(128, 256, dtype=np.uint8)


def letter_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes (0 between words), begin and end of each word, and the text it is in."""
    buf = _LETTER[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], buf > 0, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    begin = np.cumsum(np.array([0] + [len(t) + 1 for t in texts[:-1]], dtype=np.int64))
    return buf, start, end, np.searchsorted(begin, start, side="right") - 1


def _framed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a space on either side, one after the other; place in the word, and word, of each byte."""
    size = end - start + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) - first[word]
    inner = (place > 0) & (place < size[word] - 1)
    out = np.full(len(word), _SPACE, np.uint8)
    out[inner] = buf[(start[word] + place - 1)[inner]]
    return out, place, word


def _grams(b: np.ndarray, order: int) -> np.ndarray:
    """Per byte: itself and the `order` bytes before it, packed without loss, with the order on top."""
    key = np.full(len(b), order, np.uint64) << np.uint64(56)
    for d in range(order + 1):
        key[d:] |= b[: len(b) - d].astype(np.uint64) << np.uint64(8 * d)
    return key


class Table:
    """uint64 keys to rows of float32, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys))).bit_length())
        self.slot = np.full((1 << self.bits) + 64, -1, np.int32)
        self.keys, self.rows = keys, rows
        todo, at = np.arange(len(keys)), (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of several keys for one slot the last one stays
            lost = self.slot[at] != todo
            todo, at = todo[lost], at[lost] + 1
            if len(at) and at.max() >= len(self.slot):
                self.slot = np.concatenate([self.slot, np.full(64, -1, np.int32)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for keys that aren't there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        todo, at = np.arange(len(keys)), (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            row = self.slot[np.minimum(at, len(self.slot) - 1)]
            row[at >= len(self.slot)] = -1
            hit = row >= 0
            same = hit & (self.keys[row] == keys[todo])
            out[todo[same]] = row[same]
            go = hit & ~same
            todo, at = todo[go], at[go] + 1
        return out


class Model(NamedTuple):
    """Frozen statistics of all languages.

    direct: per (context, byte) seen in any language, each language's whole code length in bits, escapes included.
    escape: per context seen in any language, each language's code length of an escape from it (0 where the
    language has not seen it: its tree then starts at a shorter context).
    """

    languages: list[str]
    direct: tuple[np.ndarray, np.ndarray]
    escape: tuple[np.ndarray, np.ndarray]


def train(languages: list[str], words: list[tuple[list[bytes], np.ndarray]], order: int = ORDER) -> Model:
    """Byte context trees up to `order` from each language's words and their counts.

    In a context with n bytes seen, of which d distinct, a byte seen c times has probability c / (n + d) and the
    escape d / (n + d) (method C, without exclusions); after the empty context all 256 bytes are alike.
    """
    seen: list[list[tuple]] = []  # by language and order: (context keys, context totals, context kinds), (gram keys, counts)
    for own, counts in words:
        joined = b"\n".join(own)
        buf = np.frombuffer(joined, np.uint8)
        size = np.array([len(w) for w in own], dtype=np.int64)
        start = np.cumsum(size + 1) - size - 1
        b, place, word = _framed(buf, start, start + size)
        levels = []
        for d in range(order + 1):
            ok = place >= max(d, 1)
            gram, inverse = np.unique(_grams(b, d)[ok], return_inverse=True)
            n = np.bincount(inverse, counts[word[ok]], minlength=len(gram))
            context, at = np.unique(gram >> np.uint64(8), return_inverse=True)
            levels.append((gram, n, context, np.bincount(at, n, minlength=len(context)), np.bincount(at, minlength=len(context)), at))
        seen.append(levels)
    # Per order: all languages' grams and contexts, then code lengths from the shortest context up.
    direct_keys, direct_rows, escape_keys, escape_rows = [], [], [], []
    shorter: tuple[np.ndarray, np.ndarray] | None = None
    for d in range(order + 1):
        grams = np.unique(np.concatenate([lv[d][0] for lv in seen]))
        contexts = np.unique(np.concatenate([lv[d][2] for lv in seen]))
        rows, escapes = np.zeros((len(grams), len(seen)), np.float32), np.zeros((len(contexts), len(seen)), np.float32)
        if shorter is None:
            base = np.full((len(grams), len(seen)), 8.0, np.float32)
        else:
            cut = grams & np.uint64((1 << 8 * d) - 1) | np.uint64(d - 1) << np.uint64(56)
            base = shorter[1][np.searchsorted(shorter[0], cut)]
        for k, levels in enumerate(seen):
            gram, n, context, total, kinds, at = levels[d]
            escapes[np.searchsorted(contexts, context), k] = -np.log2(kinds / (total + kinds))
            rows[:, k] = base[:, k] + escapes[np.searchsorted(contexts, grams >> np.uint64(8)), k]
            rows[np.searchsorted(grams, gram), k] = -np.log2(n / (total + kinds)[at])
        shorter = (grams, rows)
        direct_keys.append(grams), direct_rows.append(rows), escape_keys.append(contexts), escape_rows.append(escapes)
    return Model(languages, (np.concatenate(direct_keys), np.concatenate(direct_rows)), (np.concatenate(escape_keys), np.concatenate(escape_rows)))


class Coder:
    """Code lengths of texts under each language's frozen tree."""

    def __init__(self, model: Model, order: int = ORDER):
        self.order, self.k = order, len(model.languages)
        self.direct, self.escape = Table(*model.direct), Table(*model.escape)

    def words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bits of each word (its closing space included) by language."""
        b, place, word = _framed(buf, start, end)
        cost = np.zeros((len(b), self.k), np.float32)
        open_ = np.flatnonzero(place > 0)
        for d in range(self.order, -1, -1):
            here = open_[place[open_] >= d]
            keys = _grams(b, d)[here]
            row = self.direct.find(keys)
            got = row >= 0
            cost[here[got]] += self.direct.rows[row[got]]
            missed = here[~got]
            row = self.escape.find(keys[~got] >> np.uint64(8))
            cost[missed[row >= 0]] += self.escape.rows[row[row >= 0]]
            if d == 0:
                cost[missed] += 8.0
            open_ = np.concatenate([missed, open_[place[open_] < d]])
        return np.add.reduceat(cost, np.flatnonzero(place == 0), axis=0, dtype=np.float64) if len(b) else np.zeros((0, self.k))

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text by language. Every word is coded; equal words of a slice are coded once."""
        out = np.zeros((len(texts), self.k))
        for first, part in in_chunks(texts):
            buf, start, end, at = letter_runs(part)
            if not len(start):
                continue
            marked = np.where(buf > 0, buf, 10).tobytes()
            keys, _ = word_hashes([marked])
            _, one, inverse = np.unique(keys, return_index=True, return_inverse=True)
            bits = self.words(buf, start[one], end[one])[inverse]
            for k in range(self.k):
                out[first : first + len(part), k] += np.bincount(at, bits[:, k], minlength=len(part))
        return out


def learn(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER) -> Model:
    """Trees from at most `sample` documents of each language that have text and lang, drawn by a hash of doc_id.

    Executors count the sampled documents' words; the driver gets distinct words, which the sample bounds.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)), (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)))
    languages = sorted(sizes)
    rank = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    bound = F.lit(0.0)
    for lang in languages:
        bound = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / sizes[lang]) * (1 << 30))).otherwise(bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}
        for b in batches:
            texts = utf8(b.column(1))
            for lang, text in zip(b.column(0).to_pylist(), texts, strict=True):
                buf, start, end, _ = letter_runs([text])
                raw = buf.tobytes()
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    key = (lang, raw[s:e])
                    held[key] = held.get(key, 0) + 1
        yield pa.record_batch([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "n"])

    counted = known.filter(rank < bound).select("lang", "text").mapInArrow(released(count), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    lang, word, n = counted.column("lang").to_pylist(), counted.column("word").to_pylist(), counted.column("n").to_numpy()
    by: dict[str, list[int]] = {x: [] for x in languages}
    for k, x in enumerate(lang):
        by[x].append(k)
    languages = [x for x in languages if by[x]]
    return train(languages, [([word[k] for k in by[x]], n[by[x]].astype(np.float64)) for x in languages], order)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and lang_score put after their own columns.

    The language whose tree codes the text in the fewest bits, ties to the smaller name; the score is that
    language's posterior under equal priors. `und` with score 0 if the text is null or has no letter, or if there is
    nothing to compare with. Repeated rows get equal results. Only doc text goes to Python; columns named like the
    results are replaced.
    """
    small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    coder: list[Coder] = []

    def each(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        if not coder:
            coder.append(Coder(model))
        for texts in parts:
            bits = coder[0].texts([t.encode() if isinstance(t, str) else b"" for t in texts])
            if not model.languages:
                yield pd.DataFrame({"lang": ["und"] * len(texts), "score": [0.0] * len(texts)})
                continue
            best = bits.argmin(axis=1)
            gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
            yield pd.DataFrame({"lang": np.array(model.languages, dtype=object)[best], "score": 1.0 / np.exp2(-gap).sum(axis=1)})

    @F.pandas_udf("struct<lang string, score double>")
    def code(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(each)(parts)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # Not deterministic to the optimizer: it would else evaluate the coder once for each use of its result.
    got = docs.withColumn("__coded", code.asNondeterministic()(F.col("text")))
    return got.withColumns({"lang_pred": F.when(letters, F.col("__coded.lang")).otherwise(F.lit("und")), "lang_score": F.when(letters, F.col("__coded.score")).otherwise(F.lit(0.0))}).drop("__coded")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = learn(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

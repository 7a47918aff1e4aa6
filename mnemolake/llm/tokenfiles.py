"""Token ids as Parquet list columns in document order, laid out so that few pages are read for few tokens or for metadata alone."""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import _PLAIN_FILES, _file_system, documents, released, shared_dir

#: Pieces of text whose ids a worker keeps, at most, and the bytes of text that are encoded together.
KNOWN_PIECES, TOGETHER = 1 << 19, 1 << 22
#: Pieces that are given to the tokenizer as one text.
GROUP = 200
#: Bytes of a row group and of a page before compression, and rows of a page: what a selective read takes at least.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 64 << 10, 2_000


def layout(ids: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS) -> dict[str, str]:
    """Writer options: ids by `dictionary` or as `delta`s, all other numbers as deltas; row groups and pages of the given sizes.

    The writer adds column and offset indexes for pages; with them a filter on doc_id or start skips pages, not only row groups.
    """
    if ids not in ("dictionary", "delta"):
        raise ValueError(f"ids are encoded by dictionary or delta, not {ids}")
    return {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": str(ids == "dictionary").lower(),
        "parquet.block.size": str(row_group),
        "parquet.page.size": str(page),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }


class _Known(dict):
    """Numbers pieces in the order in which they are first asked for; `new` are those without ids yet."""

    def __init__(self, pieces: list[bytes]) -> None:
        super().__init__((p, n) for n, p in enumerate(pieces))
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b"!#$%&()*+,-./:;=?@[]^_{}~")] = True
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[[9, 10, 13]] = 32
_SMALL = _SPACED.copy()
_SMALL[65:91] += 32
#: Stands for the end of a text: no byte of UTF-8.
_END = b"\xff"


def split_pieces(buf: bytes) -> pa.DictionaryArray:
    """Pieces whose ids, one after the other, are the text's under a tokenizer that drops white space and case.

    Cut at white space, and between an ASCII letter and the signs after it that end a word, where such tokenizers cut in any case; A-Z become
    small unless a mark may follow that could make another letter of them. Text that may hold a special token stays as it is.
    """
    raw = np.frombuffer(buf, np.uint8)
    if b"<|" in buf:
        return _at_spaces(_SPACED[raw])
    low = _SMALL[raw]
    marked = np.flatnonzero(_UPPER[raw[:-1]] & (raw[1:] >= 0x80))
    low[marked] = raw[marked]
    sign = _SIGN[low]
    start = np.flatnonzero(sign[1:] & _LETTER[low[:-1]]) + 1
    stops = np.append(np.flatnonzero(~sign), low.size)
    stop = stops[np.searchsorted(stops, start)]
    whole = np.append(low, np.uint8(32))[stop] == 32
    return _at_spaces(np.insert(low, start[whole], 32))


def _at_spaces(text: np.ndarray) -> pa.DictionaryArray:
    one = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, text.size], np.int32)), pa.py_buffer(text)])
    return pc.split_pattern(one, b" ").flatten().dictionary_encode()


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in slices of about TOGETHER bytes, cut at single spaces, which are left out."""
    at = 0
    while len(text) - at > TOGETHER and (cut := text.find(b" ", at + TOGETHER)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class _Pieces:
    """Ids of texts by way of their pieces: the library encodes each distinct piece once while it is remembered.

    Remembered are at most KNOWN_PIECES (and what one call brings); beyond that those used only once since the last time are forgotten.
    """

    def __init__(self, tokenizer, end_id: int) -> None:
        self.tokenizer = tokenizer
        one = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        # A digit that is a token of its own between spaces marks where pieces given together end.
        self.mark = one("9")[0] if len(one("9")) == 1 and one("a 9 b 9 9 c") == [*one("a"), *one("9"), *one("b"), *one("9"), *one("9"), *one("c")] else None
        # What is one word to the tokenizer, whatever stands beside it, can be given to its model as it is.
        plain = [one(w) == [t.id for t in tokenizer.model.tokenize(w)] for w in ("a", "the", "tokenizers", "xqzjv")]
        self.model, self.word = tokenizer.model if all(plain) else None, re.compile("[a-z]+").fullmatch
        self.known, self.used = _Known([_END]), np.zeros(1, np.int32)
        self.ids, self.start, self.size = np.array([end_id], np.int32), np.zeros(1, np.int32), np.ones(1, np.int32)

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, and how many each has."""
        texts = [p.decode() for p in pieces]
        size = np.zeros(len(texts), np.int32)
        kind = np.array([0 if self.model and self.word(t) else 1 if self.mark is None or "9" in t or "<|" in t else 2 for t in texts], np.int8)
        words, own, rest = (np.flatnonzero(kind == k) for k in range(3))
        order = np.concatenate([words, own, rest])
        read = [[t.id for t in self.model.tokenize(texts[i])] for i in words]
        size[words] = [len(x) for x in read]
        found = [np.fromiter(itertools.chain.from_iterable(read), np.int32)]
        for at, e in zip(own, self.tokenizer.encode_batch([texts[i] for i in own], add_special_tokens=False), strict=True):
            found.append(np.array(e.ids, np.int32))
            size[at] = len(e.ids)
        groups = [rest[i : i + GROUP] for i in range(0, len(rest), GROUP)]
        joined = [" 9 ".join([*(texts[i] for i in g), ""]) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            ends = np.flatnonzero(ids == self.mark)
            size[g] = np.diff(ends, prepend=-1) - 1
            found.append(np.delete(ids, ends))
        # Back to the pieces' own order.
        begin = np.zeros(len(texts), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return _gather(np.concatenate(found), begin, size), size

    def __call__(self, pieces: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces in order, how many each has, and which are ends of texts."""
        distinct = pieces.dictionary.to_pylist()
        code = np.fromiter(map(self.known.__getitem__, distinct), np.int32, len(distinct))[pieces.indices.to_numpy()]
        if self.known.new:
            ids, size = self._encoded(self.known.new)
            self.known.new.clear()
            self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(size) - size).astype(np.int32)])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        used = np.bincount(code, minlength=len(self.known)).astype(np.int32)
        used[: len(self.used)] += self.used
        self.used = used
        size = self.size[code]
        out = _gather(self.ids, self.start[code], size)
        if len(self.known) > KNOWN_PIECES:
            self._forget()
        return out, size, code == 0

    def _forget(self) -> None:
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > KNOWN_PIECES // 2:
            keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")[: KNOWN_PIECES // 2]])
        keep = np.concatenate([[0], keep[keep > 0]])  # the end of texts stays number 0
        pieces = list(self.known)
        self.known = _Known([pieces[i] for i in keep])
        size = self.size[keep]
        self.ids, self.start, self.size = _gather(self.ids, self.start[keep], size), (np.cumsum(size) - size).astype(np.int32), size
        self.used = np.zeros(len(keep), np.int32)


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of every pair, one after the other."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


@lru_cache(maxsize=1)
def encoder(path: str, between_spaces: bool, end_id: int) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """Texts in UTF-8 to all their ids in one array, end_id after each text, and the number of each text's ids.

    between_spaces: the tokenizer drops white space and case and cuts at white space and between letters and signs, so that a piece has the same ids
    in every text (see `split_pieces`). Else whole texts are encoded. Ids are those the tokenizers library gives without special tokens.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if not between_spaces:

        def whole(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [[*e.ids, end_id] for e in tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in found)]), np.array([len(x) for x in found], np.int64)

        return whole

    ids_of = _Pieces(tokenizer, end_id)

    def by_pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, parts, held, open_text = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0, 0

        def flush() -> None:
            nonlocal parts, held, open_text
            got, size, last = ids_of(split_pieces(b" ".join(parts)))
            ids.append(got)
            total, ends = np.cumsum(size), np.flatnonzero(last)
            done = 0
            if len(ends):
                whole = np.diff(total[ends], prepend=0)
                whole[0] += open_text
                counts.append(whole)
                open_text, done = 0, total[ends[-1]]
            open_text += int(total[-1] - done)  # of a text that goes on
            parts, held = [], 0

        for text in texts:
            for part in _slices(text):
                parts.append(part)
                held += len(part) + 1
                if held > TOGETHER:
                    flush()
            parts.append(_END)
        if parts:
            flush()
        return np.concatenate(ids), np.concatenate(counts)

    return by_pieces


def write(docs: DataFrame, path: str, file: Callable[[], str], end_id: int, between_spaces: bool = False, options: dict[str, str] | None = None) -> None:
    """Writes ids of every text, end_id after each, in ascending order of doc_id to `path`.

    Two tables: `tokens` (part, doc_id, first, n_tokens, ids; one file for each part, a range of doc_ids, rows in order) and `parts`
    (part, base, docs, n_tokens; one row for each file). A document's ids start at base + first. file: called on each
    worker, gives the tokenizer file's place. doc_ids are long; null ones come first; rows with equal ones go by a hash of their text, equal
    rows by their place in the input, so ranges may cut through a repeated doc_id and a part holds no more than its share. Null and
    empty texts are the end id alone; very long texts are encoded whole, in slices, and are one row. No rows make no files of tokens. Other
    columns are ignored, whatever their names.
    """
    order = [F.asc("doc_id"), F.asc("tie"), F.asc("place")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made = encoder(file(), between_spaces, end_id), TaskContext.get().partitionId(), 0
        for b in batches:
            at, raw = 0, b.column(1).cast(pa.binary()).to_pylist()
            while at < b.num_rows:
                texts, first, held = [], at, 0
                while at < b.num_rows and (not texts or held < TOGETHER):
                    texts.append(raw[at] or b"")
                    held += len(texts[-1])
                    at += 1
                ids, size = encode(texts)
                ends = np.cumsum(size)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.record_batch([pa.array(np.full(len(texts), part, np.int32)), b.column(0).slice(first, len(texts)), pa.array(made + ends - size), pa.array(size), lists], ["part", "doc_id", "first", "n_tokens", "ids"])
                made += int(ends[-1])

    options = {**_PLAIN_FILES, **(options or layout())}
    rows.mapInArrow(released(run), "part int, doc_id long, first long, n_tokens long, ids array<int>").write.options(**options).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    sums = stored(spark, path).groupBy("part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("n_tokens"))
    base, total = [], 0
    for r in sums.orderBy("part").toLocalIterator():  # one row for each file
        base.append((r["part"], total, r["docs"], r["n_tokens"]))
        total += r["n_tokens"]
    spark.createDataFrame(base, _PARTS).coalesce(1).write.options(**_PLAIN_FILES).parquet(f"{path}/parts")


_PARTS = "part int, base long, docs long, n_tokens long"


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, first long, n_tokens long, ids array<int>").parquet(f"{path}/tokens")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; columns that are not asked for are not read, filters on doc_id skip pages."""
    parts = spark.read.schema(_PARTS).parquet(f"{path}/parts").select("part", "base")
    return stored(spark, path).join(parts, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """(doc_id, start, ids): the ids at begin <= position < end of the whole token sequence, by the documents that they belong to.

    Files outside are left out by `parts`, which has a row for each file; documents outside by `first` before ids are read.
    """
    parts = spark.read.schema(_PARTS).parquet(f"{path}/parts").filter((F.col("base") < end) & (F.col("base") + F.col("n_tokens") > begin))
    rows = None
    for r in parts.collect():  # the files that the span touches
        own = stored(spark, path).filter((F.col("part") == r["part"]) & (F.col("first") < end - r["base"]))
        own = own.select("doc_id", (F.lit(r["base"]) + F.col("first")).alias("start"), "n_tokens", "ids")
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return spark.createDataFrame([], "doc_id long, start long, ids array<int>")
    low, high = F.greatest("start", F.lit(begin)), F.least(F.col("start") + F.col("n_tokens"), F.lit(end))
    return rows.filter(low < high).select("doc_id", low.alias("start"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("ids"))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat, edge = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            edge = edge - edge[0]
            crc = pa.array([zlib.crc32(flat[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.int64())
            yield pa.record_batch([*b.columns[:3], crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def public_49k() -> str:
    """The public 49k vocabulary of words, as this machine has it."""
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path, public_49k, end_id=2, between_spaces=True)
    fs, place = _file_system(spark, path)
    fs.deleteOnExit(place)
    return checksums(read(spark, path))

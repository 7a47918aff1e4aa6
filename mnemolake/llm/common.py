"""Shared pieces of the training-data operators: input, the shared folder, batch hashing, bounded filters."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; null stays null."""
    return F.translate(c, UPPER, LOWER)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32(doc_id as text) mod folds is fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


#: What goes to a Python worker at once, at most (one longer text goes alone).
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(df: DataFrame) -> None:
    """Bounds the Arrow batches of df's session, unless it sets a smaller bound itself.

    The default lets 64 MB through at once; a worker holds several times a batch's bytes as work arrays.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over batches, giving freed memory back to the system at its end.

    Python workers stay for later tasks, and allocators keep what a task has freed: idle workers would hold it.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master may go without the setting; it then gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = f"file://{tempfile.mkdtemp(prefix='mnemolake-shared-')}"
    spark.sparkContext.setCheckpointDir(at)
    return at


_made = threading.local()
#: Intermediate tables need no checksum files beside them. On a local file system each file costs an executor one child process
#: in place of three (for its mode, its checksums' mode, and its mode again); other file systems don't look at these.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: cuts lineage, survives lost executors.

    The table goes with the `scratch` block that it is made in, without one with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**_PLAIN_FILES).parquet(path)
    fs, place = _file_system(spark, path)
    fs.deleteOnExit(place)
    if getattr(_made, "blocks", None):
        _made.blocks[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables materialized or held inside, but for those given to the function that it yields.

    These go on to the block around it, if there is one. What is returned from the block may read kept tables only.
    """
    blocks = _made.blocks = getattr(_made, "blocks", None) or []
    own: list[str] = []
    blocks.append(own)

    def keep(df: DataFrame) -> DataFrame:
        own.remove(df._stored_at)
        if len(blocks) > 1:
            blocks[-2].append(df._stored_at)
        return df

    try:
        yield keep
    finally:
        blocks.pop()
        for path in own:
            fs, place = _file_system(spark, path)
            fs.delete(place, True)


def discard(df: DataFrame) -> None:
    """Deletes a materialized table that nothing reads any more."""
    fs, place = _file_system(df.sparkSession, df._stored_at)
    fs.delete(place, True)


# --- joins with hot keys ---------------------------------------------------------

#: Keys that are dealt over several tasks, at most, and the rows that a key needs for that, at least.
HEAVY_KEYS, HEAVY_ROWS = 20_000, 256


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], deal: str, how: str = "inner") -> DataFrame:
    """left joined with right on keys; left's hot keys are dealt over tasks by a hash of the column `deal`.

    A key is hot if it has more than 1 / HEAVY_KEYS of left's rows, so there are fewer than HEAVY_KEYS of them whatever
    the input's size, and their list is safe to broadcast. right's rows of a hot key are copied to each of its parts; right
    should have few rows of a key. left is read three times: give a stored table.
    """
    keys = list(keys)
    share = max(HEAVY_ROWS, left.count() // HEAVY_KEYS)
    heavy = left.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > share).select(*keys, F.ceil(F.col("__n") / share).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = left.join(F.broadcast(heavy), keys, "left").withColumn("__part", F.pmod(F.xxhash64(deal), parts).cast("int")).drop("__parts")
    copied = right.join(F.broadcast(heavy), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copied, [*keys, "__part"], how).drop("__part")


# --- membership filters ------------------------------------------------------------

#: Bits of a filter for each key, at least, and its most bytes. More keys than MOST_KEYS get none: every row then meets in the join.
KEY_BITS, SIEVE_BYTES = 8, 64 << 20
MOST_KEYS = SIEVE_BYTES * 8 // KEY_BITS
_SLICES = 64


class Sieve(NamedTuple):
    """Tells which keys may be in a set: never misses one, and passes about one in fifty others. Without bits it passes all."""

    packed: bytes | None

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        if self.packed is None:
            return np.ones(len(hashes), bool)
        bits = np.frombuffer(self.packed, np.uint8)
        out = np.ones(len(hashes), bool)
        for at in _probes(hashes, bits.size * 8):
            out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    return mix(h) % np.uint64(bits), mix(h ^ np.uint64(0x94D049BB133111EB)) % np.uint64(bits)


def sieve(keys: DataFrame, most_keys: int = MOST_KEYS) -> Sieve:
    """The filter of a stored table's long column `key`: 8 to 16 bits for each of its rows, 64 MB at most.

    Tasks send the positions in each slice of the bits; slices are put together on executors, so what the driver gets is
    the filter. Above `most_keys` it would pass nearly everything, so none is made: callers shuffle by key in either case.
    """
    n = keys.count()
    if n > most_keys:
        return Sieve(None)
    bits = max(1 << 16, 1 << (KEY_BITS * max(n, 1) - 1).bit_length())
    width = bits // _SLICES

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_probes(b.column(0).to_numpy(zero_copy_only=False), bits)))
            edge = np.searchsorted(at, np.arange(_SLICES + 1, dtype=np.uint64) * np.uint64(width))
            held = [s for s in range(_SLICES) if edge[s] < edge[s + 1]]
            parts = [(at[edge[s] : edge[s + 1]] - np.uint64(s * width)).astype("<u4").tobytes() for s in held]
            yield pa.record_batch([pa.array(held, pa.int32()), pa.array(parts, pa.binary())], ["slice", "part"])

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        acc = np.zeros(width, dtype=bool)
        for part in frame["part"]:
            acc[np.frombuffer(part, "<u4")] = True
        return pd.DataFrame({"slice": [key[0]], "part": [np.packbits(acc, bitorder="little").tobytes()]})

    parts = keys.select(F.col("key").cast("long")).mapInArrow(released(build), "slice int, part binary").groupBy("slice").applyInPandas(merge, "slice int, part binary").collect()
    out = bytearray(bits // 8)
    for r in parts:
        out[r["slice"] * width // 8 : (r["slice"] + 1) * width // 8] = r["part"]
    return Sieve(bytes(out))


# --- vectorised word hashing -----------------------------------------------------

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_IBASE = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
#: Byte values after A-Z are lower-cased; 0 for bytes between words.
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_WORD[65:91] = True
_BYTE_CODE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)[_LOWERED]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW[0].size < n:
        for k, base in enumerate((_BASE, _IBASE)):
            p = np.full(max(n, 1 << 19), np.uint64(base))
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts, in order, and the index of each word's text.

    Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.
    """
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    if buf.size == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = IS_WORD[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(buf.size)
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE_CODE[buf] * power, dtype=np.uint64)))
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    begin = np.cumsum(np.array([0] + [len(t) + 1 for t in texts[:-1]], dtype=np.int64))
    return h, np.searchsorted(begin, start, side="right") - 1


def in_chunks(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive slices of about `most` bytes, so that work arrays stay small; a longer text stands alone."""
    at, held, first = 0, 0, 0
    for at, t in enumerate(texts):
        if held and held + len(t) > most:
            yield first, texts[first:at]
            first, held = at, 0
        held += len(t)
    if texts:
        yield first, texts[first:]


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]



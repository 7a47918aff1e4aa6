"""Packing by minimum bin slack: token sequences of fixed length with little padding."""

from __future__ import annotations

import base64
import json
import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import documents, released, small_batches

#: Characters that both tokenizer libraries class alike in every Unicode version; other texts take the slower one.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ‐-‧]")


#: Tails that a task holds at once, in bytes: beyond this its full windows are placed and given out.
HELD_BYTES = 32 << 20


@lru_cache(maxsize=1)
def encoder(path: str, ranks: str | None, pattern: str | None) -> Callable[[str], np.ndarray]:
    """Text to token ids of the tokenizer file at `path`, as the file's library gives them by default.

    With `ranks` (the same vocabulary as merge ranks) plain Latin text takes the byte-pair library that reads
    these, about five times as fast with equal ids; all else takes the tokenizer file itself, and so does any text that holds
    one of the file's added tokens, which are single ids there. A worker keeps what it has loaded.
    """
    slow, fast, added = [], None, None
    if ranks:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        with open(path, encoding="utf-8") as f:
            strings = [t["content"] for t in json.load(f).get("added_tokens", []) if t["content"]]
        added = re.compile("|".join(map(re.escape, strings))) if strings else None

    def encode(text: str) -> np.ndarray:
        if fast is not None and not _PLAIN.search(text) and not (added and added.search(text)):
            return np.array(fast.encode_ordinary(text), "<u4")
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (at most counts[length] of each) whose sum is nearest to capacity from below.

    The largest length is always taken. Bit s of a bitset says that sum s can be reached; lengths join in
    falling order, each by binary parts of its count, until the capacity itself can be reached. The choice is
    read back from the bitsets, as few of each length as the sum allows.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= capacity), reverse=True)
    if not lengths:
        return {}
    first, room = lengths[0], capacity - lengths[0]
    mask, reach, trail = (1 << room + 1) - 1, 1, []
    for n in lengths:
        left = counts[n] - (n == first)
        if n > room or not left:
            continue
        trail.append((n, left, reach))
        part = 1
        left = min(left, room // n)
        while left:
            step = min(part, left)
            reach |= reach << n * step & mask
            left -= step
            part *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int, {first: 1})
    for n, _, before in reversed(trail):
        while not before >> at & 1:
            at -= n
            chosen[n] += 1
    return dict(chosen)


def windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings of windows and how often each is used, until no length is left."""
    left = {n: c for n, c in counts.items() if c}
    while left:
        chosen = best_fill(left, capacity)
        times = min(left[n] // c for n, c in chosen.items())
        yield chosen, times
        for n, c in chosen.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]


def pack(docs: DataFrame, files: Callable[[], tuple[str, str | None, str | None]], capacity: int = 1024, end_id: int = 0, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Cuts every document's ids (and end_id after them) into pieces and places each in a sequence.

    files: called on each worker, gives the places of the tokenizer file, of its merge ranks (or None) and their pattern.
    Returns per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset. Whole windows are cut from a document's start; what remains of each is one piece, and the pieces
    of a partition fill windows by minimum bin slack. A task that holds `held_bytes` of them places the windows that it can
    fill and goes on with the others. A partition's window that cannot be filled (there are only a
    few, at its end) becomes sequences at powers of two, which need no padding. Partitions pack on their own, so
    nothing is shuffled and a lost task is simply run again. Null and empty texts give one piece, the end id; a very long text
    gives whole windows, of which at most 512 pieces are held;
    repeated rows are packed as often as they occur; no rows give no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(*files()), TaskContext.get().partitionId()
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []
        tails: dict[int, deque] = defaultdict(deque)
        made = held = 0

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
            rows.clear()
            return out

        def place(pieces: list[tuple], sequence: int) -> None:
            offset = 0
            for doc, start, raw, total in pieces:
                rows.append((doc, start, len(raw) // 4, raw, total, part << 33 | sequence, offset))
                offset += len(raw) // 4

        def fill(last: bool) -> Iterator[pa.RecordBatch]:
            """Places tails: those that fill windows, at the last call all."""
            nonlocal made
            for chosen, times in windows({n: len(q) for n, q in tails.items()}, capacity):
                filled = sum(n * c for n, c in chosen.items())
                if filled < capacity and not last:
                    break  # the others wait for more tails
                for _ in range(times):
                    pieces = [tails[n].popleft() for n, c in sorted(chosen.items(), reverse=True) for _ in range(c)]
                    for room in [capacity] if filled == capacity else [1 << k for k in range(filled.bit_length() - 1, -1, -1) if filled >> k & 1]:
                        taken = []
                        while room:
                            doc, start, raw, total = pieces.pop(0)
                            if len(raw) > 4 * room:
                                pieces.insert(0, (doc, start + room, raw[4 * room :], total))
                                raw = raw[: 4 * room]
                            taken.append((doc, start, raw, total))
                            room -= len(raw) // 4
                        place(taken, made)
                        made += 1
                if len(rows) >= 512:
                    yield flush()

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([end_id], "<u4")).astype("<u4")
                whole = ids.size // capacity * capacity
                for start in range(0, whole, capacity):
                    place([(doc, start, ids[start : start + capacity].tobytes(), ids.size)], made)
                    made += 1
                    if len(rows) >= 512:
                        yield flush()
                if ids.size > whole:
                    tails[ids.size - whole].append((doc, whole, ids[whole:].tobytes(), ids.size))
                    held += 4 * (ids.size - whole)
                if held > held_bytes:
                    yield from fill(last=False)
                    # If no window can be filled (all tails alike, say) they are placed as they are: the bound holds in any case.
                    if (held := 4 * sum(n * len(q) for n, q in tails.items())) > held_bytes // 2:
                        yield from fill(last=True)
                        tails.clear()
                        held = 0
        yield from fill(last=True)
        yield flush()

    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def public_50k() -> tuple[str, str, str]:
    """The public 50k byte-level vocabulary, as this machine has it."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def packed_digest(docs: DataFrame) -> DataFrame:
    """Pieces under the public 50k byte-level vocabulary, with a checksum in place of the ids."""
    pieces = pack(docs, public_50k)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(documents(spark, sf_dir))

"""MinHash near-dedup with DartMinHash signatures and an exact check of every candidate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import documents, in_chunks, materialize, mix, released, scratch, sieve, small_batches, spread_join, utf8, word_hashes

WORDS = 5
#: Similarity of a link, as a fraction: at least 4/5 of the union of both shingle sets is shared.
SIMILAR = (4, 5)
#: Bands and coordinates in each. A pair at 0.8 shares no band with probability (1 - 0.8^5)^26 = 3e-5.
BANDS, ROWS = 26, 5
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Height of the lowest rank cell; each cell above is as high as all below it together.
_LOWEST = 2.0**-3


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts by inverting the distribution function at u."""
    top = int(mean + 12 * np.sqrt(mean) + 12)
    k = np.arange(1, top)
    cdf = np.cumsum(np.exp(np.concatenate(([0.0], np.cumsum(np.log(mean / k)))) - mean))
    out = np.zeros(len(u), np.int64)
    some = np.flatnonzero(u >= cdf[0])
    out[some] = np.searchsorted(cdf, u[some], side="right")
    return out


def dart_signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of n weighted sets given as (element hash, weight above 0, set) triples.

    Darts lie over element x weight x rank with density one. They are found cell by cell: a cell of the weight and rank
    axes (both cut at powers of two) holds a Poisson number of darts, and the element's and cell's hash decides
    this number, each dart's place, and the coordinate of the signature that it falls to. A set has the darts in its
    elements' regions, below their weights. The dart of lowest rank is kept in each coordinate, so two signatures
    agree in a coordinate with the sets' weighted Jaccard similarity. Ranks are looked at up to a height at which
    about k (ln k + 2) darts lie in a set's region; sets with a coordinate still empty go on to twice that height.
    Sets without elements keep zeros.
    """
    best, dart = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    total = np.bincount(owner, weight, minlength=n)
    height = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0.0)
    below = np.zeros(n)  # ranks already looked at
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[owner])
        e, w, o = element[mine], weight[mine], owner[mine]
        rank, low, r = _LOWEST, 0.0, 0
        while low < height[todo].max():
            in_rank = (height[o] > low) & (below[o] < rank)
            wide, left, v = 1.0, 0.0, 0
            while in_rank.any():
                here = in_rank if left == 0 else in_rank & (w > left)
                at = np.flatnonzero(here)
                if not len(at):
                    break
                base = mix(e[at] ^ mix(np.full(1, r << 8 | v, np.uint64) * _GOLD))
                count = _poisson(_unit(base), (rank - low) * wide)
                got = np.flatnonzero(count)
                number = count[got]
                nth = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                name = mix(np.repeat(base[got], number) + (nth + 1).astype(np.uint64) * _GOLD)
                own, most = np.repeat(o[at[got]], number), np.repeat(w[at[got]], number)
                level = low + (rank - low) * _unit(mix(name ^ np.uint64(0x5851F42D4C957F2D)))
                inside = (level < height[own]) & (level >= below[own])
                if most.min(initial=np.inf) < left + wide:
                    inside &= left + wide * _unit(mix(name ^ np.uint64(0x14057B7EF767814F))) < most
                own, level, name = own[inside], level[inside], name[inside]
                slot = own * k + ((name >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(best, slot, level)
                first = level == best[slot]
                dart[slot[first]] = name[first]
                wide, left, v = (1.0, 1.0, 1) if v == 0 else (wide * 2, left + wide, v + 1)
            rank, low, r = rank * 2, rank, r + 1
        empty = np.isinf(best.reshape(n, k)).any(axis=1) & todo
        below[empty], height[empty], todo = height[empty], height[empty] * 2, empty
    return dart.reshape(n, k)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, text) of the distinct shingles of texts, by text and hash.

    A text of fewer words has one shingle, all of them; a text without words has none.
    """
    h, at = word_hashes(texts)
    count = np.bincount(at, minlength=len(texts))
    factor = np.cumprod(np.full(words, np.uint64(0xD6E8FEB86659FD93)))
    begin = np.cumsum(count) - count
    if len(h) >= words:
        whole = np.flatnonzero(at[: len(at) - words + 1] == at[words - 1 :])
        s = sum(h[whole + j] * factor[j] for j in range(words))
        owner = at[whole]
    else:
        s, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    few = np.array([int((h[begin[d] : begin[d] + count[d]] * factor[: count[d]]).sum(dtype=np.uint64)) for d in short], np.uint64)
    s, owner = mix(np.concatenate([s, few])), np.concatenate([owner, short])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1]))) if len(s) else np.zeros(0, bool)
    return s[new], owner[new]


def _sums(s: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, the same for equal sets."""
    out = []
    edge = np.searchsorted(owner, np.arange(n + 1))
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(s ^ np.uint64(salt)), dtype=np.uint64)))
        out.append(mix(total[edge[1:]] - total[edge[:-1]]).view(np.int64))
    return out[0], out[1]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to (doc_id, text_hash, n, k1, k2, bands)."""
    for b in batches:
        texts = utf8(b.column(2))
        for first, part in in_chunks(texts):
            s, owner = shingles(part)
            n = len(part)
            size = np.bincount(owner, minlength=n)
            k1, k2 = _sums(s, owner, n)
            d = dart_signatures(s, np.ones(len(s)), owner, n, BANDS * ROWS).reshape(n, BANDS, ROWS)
            factor = np.cumprod(np.full(ROWS, np.uint64(0xC2B2AE3D27D4EB4F)))
            bands = mix((d * factor).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _GOLD).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            yield pa.record_batch([b.column(0).slice(first, n), b.column(1).slice(first, n), pa.array(size, pa.int32()), pa.array(k1), pa.array(k2), lists], ["doc_id", "text_hash", "n", "k1", "k2", "bands"])


def _sets(wanted):
    """(key, text) of the rows that may be wanted to (k1, k2, shingles); wanted: a broadcast Sieve of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.flatnonzero(wanted.value.passes(b.column(0).to_numpy(zero_copy_only=False)))
            for _, part in in_chunks(utf8(b.column(1).take(pa.array(hit)))):
                s, owner = shingles(part)
                k1, k2 = _sums(s, owner, len(part))
                edge = np.searchsorted(owner, np.arange(len(part) + 1))
                held = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(s.view(np.int64)))
                yield pa.record_batch([pa.array(k1), pa.array(k2), held], ["k1", "k2", "shingles"])

    return run


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a stored table, whose shingle sets are similar, by comparing the sets. Nodes a of many pairs are dealt out."""
    left = sets.select(F.col("nid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("nid").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    num, den = SIMILAR
    return spread_join(pairs, left, ["a"], "b").join(right, "b").filter(shared * den >= (F.size("x") + F.size("y") - shared) * num).select("a", "b")


def _near_in_size(a: str, b: str):
    """Sizes that do not rule out the similarity: the smaller is at least that part of the larger."""
    num, den = SIMILAR
    return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)


def prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (nid, label) of different labels that may be similar: no similar pair is missing.

    Sets at least p similar share at least p of either; so, with all shingles in one order, they share one among the
    first n - ceil(p n) + 1 of each. The order is by how many nodes have a shingle, the rarest first: shingles of one
    node only fill the places of texts that nothing is near, and those of one component only lead to no pair.
    """
    num, den = SIMILAR
    held = nodes.join(sets, "nid").select("nid", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    held = materialize(held, "near-shingles")
    spread = held.groupBy("shingle").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    ranked = held.join(spread, "shingle").groupBy("nid", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle", (F.col("lo") != F.col("hi")).alias("crosses")))).alias("all"))  # one document's own
    first = F.slice("all", F.lit(1), F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1)
    placed = F.filter(F.transform(first, lambda x, i: F.struct(x["shingle"].alias("shingle"), i.alias("at"), x["crosses"].alias("crosses"))), lambda x: x["crosses"])
    prefix = materialize(ranked.select("nid", "label", "n", F.explode(placed).alias("p")).select("nid", "label", "n", "p.shingle", "p.at"), "near-prefix")
    x, y = (prefix.select("shingle", *[F.col(c).alias(f"{s}_{c}") for c in ("nid", "n", "label", "at")]) for s in "xy")
    # What both can still share from their first common shingle on must make them similar.
    rest = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    enough = rest * (num + den) >= (F.col("x_n") + F.col("y_n")) * num
    pairs = x.join(y, "shingle").filter((F.col("x_label") < F.col("y_label")) & _near_in_size("x_n", "y_n") & enough)
    return pairs.select(F.col("x_nid").alias("a"), F.col("y_nid").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(nid, label) of all nodes of the edges (a, b); the label is the component's smallest node.

    Labels spread to neighbours and jump to their own label's label until none changes; each round is written to
    the shared folder, so plans stay short and lost executors cost one round. Nodes of many edges and labels of many
    nodes are dealt over tasks.
    """
    with scratch(edges.sparkSession) as keep:
        both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
        labels = materialize(both.groupBy(F.col("a").alias("nid")).agg(F.least(F.min("b"), F.col("nid")).alias("label")), "near-labels")
        while True:
            seen = spread_join(both, labels.select(F.col("nid").alias("b"), "label"), ["b"], "a").groupBy(F.col("a").alias("nid")).agg(F.min("label").alias("near"))
            # Only labels that have a smaller label of their own lead anywhere.
            jump = labels.filter("label < nid").select(F.col("nid").alias("label"), F.col("label").alias("next"))
            jumped = spread_join(labels, jump, ["label"], "nid", "left")
            new = jumped.join(seen, "nid").select("nid", F.col("label").alias("old"), F.least("label", "near", "next").alias("label"))
            new = materialize(new, "near-labels")
            labels = new.select("nid", "label")
            if new.filter("label <> old").isEmpty():
                keep(new)
                return labels


def classify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id, class_size, kept.

    Documents are linked if at least 0.8 of the union of their sets of five-word shingles is shared; classes are the
    components of links, named by their smallest doc_id (null only if no member has one). Equal sets form one node first. Texts without words stand
    alone. kept marks the smallest (doc_id, text_hash) of a class, nulls last; rows that repeat both are all marked.
    No rows give no rows; a very long text is worked on alone, in memory of some fifty times its bytes; other columns are
    ignored, whatever their names.

    Nodes that share a band are candidates. In each band's bucket all members are compared with one of them, so
    copies of one text cost one comparison each. Members of buckets that still hold different components are then
    joined on rare shingles of theirs, which misses no similar pair: no candidate pair is left out.
    """
    small_batches(docs)
    spark = docs.sparkSession
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    with scratch(spark) as keep:
        rows = keep(materialize(listed.mapInArrow(released(_sketch), "doc_id long, text_hash long, n int, k1 long, k2 long, bands array<long>"), "near-rows"))
        one = F.min_by(F.struct("doc_id", "text_hash", "n", "bands"), F.struct("doc_id", "text_hash"))
        grouped = rows.filter("n > 0").groupBy("k1", "k2").agg(one.alias("one")).select("k1", "k2", "one.n", "one.bands", F.xxhash64("one.doc_id", "one.text_hash").alias("key"))
        nodes = materialize(grouped.withColumn("nid", F.monotonically_increasing_id()), "near-nodes")
        banded = nodes.select("nid", "n", F.explode("bands").alias("band"))
        buckets = banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
        shared = banded.join(buckets, "band")
        # A node's weight is how many it shares bands with. In a group of copies of one text, that text has the most: it is
        # near all of them, while two copies may be too far apart to be linked.
        weight = shared.groupBy("nid").agg(F.sum("members").alias("weight"))
        weighed = materialize(shared.drop("members").join(weight, "nid"), "near-weighed")
        heads = weighed.groupBy("band").agg(F.max(F.struct("weight", "nid", "n")).alias("head")).select("band", F.col("head.nid").alias("a"), F.col("head.n").alias("a_n"))
        member = materialize(spread_join(weighed.select("band", "nid", "n"), heads, ["band"], "nid"), "near-members")
        led = materialize(member.filter((F.col("nid") != F.col("a")) & _near_in_size("n", "a_n")).select("a", F.col("nid").alias("b")).distinct(), "near-led")
        wanted = materialize(member.select("nid").distinct().join(nodes.select("nid", "k1", "k2", "key"), "nid"), "near-wanted")
        sent = spark.sparkContext.broadcast(sieve(wanted.select("key")))
        # The row that stands for a node is known by its id and text, so only its text is made into shingles again.
        held = listed.select(F.xxhash64("doc_id", "text_hash"), "text").mapInArrow(released(_sets(sent)), "k1 long, k2 long, shingles array<long>")
        sets = materialize(held.join(wanted.select("k1", "k2", "nid"), ["k1", "k2"]).groupBy("nid").agg(F.any_value("shingles").alias("shingles")), "near-sets")
        links = materialize(_similar(led, sets), "near-links")
        labels = components(links)

        # Buckets that hold more than one component: their nodes are compared across components.
        known = member.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
        several = known.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band")
        apart = materialize(known.join(several, "band", "left_semi").select("nid", "label").distinct(), "near-apart")
        if not apart.isEmpty():
            more = materialize(_similar(materialize(prefix_pairs(apart, sets), "near-pairs"), sets), "near-links")
            if not more.isEmpty():
                labels = components(links.unionByName(more))
        named = nodes.select("k1", "k2", "nid").join(labels, "nid", "left").select("k1", "k2", F.coalesce("label", "nid").alias("label"))
        several = rows.filter("n > 0").select("doc_id", "text_hash", "k1", "k2")
        placed = keep(materialize(spread_join(several, named, ["k1", "k2"], "doc_id"), "near-placed")).select("doc_id", "text_hash", "label")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = placed.groupBy("label").agg(F.count("*").alias("class_size"), F.min(order).alias("first"))
    out = spread_join(placed, classes, ["label"], "doc_id").select("doc_id", "text_hash", F.col("first.doc_id").alias("class_id"), "class_size", (order == F.col("first")).alias("kept"))
    alone = rows.filter("n = 0").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each class, with all their columns; of rows repeated whole, one.

    Texts without words all stay. Only rows that may be in a class of several (a filter of the classes' rows tells) are
    shuffled. Columns of any name come through as they are. No rows give no rows.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        several = keep(materialize(classify(docs).filter("class_size > 1").select(F.xxhash64("doc_id", "text_hash").alias("key"), "doc_id", "text_hash", "kept"), "near-classes"))
    near = spark.sparkContext.broadcast(sieve(several.select("key")))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(near.value.passes(h.to_numpy()))

    own = F.xxhash64("text")
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), own.alias("hash"), maybe(F.xxhash64(F.col("doc_id").cast("long"), own)).alias("maybe"))
    gone = several.filter("NOT kept").select(F.col("doc_id").alias("out"), F.col("text_hash").alias("out_hash")).distinct()
    suspects = marked.filter("maybe").join(gone, F.col("id").eqNullSafe(F.col("out")) & (F.col("hash") == F.col("out_hash")), "left_anti")
    staying = suspects.dropDuplicates(["id", "hash"])
    return marked.filter("NOT maybe").select("row.*").unionByName(staying.select("row.*"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")

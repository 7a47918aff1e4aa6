"""The corpus pipeline: documents in, packed token sequences out.

Stages, each on all rows that the one before it kept: language identification (texts without a language go), exact
dedup, near-dedup (one document of each class stays), mixing of sources (documents that the mix does not take go,
those that it takes twice come twice), packing. Each stage is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import exactdup, langid, mixing, neardup, packing
from mnemolake.llm.common import discard, documents, materialize, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, empty or without a letter; lang becomes the predicted language.

    Trees are learned from docs' own known languages (a bounded sample of each). If none is known every text with a letter
    stays, its lang as it is. Texts of any length are coded whole; ties go to the smaller language name; equal texts get equal
    languages and repeated rows all stay; a null source or doc_id does not matter; no rows give no rows; other columns come
    through, whatever their names.
    """
    model = langid.learn(docs)
    own = docs.select(F.struct("*").alias("row"), "text")
    if not model.languages:
        return own.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select("row.*")
    found = langid.identify(own, model).filter("lang_pred <> 'und'")
    return found.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the largest doc_id stays (a null one only where there is no other).

    Null and empty texts are equal, so one of them stays; of rows that repeat doc_id and text one stays. Texts of any length are
    compared whole; no rows give no rows; other columns come through, whatever their names.
    """
    return exactdup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the smallest doc_id stays, null ones last; ties go to the smaller hash of the text.

    Null and empty texts and texts without words are near nothing and stay; of rows that repeat doc_id and text one stays. A very
    long text is compared whole, by one task; no rows give no rows; other columns come through, whatever their names.
    """
    return neardup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them whole; a part taken of a document is its beginning, up to its last word taken.

    A source's last pass ends inside at most one document, so of all rows one a source is cut; its line ends and spaces stay.
    Null sources are one source. Null and empty texts and those of white space have no words to take and go; a very long text is
    taken like others; ties in a source's order go by doc_id, and repeated rows are rows of their own; no rows give no rows; other
    columns come through, whatever their names.
    """
    rows = mixing.take(docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")).filter("mixed.taken > 0")
    whole, rest = F.floor(F.col("mixed.taken") / F.col("mixed.size")).cast("int"), F.col("mixed.taken") % F.col("mixed.size")
    copies = F.concat(F.array_repeat(F.lit(None).cast("long"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    rows = rows.select("row", "text", F.explode(copies).alias("words"))
    # Cut behind each word: the first n parts are the text up to its nth word.
    head = F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.col("words").cast("int")), "")
    return rows.select(F.col("row").withField("text", F.when(F.col("words").isNull(), F.col("text")).otherwise(head)).alias("row")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece, the end id; very long texts are cut into whole windows; repeated rows are packed as often
    as they occur; a null doc_id stays null; no rows give no rows; other columns are ignored, whatever their names.
    """
    return packing.packed_digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: SQL cannot express language models, shingle classes or tokenizers; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage has written for itself goes when it ends, its input with it."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:
            done = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if k:
            discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: toxicity filter, near-dedup, removal of repeated passages, source mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its rows are written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents. A stage works on all rows that it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, repeats, simhash, toxicity
from tessera.llm.common import fresh, table, written

#: Words of a passage that may not stand twice: over 50.
PASSAGE = 51


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the lexicon is learned from labelled ones outside the held-out fifth.

    Null and empty texts score as no words and stay, repeated rows are judged alike, columns of any name pass through,
    an empty table gives an empty one.
    """
    lexicon = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")), weight="weight")
    score = fresh("toxicity", docs.columns)
    scored = toxicity.with_score(docs, lexicon, score=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that pairs of five-word Jaccard similarity 0.8 or more link: those that SimHash
    finds within 3 bits, checked, and those that it misses.

    Texts of the same words are copies: null and empty ones are copies of each other. Of rows that repeat an id and a
    text one stays; columns of any name pass through; an empty table gives an empty one.
    """
    return simhash.drop_near_duplicates(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without the strings of over 50 words, or of 400 bytes, that also start elsewhere.

    A null text stays null, an empty one empty. Repeated rows hold each other's strings, so both lose them; columns of
    any name pass through; an empty table gives an empty one.
    """
    return repeats.without_repeats(docs, words=PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source, the last; null texts have no words and are taken at their source's rate; repeated rows
    are documents of their own that draw alike; columns of any name pass through; an empty table gives an empty one.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences.

    Null and empty texts are the end id alone, repeated rows are documents of their own; an empty table gives an empty one.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_dedup", near_dedup),
    ("suffix_dedup", passage_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no tokenizer and no such links; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

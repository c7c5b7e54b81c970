"""The corpus pipeline: classify, drop near duplicates, mask personal data, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it returns is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loreseek.llm import mixing, packing, pii, quality, simhash
from loreseek.llm.queries import APART
from loreseek.sources.shared import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.keep_good(_documents(docs), labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (3 bits, or five-word shingles alike by 0.8), the one with the smallest id."""
    return simhash.one_of_each(_documents(docs), similarity=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by their kind."""
    return pii.masked(_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each time they are taken."""
    return mixing.mixed(_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each piece of each document."""
    return packing.pack_documents(docs.select("doc_id", "text", "source"), apart=APART)


STAGES = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the fingerprints are not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is a written table, so a lost executor costs one stage at most."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs

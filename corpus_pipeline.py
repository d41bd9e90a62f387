"""From raw documents to token ids: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.llm.common import Scratch
from stagelight.llm.langid import identify
from stagelight.llm.minhash import drop_near_duplicates
from stagelight.llm.mixing import SEED, WEIGHTS, mix_sources
from stagelight.llm.pieces import encode_texts, load_vocabulary
from stagelight.llm.pii import QUERY_KEY, pseudonymise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learns from all rows with a language.

    Texts that are null, empty or without a letter go. Repeated rows and ids are judged alike, each by its text; other
    columns may be null and have any names; an empty table stays empty, and where no row has a language all go.
    """
    found = identify(docs, F.lit(True))
    return found.where("not rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, of equal ids the first row.

    Texts that are null or without a word all stay, as they are near to nothing; a null doc_id stands for its group
    only where all are null. An empty table stays empty.
    """
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms, equal ones for equal values; a null text stays null, an empty one empty."""
    return pseudonymise(docs, QUERY_KEY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out to the sources' target weights, in random order.

    The draw goes by doc_id, so rows with equal or null ids are repeated equally often; a null source has the default
    weight. An empty table stays empty.
    """
    return mix_sources(docs, WEIGHTS, seed=SEED, copy_column=None)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, the N best segmentations, and a digest of the text that the ids decode to, for each row.

    A null text gives nulls, an empty one no ids; ties between segmentations go to the one whose pieces start earlier.
    """
    vocabulary = load_vocabulary()
    out = encode_texts(docs.select("doc_id", "source", "text"), vocabulary, digest="decoded_sha256")
    return out.select("doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "score", "nbest", "decoded_sha256")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("encoding", encoding)]

#: Language identification and lattice search aren't SQL; tests/llm/test_pipeline.py checks each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again, and dropped when the next one has its own."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep_only(name)
    return docs

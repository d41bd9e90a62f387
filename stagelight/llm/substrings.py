"""Substring dedup on words by super-k-mer partitioning (operator 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.llm.repeats import BUCKET, IN_MEMORY, Units, covered, remove_repeats

WINDOW = 35
#: Words of a minimiser: long enough that unrelated texts rarely share one.
MINIMISER = 8


def dedup_substrings(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, in_memory: int = IN_MEMORY, bucket: int = BUCKET) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts anywhere else in `docs`.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; windows are judged on the input. Returns doc_id, n_words,
    n_removed, kept (the kept words, as UTF-8 bytes joined by one space). All occurrences go, the first one too.
    A null or empty text has no words; texts shorter than a window lose nothing. Rows with equal or null doc_id are
    texts of their own, so a repeated row is a repeat of its twin. Other columns are not read. `docs` has to be a
    scan or a written table.
    """
    units = Units(True, window, min(minimiser, window))

    def out(text: bytes, spans: bytes | None) -> tuple:
        words = text.split()
        if not spans:
            return len(words), 0, b" ".join(words)
        gone = covered(len(words), spans)
        return len(words), int(gone.sum()), b" ".join(w for w, x in zip(words, gone.tolist()) if not x)

    return remove_repeats(docs, units, out, "n_words long, n_removed long, kept binary", ["doc_id"], in_memory, bucket)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE_SQL: dict[str, str] = {}

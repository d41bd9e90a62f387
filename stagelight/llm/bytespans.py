"""Suffix-array dedup on bytes by prefix-free parsing (operator 6).

A byte position is a trigger if its rolling hash of 32 bytes is the smallest of some window of 200 bytes, so each
window has one, and triggers depend on the bytes around them alone. Triggers cut the corpus into phrases that end
with one; no suffix of a phrase that a window can start at begins with another one of that trigger, as the trigger
would have come earlier. Equal phrases in equal surroundings are one entry of the dictionary, whose occurrences are
repeated whole without a look inside: that is what the parse saves on repetitive text. For the rest, the suffixes of
the dictionary are sorted by prefix doubling and the suffixes of the parse, as far as a window reaches, by their
bytes. Both ranks together sort the windows (`repeats.bucket_order`): this is the corpus order, up to 200 bytes, dealt
over the cluster by trigger. Dealt by leading bytes, each phrase would have to travel to as many places as it has
suffixes. Neighbours of the order that share 200 bytes are repeats; through the parse's places they are spans of texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.llm.repeats import BUCKET, IN_MEMORY, Units, covered, remove_repeats

LENGTH = 200
#: Bytes of a trigger.
TRIGGER = 32


def dedup_bytes(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, in_memory: int = IN_MEMORY, bucket: int = BUCKET) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else in `docs`.

    Texts are UTF-8 bytes; matches never cross texts, may overlap, and are judged on the input. Returns doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes). A null text is empty. Rows with
    equal or null doc_id are texts of their own. Other columns are not read. `docs` has to be a scan or a written table.
    """
    units = Units(False, length, min(trigger, length))

    def out(text: bytes, spans: bytes | None) -> tuple:
        if not spans:
            return len(text), 0, 0, text
        gone = covered(len(text), spans)
        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(text), int(gone.sum()), runs, np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()

    return remove_repeats(docs, units, out, "n_bytes long, n_removed long, n_spans long, kept binary", ["doc_id"], in_memory, bucket)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_array_dedup": op6_suffix_array_dedup}
ORACLE_SQL: dict[str, str] = {}

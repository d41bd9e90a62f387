"""Quality rules with thresholds from mergeable quantile sketches (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.llm import blocks as B
from stagelight.llm.common import Scratch

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Rates that the rules look at, each with the least spread that a group's sketch is taken to have: a twentieth of a
#: symbol a word, 0.3 characters a word, 5 % of the words, 6 % of the lines. Most texts repeat nothing, so without it
#: each repeated line would be out of range; with it, each rule can act below the base rules.
RATES = {"symbol_rate": 0.05, "word_length": 0.3, "repeat_rate": 0.05, "dup_line_rate": 0.06}
#: A rate is out of range beyond the median by this many spreads (median to 90 or 10 per cent).
FENCE = 4.0
#: Groups of fewer texts take the merged sketch of their language, and languages that of all texts.
LEAST_GROUP = 200
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _counts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    rows = len(bounds) - 1
    add = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    per = lambda x: np.diff(add(x)[bounds])
    start, end, first = B.word_spans(data, bounds)
    n_words = np.diff(first)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    chars = per(~B.SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = per(symbol[data])
    # lines: split at \n; those with a word that equal an earlier one of the text
    feed = np.flatnonzero(data == 10)
    row_of_feed = np.searchsorted(bounds, feed, side="right") - 1
    some = np.flatnonzero(np.diff(bounds) > 0)
    line_start = np.sort(np.concatenate([bounds[some], feed + 1]))
    line_end = np.sort(np.concatenate([feed, bounds[some + 1]]))
    line_row = np.sort(np.concatenate([some, row_of_feed]))
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    twins = np.zeros(rows, dtype=np.int64)
    if len(line_start):
        h = B.span_hashes(data, line_start, line_end)
        order = np.lexsort((h[1], h[0], line_row))
        same = (h[0][order][1:] == h[0][order][:-1]) & (h[1][order][1:] == h[1][order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
        twins = np.bincount(line_row[order][1:][same], minlength=rows)
    # words in windows found twice or more in the text
    n_windows = np.maximum(n_words - WINDOW + 1, 0)
    repeats = np.zeros(rows, dtype=np.int64)
    if n_windows.sum():
        at = B.runs(first[:-1], n_windows)
        row = np.repeat(np.arange(rows), n_windows)
        words = B.span_hashes(data, start, end)
        h = [B.rolling(words[w], WINDOW, w)[at] for w in (0, 1)]
        order = np.lexsort((h[1], h[0], row))
        same = (h[0][order][1:] == h[0][order][:-1]) & (h[1][order][1:] == h[1][order][:-1]) & (row[order][1:] == row[order][:-1])
        hit = np.zeros(len(at), dtype=bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        edge = np.zeros(len(start) + 1, dtype=np.int64)
        np.add.at(edge, at[hit], 1)
        np.add.at(edge, at[hit] + WINDOW, -1)
        repeats = np.diff(add(np.cumsum(edge)[:-1] > 0)[first])
    return [n_words, chars, symbols, np.bincount(line_row, minlength=rows), twins, repeats]


def count_features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The counts of COUNTS for each whole text, beside `columns`; a null text has none."""
    fields = docs.select(*columns).schema
    for part in COUNTS.split(", "):
        fields = fields.add(*part.split())
    names = [part.split()[0] for part in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.utf8(batch.column("text"))
            for a, b in B.blocks(off):
                found = _counts(data[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in columns), *(pa.array(x.astype(np.int64)) for x in found)], [*columns, *names])

    return docs.select(*columns, "text").mapInArrow(run, fields)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, base rules and the verdict of adaptive thresholds for each document.

    Texts that pass the base rules (20 words or more; at most 30 % of the words in repeated 8-word windows) feed a KLL
    sketch for each rate, language and source. Sketches merge, so small groups take their language's, and small
    languages the sketch of all texts, and the sketches of new data can be merged into stored ones. A text is kept if each of its rates lies
    within FENCE spreads of its group's median, where a spread is the distance of the median to the 90 % quantile
    (10 % below it) and at least the rate's least spread. Null languages and sources are groups like others. A null or
    empty text has no words and fails the base rules. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, reason. Rows with equal doc_id are judged one by one. Repeated rows count as often
    as they occur and are judged alike; ties with a fence are in range. An empty table gives an empty one. Sketches of
    more than some hundreds of texts draw random bits and depend on how rows are dealt: their quantiles are off by 1.7 %
    of the ranks at most, so that a text whose rate lies that near to a fence can be judged otherwise in another run.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rate = {"symbol_rate": F.col("n_symbols") / F.col("n_words"), "word_length": F.col("word_chars") / F.col("n_words"), "repeat_rate": F.col("n_repeat_words") / F.col("n_words"), "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))}
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    counted = scratch.write(count_features(docs, ["doc_id", "lang", "source"]).withColumn("base_failed", failed), "counts")
    good = counted.where("not base_failed").select("lang", "source", *(rate[r].alias(r) for r in RATES))
    groups = scratch.write(good.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(r).alias(r) for r in RATES)), "groups")
    merge = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(r).alias(r) for r in RATES)]
    langs = groups.groupBy("lang").agg(*merge)
    total = groups.agg(*merge)

    def limits(sketch: str, least: float) -> list:
        q = [F.kll_sketch_get_quantile_double(sketch, F.lit(x)) for x in (0.1, 0.5, 0.9)]
        return [(q[1] - FENCE * F.greatest(q[1] - q[0], F.lit(least))).alias("low"), (q[1] + FENCE * F.greatest(q[2] - q[1], F.lit(least))).alias("high")]

    def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
        return sketches.select(*keys, "n", F.struct(*(F.struct(*limits(r, least)).alias(r) for r, least in RATES.items())).alias("fence"))

    by_lang = fences(langs, ["lang"]).select(F.col("lang").alias("l"), F.when(F.col("n") >= LEAST_GROUP, F.col("fence")).alias("lang_fence"))
    everything = fences(total.where("n is not null"), []).select("fence").first()
    overall = F.lit(None) if everything is None else F.struct(*(F.struct(F.lit(everything[0][r][0]).alias("low"), F.lit(everything[0][r][1]).alias("high")).alias(r) for r in RATES))
    own = fences(groups, ["lang", "source"]).join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    table = own.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.coalesce(F.when(F.col("n") >= LEAST_GROUP, F.col("fence")), "lang_fence", overall).alias("fence"))
    table = scratch.small(scratch.write(table, "fences"), "fences")
    judged = counted.join(table, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    out = [F.when((rate[r] < F.col(f"fence.{r}.low")) | (rate[r] > F.col(f"fence.{r}.high")), r) for r in RATES]
    reason = F.when(F.col("base_failed"), "base").otherwise(F.coalesce(*out))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", reason.isNull().alias("kept"), reason.alias("reason"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL: dict[str, str] = {}

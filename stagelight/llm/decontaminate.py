"""Benchmark decontamination by a prefix-filtered set join (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagelight.llm import blocks as B
from stagelight.llm.common import Scratch, with_row_id

WINDOW = 10
#: Words of a shingle, the token of the join; a window of fewer words is one shingle.
SHINGLE = 3
#: Bits of the map that tells which shingles can be a benchmark's. Its size is fixed, whatever the benchmark's.
MAP_BITS = 1 << 25
#: Bytes of a long text that are looked at together.
PIECE = 1 << 20

#: All but 0-9, a-z and what isn't ASCII; A-Z is lower-cased before.
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


@dataclass
class Words:
    """Words of some texts in a row, or of a piece of a long one: bytes, spans, hashes, and for each its text's place in
    the batch, its number in the text, and how many words of the text come from here on. `own` words count here; the
    others are neighbours that belong to another piece."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    number: np.ndarray
    rest: np.ndarray
    own: np.ndarray


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, text: int, skipped: int) -> Words:
    counts = np.diff(first)
    number = np.arange(len(start)) - np.repeat(first[:-1], counts)
    return Words(data, start, end, B.span_hashes(data, start, end)[0], np.repeat(np.arange(len(counts)), counts) + text, number + skipped, np.repeat(counts, counts) - number, np.ones(len(start), dtype=bool))


def words_of(column: pa.Array, margin: int) -> Iterator[Words]:
    """All words of whole texts, in blocks of bounded size; pieces of a long text share `margin` words on either side."""
    raw, off = B.utf8(column)
    for a, b in B.blocks(off):
        data = B.LOWER[raw[off[a] : off[b]]]
        if b - a > 1 or len(data) <= PIECE:
            yield _words(data, *B.word_spans(data, off[a : b + 1] - off[a], BETWEEN), a, 0)
            continue
        at, before, skipped, done = 0, np.empty((0, 2), dtype=np.int64), 0, 0
        while at < len(data):
            to = min(at + PIECE, len(data))
            while to < len(data) and not BETWEEN[data[to]]:  # no word is cut
                gap = np.flatnonzero(BETWEEN[data[to : to + PIECE]])
                to = to + int(gap[0]) if len(gap) else min(to + PIECE, len(data))
            start, end, _ = B.word_spans(data[at:to], np.array([0, to - at]), BETWEEN)
            spans = np.concatenate([before, np.stack([start, end], axis=1) + at])
            if len(spans):
                base = int(spans[0, 0])
                words = _words(data[base:to], spans[:, 0] - base, spans[:, 1] - base, np.array([0, len(spans)]), a, skipped)
                ready = skipped + len(spans) - (margin if to < len(data) else 0)
                words.own = (words.number >= done) & (words.number < ready)
                yield words
                done = max(done, ready)
                keep = min(len(spans), 2 * margin)
                before, skipped = spans[len(spans) - keep :], skipped + len(spans) - keep
            at = to


def shingles(words: Words, widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width the places of own words where a shingle starts, and its hash."""
    for width, h in zip(widths, B.rollings(words.hashes, widths)):
        places = np.flatnonzero(words.own & (words.rest >= width))
        yield places, h[places].view(np.int64)


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, window (its words, joined by a space), length, tokens (hashes of its shingles in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("text"), window):
                out = []
                for p in np.flatnonzero(words.own).tolist():
                    total = int(words.number[p] + words.rest[p])
                    length = min(window, total) if words.number[p] == 0 or total >= window else 0
                    if 0 < length <= words.rest[p]:
                        width = min(shingle, length)
                        spans = [words.data[words.start[i] : words.end[i]].tobytes() for i in range(p, p + length)]
                        tokens = B.rolling(words.hashes[p : p + length], width).view(np.int64)
                        out.append((int(words.text[p]), b" ".join(spans).decode("utf-8", "replace"), length, tokens))
                if out:
                    text, joined, length, tokens = zip(*out)
                    yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(text)), pa.array(joined), pa.array(length, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["item_id", "window", "length", "tokens"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, window string, length int, tokens array<long>")


def bit_map(tokens: DataFrame) -> np.ndarray:
    """Bits of the tokens in column `token`, modulo MAP_BITS; at most MAP_BITS / 64 rows come to the driver."""
    slot = F.pmod(F.col("token"), F.lit(MAP_BITS))
    sets = tokens.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(token, {MAP_BITS}) & 63))")).alias("bits"))
    found = sets.toPandas()
    bits = np.zeros(MAP_BITS // 64, dtype=np.uint64)
    bits[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def in_map(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    slot = tokens.view(np.uint64) & B.U64(MAP_BITS - 1)
    return (bits[slot >> B.U64(6)] >> (slot & B.U64(63))) & B.U64(1) == 1


def _counts(bits: np.ndarray, widths: list[int], margin: int):
    """(token, n) of the shingles that the map lets through, added up for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.empty(0, dtype=np.int64)]
            for words in words_of(batch.column("text"), margin):
                held += [h[in_map(bits, h)] for _, h in shingles(words, widths)]
            token, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int64))], ["token", "n"])

    return run


def _places(bits: np.ndarray, widths: list[int], window: int, longest: int):
    """A row for each text, with its words counted, and one for each shingle that the map lets through: where it
    starts, and the words around it that a window could cover, those before it counted in `before`. A word longer than
    any of the benchmark stands as a NUL, which is no word."""
    side = window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "n_words", "token", "at", "before", "near"]
        for batch in batches:
            rows, n_words = batch.column("row").to_numpy(), np.zeros(batch.num_rows, dtype=np.int64)
            for words in words_of(batch.column("text"), window):
                n_words += np.bincount(words.text[words.own], minlength=batch.num_rows)
                places, tokens = (np.concatenate(x) for x in zip(*shingles(words, widths)))
                some = in_map(bits, tokens)
                places, tokens = places[some], tokens[some]
                low = places - np.minimum(np.minimum(words.number[places], side), places)
                high = places + np.minimum(words.rest[places], window)
                for c in range(0, len(places), 4000):
                    near = []
                    for a, b in zip(low[c : c + 4000].tolist(), high[c : c + 4000].tolist()):
                        near.append(b" ".join(words.data[s:e].tobytes() if e - s <= longest else b"\0" for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist())).decode("utf-8", "replace"))
                    p = places[c : c + 4000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[words.text[p]]), pa.nulls(len(p), pa.int64()), pa.array(tokens[c : c + 4000]), pa.array(words.number[p]), pa.array((p - low[c : c + 4000]).astype(np.int32)), pa.array(near)], names
                    )
            no = [pa.nulls(len(rows), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(n_words), *no], names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Which words of each document lie in a run of `window` words of an item, and of which items.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. An item's windows are its runs of
    `window` words, or all its words where it has fewer; a window occurs in a document if the same words stand there in
    a row. The join: a window's tokens are its shingles, ordered by how rare they are in the documents. As all of them
    must be there, its rarest one is the whole prefix that has to be joined; a window with a shingle that no document
    has is dropped before. A document's shingle meets only windows of that prefix, passes if the window fits between
    the document's ends (bounds of position and length), and is then compared word by word.

    Returns a row for each document: doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated. A
    null or empty text has no words, whichever side; rows with equal or null doc_id are documents of their own. Items
    of equal item_id are one item; those with a null one mark words but are counted and listed nowhere. Other columns
    are not read. An empty table on either side gives no hit. Documents are read twice and shuffled never, but for
    the shingles around a prefix; `docs` has to be a scan or a written table.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.write(item_windows(items, window, shingle), "windows")
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # at most `window` values
    widths = sorted({min(shingle, n) for n in lengths}) or [shingle]
    longest = windows.select(F.max(F.array_max(F.transform(F.split("window", " "), lambda w: F.octet_length(w))))).first()[0] or 0
    each = windows.dropDuplicates(["window"]).select("window", "length", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("offset", "token"))
    each = scratch.write(each, "tokens")
    keyed = with_row_id(docs.select("doc_id", "text"), "row")
    counts = keyed.select("text").mapInArrow(_counts(bit_map(each), widths, window), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "counts")
    rarest = each.join(scratch.small(counts, "counts"), "token").groupBy("window", "length", "n_tokens").agg(F.count("*").alias("there"), F.min(F.struct("n", "token", "offset")).alias("first"))
    prefixes = scratch.write(rarest.where("there = n_tokens").select(F.col("first.token").alias("token"), F.col("first.offset").alias("offset"), "window", "length"), "prefixes")
    found = keyed.select("row", "text").mapInArrow(_places(bit_map(prefixes), widths, window, longest), "row long, n_words long, token long, at long, before int, near string")
    found = scratch.write(found, "found")
    met = found.where("token IS NOT NULL").join(scratch.small(prefixes, "prefixes"), "token").withColumn("from", F.col("before") - F.col("offset"))
    near = F.split("near", " ")
    fits = (F.col("from") >= 0) & (F.col("from") + F.col("length") <= F.size(near))
    same = F.slice(near, F.greatest(F.col("from"), F.lit(0)) + 1, F.col("length")) == F.split("window", " ")
    hits = scratch.write(met.where(fits).where(same).select("row", (F.col("at") - F.col("offset")).alias("begin"), "length", "window"), "hits")
    spans = hits.select("row", "begin", (F.col("begin") + F.col("length")).alias("end")).distinct()
    reach = F.max("end").over(Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(reach, F.lit(0))))).groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    of = hits.select("row", "window").distinct().join(windows.select("window", "item_id").distinct(), "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = keyed.select("row", "doc_id").join(found.where("token IS NULL").select("row", "n_words"), "row").join(covered, "row", "left").join(of, "row", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), (n_hit > 0).alias("contaminated"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op12_decontamination": op12_decontamination}
ORACLE_SQL = {
    "op12_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
places AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0),
iw AS (SELECT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM places),
starts AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
dw AS (SELECT r, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM starts),
hits AS (SELECT DISTINCT dw.r, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win),
covered AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
of AS (SELECT r, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.r = covered.r LEFT JOIN of ON d.r = of.r
"""
}

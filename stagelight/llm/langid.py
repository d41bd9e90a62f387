"""Language identification by averaged hashed subword embeddings (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagelight.llm import blocks as B

#: Bounds of the training sample: about so many documents a language, so many segments of so many characters each,
#: taken from anywhere in a text. The sample's size is all that the driver holds; it doesn't grow with the input.
DOCS_PER_LANGUAGE = 1000
#: Languages that are learned, the most frequent ones, and documents of all of them together.
MOST_LANGUAGES, MOST_DOCS = 200, 20_000
SEGMENTS, SEGMENT_CHARS = 4, 240
NGRAMS = (1, 2, 3, 4)
BUCKETS, DIM = 1 << 16, 16
EPOCHS, BATCH, RATE = 6, 16, 0.5
#: Share of correct held-out segments that the rejection threshold may lose, and the largest threshold.
LOSS, MOST_THRESHOLD = 0.001, 0.4
UNKNOWN = "und"
#: A text of more characters is taken in pieces of so many.
LONG = 60_000

_rng = np.random.default_rng(5)
NGRAM_VALUES = _rng.integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _letters() -> np.ndarray:
    """Which code points belong to words: anything alphabetic."""
    return np.array([chr(c).isalpha() or chr(c).isalnum() and not chr(c).isdigit() for c in range(0x110000)], dtype=bool)


def _code(text: str) -> np.ndarray:
    """Lower-case code points, all that is no letter as a border, with a border at either end."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(_letters()[code], code, 32).astype(np.uint32)


def _grams(code: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the n-grams that begin at the first `starts` places."""
    letter, v = code != 32, code.astype(np.uint64)
    idx, at = [], []
    for n in NGRAMS:
        m = min(len(v) - n + 1, starts)
        if m <= 0:
            continue
        if n == 1:
            ok = letter[:m]
        elif n == 2:
            ok = letter[:m] | letter[1 : 1 + m]
        else:  # borders may stand at the ends alone
            ok = np.ones(m, dtype=bool)
            for i in range(1, n - 1):
                ok &= letter[i : i + m]
        h = np.full(m, n, dtype=np.uint64)
        for i in range(n):
            h += v[i : i + m] * NGRAM_VALUES[i]
        pos = np.flatnonzero(ok)
        idx.append((B.mix(h[pos]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        at.append(pos)
    return np.concatenate(at), np.concatenate(idx)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of lower-cased words with their borders, and the bounds of each text's n-grams."""
    lower = [t.lower() for t in texts]
    row_end = np.cumsum(np.array([len(t) + 1 for t in lower], dtype=np.int64))
    code = _code(" ".join(lower))
    at, idx = _grams(code, len(code))
    row = np.searchsorted(row_end, at, side="left")  # a text's n-grams start at its leading border
    row = np.minimum(row, len(texts) - 1)
    order = np.argsort(row, kind="stable")
    return idx[order], np.searchsorted(row[order], np.arange(len(texts) + 1))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _means(table: np.ndarray, idx: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of the rows of table over each text's n-grams; 0 for a text without any."""
    out = np.zeros((len(bounds) - 1, table.shape[1]))
    n = np.diff(bounds)
    some = n > 0
    if some.any():
        for j in range(table.shape[1]):
            out[some, j] = np.add.reduceat(table[idx, j], bounds[:-1][some])
        out[some] /= n[some, None]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Model:
    """languages; table: for each bucket its embedding through the output layer; bias; temperature; threshold.

    Means and the output layer are both linear, so a text's logits are the mean of its n-grams' rows of `table`.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > LONG:
            return softmax((self._long_mean(texts[0]) + self.bias) / self.temperature)
        idx, bounds = subwords(texts)
        return softmax((_means(self.table, idx, bounds) + self.bias) / self.temperature)

    def _long_mean(self, text: str) -> np.ndarray:
        """The same mean for a long text, added up over pieces, so that its n-grams are never all held at once."""
        code, total, n = _code(text), np.zeros((1, self.table.shape[1])), 0
        for a in range(0, len(code), LONG):
            _, idx = _grams(code[a : a + LONG + max(NGRAMS) - 1], LONG)
            total += self.table[idx].sum(axis=0, dtype=np.float64)
            n += len(idx)
        return total / max(n, 1)


def fit(texts: list[str], langs: list[str], seed: int = 3) -> Model:
    """Stochastic gradient descent on segments; every fifth one is held out to calibrate temperature and threshold."""
    names = tuple(sorted(set(langs)))
    y_all = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float64)
    w, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    parts = [subwords(texts[a : a + 500]) for a in range(0, len(texts), 500)]
    idx = np.concatenate([i.astype(np.int32) for i, _ in parts])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
    rows = rng.permutation(len(texts))
    calib, train = (rows[::5], np.setdiff1d(rows, rows[::5])) if len(texts) >= 50 else (rows, rows)
    # each language weighs the same
    weight = len(train) / (len(names) * np.maximum(np.bincount(y_all[train], minlength=len(names)), 1))
    steps, step = EPOCHS * max(1, -(-len(train) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            n = bounds[part + 1] - bounds[part]
            part, n = part[n > 0], n[n > 0]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(part):
                continue
            grams = idx[B.runs(bounds[part], n)]
            at = np.cumsum(n) - n
            hidden = np.add.reduceat(emb[grams], at, axis=0) / n[:, None]
            p = softmax(hidden @ w + bias)
            p[np.arange(len(part)), y_all[part]] -= 1
            p *= weight[y_all[part], None]
            back = (p @ w.T) / n[:, None]
            w -= rate * hidden.T @ p
            bias -= rate * p.mean(axis=0)
            np.subtract.at(emb, grams, rate * 8 * np.repeat(back, n, axis=0))
    table = emb @ w
    z = []
    for a in range(0, len(calib), 500):
        part = calib[a : a + 500]
        n = bounds[part + 1] - bounds[part]
        z.append(_means(table, idx[B.runs(bounds[part], n)], np.concatenate([[0], np.cumsum(n)])) + bias)
    z = np.concatenate(z)
    y = y_all[calib]
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    losses = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = softmax(z / temperature)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    threshold = float(min(MOST_THRESHOLD, right[int(LOSS * len(right))])) if len(right) else 0.0
    return Model(names, table.astype(np.float32), bias, temperature, threshold)


def training_sample(docs: DataFrame, is_training) -> DataFrame:
    """(lang, text) segments of DOCS_PER_LANGUAGE documents a language at most, of MOST_DOCS in all, chosen by a hash of
    doc_id and text.

    A hash below a language's share of about that size picks them; of rows that are still too many, as copies of one
    row can be, those of the smallest hashes stay, cut to so many in each partition before they are shuffled.
    """
    labelled = docs.where(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return labelled.select("lang", "text").limit(0)
    most = min(DOCS_PER_LANGUAGE, MOST_DOCS // len(sizes))
    shares = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, most / n)))))
    place = F.xxhash64("doc_id", "text", F.lit(17))
    chosen = labelled.where(F.pmod(place, F.lit(1 << 20)) < F.try_element_at(shares, F.col("lang")) * (1 << 20))
    first = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = chosen.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)
    place = lambda i: F.pmod(F.xxhash64("doc_id", i), F.greatest(F.length("text") - SEGMENT_CHARS + 1, F.lit(1))).cast("int") + 1
    # short segments train the model for short texts
    length = lambda i: F.when(i == 1, 40).otherwise(SEGMENT_CHARS)
    cut = F.transform(F.sequence(F.lit(1), F.lit(SEGMENTS)), lambda i: F.substring("text", place(i), length(i)))
    return chosen.select("lang", F.explode(cut).alias("text"))


def identify(docs: DataFrame, is_training, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected; existing columns of these names are replaced, all others stay. Repeated
    rows are predicted alike, and an empty table gives an empty one.

    Learns from text and lang of the rows that `is_training` selects (null: no) and that have both; predicts from the
    text alone. lang_pred is the likeliest learned language, `und` with score 0 for a text that is null, empty or
    without a letter, or if nothing could be learned. score is the calibrated probability. rejected: `und`, or a score
    below the threshold that keeps all but LOSS of the correct held-out segments. Whole texts of any length are read.
    """
    rows = training_sample(docs, is_training).collect()
    rows = sorted((r.lang, r.text) for r in rows if has_letter(r.text))
    model = fit([t for _, t in rows], [k for k, _ in rows]) if rows else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    fields = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = ["" if t is None else t for t in part.column(text).to_pylist()]
                known = np.array([m is not None and has_letter(t) for t in texts], dtype=bool)
                best, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
                todo = np.flatnonzero(known)
                size = np.cumsum([len(texts[i]) for i in todo]) if len(todo) else []
                a = 0
                while a < len(todo):  # blocks of about 60,000 characters
                    b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + LONG, side="right")))
                    p = m.probabilities([texts[i] for i in todo[a:b]])
                    best[todo[a:b]], score[todo[a:b]] = p.argmax(axis=1), p.max(axis=1)
                    a = b
                names = [m.languages[best[i]] if known[i] else UNKNOWN for i in range(len(texts))]
                reject = ~known | (score < (m.threshold if m else 1.0))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(reject)], [*keep, "lang_pred", "score", "rejected"])

    return docs.select(*keep).mapInArrow(run, fields)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}

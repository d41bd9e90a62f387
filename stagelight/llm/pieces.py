"""SentencePiece encoding with N-best segmentations, and exact decoding (operator 3).

The pieces and scores of a vocabulary file span a lattice over a text. A forward Viterbi pass gives each place the
score of the best way to it, which is the exact rest of the way for a backward search: A* from the end takes partial
segmentations in the order of their full scores, so the first N that reach the start are the N best. No piece crosses
a place before a run of spaces, nor a character that is in no longer piece, so the lattice of a text is a chain of
small ones, one for each word; words are searched once for all their uses, and the search over the chain takes the
words' own alternatives as its steps.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.llm import blocks as B

#: Place of the public vocabulary file; only its pieces and scores are read, nothing is trained.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
SPACE = "▁"
#: An uncovered character costs this more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words kept by a Python worker in each of two generations, about 35 MB each.
CACHE = 100_000
#: Words up to this length are searched together, in arrays.
LONGEST_WORD = 40
#: Fewer words of one length than this are searched one by one, which is faster then.
FEW = 300
INFINITE = float("inf")


@dataclass
class Vocabulary:
    """Pieces as text (a space is U+2581; U+2581 itself is a space), their ids and scores, and ids of the bytes."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    surface: list[bytes]
    longest: int = 0
    unknown: float = 0.0
    cut: str = ""
    cache: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)
    lattice: Lattice | None = None

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        newline = any("\n" in p for p in self.pieces)
        inner = "" if newline else "\n"
        self.cut = "(?s).+" if crossing else ("" if newline else "\n|") + f"{SPACE}+[^{SPACE}{inner}]*|[^{SPACE}{inner}]+"


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Reads a SentencePiece model file on the driver; the vocabulary is a bounded table that tasks get by broadcast."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, surface = {}, [-1] * 256, []
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            surface.append(bytes([int(text[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            surface.append(b"")
        else:
            pieces[text] = (i, sp.get_score(i))
            surface.append(text.replace(SPACE, " ").encode())
    return Vocabulary(pieces, byte_ids, surface)


def swap(text: str) -> str:
    """Spaces become U+2581 and U+2581, which pieces use for spaces, becomes a space, which is in no piece."""
    if SPACE in text:
        return text.translate({32: SPACE, ord(SPACE): " "})
    return text.replace(" ", SPACE)


def ways_in(unit: str, vocabulary: Vocabulary) -> tuple[list[float], list[list[tuple[int, float, object]]]]:
    """Forward Viterbi: the best score to each place, and each place's ways in: (from, score, id or bytes)."""
    get, longest, n = vocabulary.pieces.get, vocabulary.longest, len(unit)
    best = [0.0] + [-INFINITE] * n
    ways: list[list] = [[] for _ in range(n + 1)]
    for i in range(n):
        base, single = best[i], False
        for j in range(i + 1, min(i + longest, n) + 1):
            got = get(unit[i:j])
            if got is not None:
                single |= j == i + 1
                ways[j].append((i, got[1], got[0]))
                if base + got[1] > best[j]:
                    best[j] = base + got[1]
        if not single:
            ways[i + 1].append((i, vocabulary.unknown, swap(unit[i]).encode("utf-8", "surrogatepass")))
            if base + vocabulary.unknown > best[i + 1]:
                best[i + 1] = base + vocabulary.unknown
    return best, ways


def expand(steps: list, vocabulary: Vocabulary) -> np.ndarray:
    ids: list[int] = []
    for x in steps:
        if isinstance(x, int):
            ids.append(x)
        else:
            ids.extend(vocabulary.byte_ids[b] for b in x)
    return np.array(ids, dtype=np.int32)


def nbest_of_unit(unit: str, n: int, vocabulary: Vocabulary) -> list[tuple[float, np.ndarray]]:
    """The n best segmentations, best first, by A* from the end; ties go to the one nearer the start, then to order."""
    best, ways = ways_in(unit, vocabulary)
    agenda, out, count = [(-best[-1], len(unit), 0, 0.0, None)], [], 0
    while agenda and len(out) < n:
        f, at, _, so_far, tail = heapq.heappop(agenda)
        if at == 0:
            steps = []
            while tail is not None:
                steps.append(tail[0])
                tail = tail[1]
            out.append((-f, expand(steps, vocabulary)))
            continue
        for i, score, what in ways[at]:
            count += 1
            heapq.heappush(agenda, (-(so_far + score + best[i]), i, count, so_far + score, (what, tail)))
    return out


def best_of_unit(unit: str, vocabulary: Vocabulary) -> tuple[bytes, float, float]:
    """(ids as int32, score, loss of the second best): the first way of A*, and the least loss of what it leaves."""
    best, ways = ways_in(unit, vocabulary)
    at, steps, loss = len(unit), [], INFINITE
    while at:
        top, second, taken = -INFINITE, -INFINITE, None
        for way in ways[at]:
            f = best[way[0]] + way[1]
            if f > top:
                top, second, taken = f, top, way
            elif f > second:
                second = f
        loss = min(loss, top - second)
        steps.append(taken[2])
        at = taken[0]
    return expand(steps[::-1], vocabulary).tobytes(), best[-1], loss


def nbest_of_chain(units: list[str], losses: np.ndarray, n: int, vocabulary: Vocabulary, alternatives) -> list[tuple[float, tuple]]:
    """(loss, changes) of the n best ways through the chain; changes: (unit, rank) pairs away from the best.

    Only the n - 1 units whose second best loses least can change: a way that changes another one comes after n ways.
    """
    m = min(n - 1, len(units))
    if m <= 0 or not np.isfinite(losses).any():
        return [(0.0, ())]
    near = np.argpartition(losses, m - 1)[:m]
    near = sorted(int(i) for i in near if np.isfinite(losses[i]))
    options = [alternatives(units[i]) for i in near]
    # states: changes made so far, by place in `near`; each way is built once, from its last change on
    agenda, out, count = [(0.0, 0, ())], [], 0
    while agenda and len(out) < n:
        loss, _, changes = heapq.heappop(agenda)
        out.append((loss, tuple((near[i], r) for i, r in changes)))
        follow = []
        if changes:
            i, r = changes[-1]
            if r + 1 < len(options[i]):
                follow.append((changes[:-1] + ((i, r + 1),), loss - (options[i][0][0] - options[i][r][0]) + (options[i][0][0] - options[i][r + 1][0])))
        for i in range(changes[-1][0] + 1 if changes else 0, len(near)):
            if len(options[i]) > 1:
                follow.append((changes + ((i, 1),), loss + options[i][0][0] - options[i][1][0]))
        for new, cost in follow:
            count += 1
            heapq.heappush(agenda, (cost, count, new))
    return out


RESULT = "token_ids array<int>, score double, nbest array<struct<score:double,changes:array<struct<token_start:long,n_tokens:long,ids:array<int>>>>>"


class Lattice:
    """The Viterbi pass of `best_of_unit` over many words of one length at once; pieces are found by rolling hashes."""

    BASE, SPREAD, SEEN_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), 20

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        pieces = list(vocabulary.pieces.items())
        keys = B.mix(np.array([self._hash(p) for p, _ in pieces], dtype=np.uint64))
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.ids = np.array([i for _, (i, _) in pieces], dtype=np.int64)
        self.scores = np.array([x for _, (_, x) in pieces], dtype=np.float64)
        # pieces by the high bits of their hash; those whose place is taken go to the next table
        self.tables, rest, bits = [], np.arange(len(keys)), 18
        self.keys = keys
        while len(rest):
            slot = (keys[rest] * np.uint64(2 * len(self.tables) + 1) >> np.uint64(64 - bits)).astype(np.int64)
            table = np.full(1 << bits, -1, dtype=np.int32)
            table[slot] = rest
            self.tables.append(table)
            rest = rest[table[slot] != rest]
        self.bits = bits
        # one bit of most spans tells that they are no piece
        self.seen = np.zeros(1 << self.SEEN_BITS, dtype=bool)
        self.seen[self._slot(np.array([self._hash(p) for p, _ in pieces], dtype=np.uint64))] = True

    @classmethod
    def _hash(cls, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(cls.BASE) + ord(c) + 1) % (1 << 64)
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        slot = h * self.SPREAD
        slot >>= np.uint64(64 - self.SEEN_BITS)
        return slot.view(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that are those of pieces, and the pieces' indices."""
        at = np.flatnonzero(self.seen[self._slot(h)])
        h = B.mix(h[at])
        out = np.full(len(h), -1, dtype=np.int64)
        for k, table in enumerate(self.tables):
            got = table[(h * np.uint64(2 * k + 1) >> np.uint64(64 - self.bits)).view(np.int64)]
            hit = got >= 0
            hit[hit] = self.keys[got[hit]] == h[hit]
            out[hit] = got[hit]
        found = out >= 0
        return at[found], out[found]

    def best(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """best_of_unit of words of one length."""
        n, size, longest = len(words), len(words[0]), self.v.longest
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, size).astype(np.uint64) + np.uint64(1)
        pre = np.zeros((size + 1, n), dtype=np.uint64)
        power = [np.uint64(1)]
        for j in range(size):
            pre[j + 1] = pre[j] * self.BASE + code[:, j]
            power.append(np.uint64(int(power[-1]) * int(self.BASE) % (1 << 64)))
        top = np.full((size + 1, n), -INFINITE)
        top[0] = 0
        loss = np.full((size + 1, n), INFINITE)
        back, piece = np.zeros((size + 1, n), dtype=np.int16), np.full((size + 1, n), -1, dtype=np.int64)
        rows = np.arange(n)
        for j in range(1, size + 1):
            second = np.full(n, -INFINITE)
            for i in range(max(0, j - longest), j):
                at, got = self.find(pre[j] - pre[i] * power[j - i])
                if i == j - 1:
                    single = np.full(n, -1, dtype=np.int64)
                    single[at] = got
                    f = top[i] + self.v.unknown
                    f[at] = top[i][at] + self.scores[got]
                    at, got = rows, single
                elif len(at):
                    f = top[i][at] + self.scores[got]
                else:  # most spans are no piece
                    continue
                old = top[j][at]
                better = f > old
                second[at] = np.where(better, old, np.maximum(second[at], f))
                at, f, got = at[better], f[better], got[better]
                top[j][at], back[j][at], piece[j][at] = f, i, got
            loss[j] = np.minimum(loss[back[j], rows], top[j] - second)
        # ways back, all words a step at a time
        at, steps = np.full(n, size), []
        odd = np.zeros(n, dtype=bool)
        while at.any():
            got = piece[at, rows]
            odd |= (at > 0) & (got < 0)
            steps.append(np.where(at > 0, self.ids[got], -1))
            at = np.where(at > 0, back[at, rows], 0)
        ids = np.stack(steps[::-1]).T.astype(np.int32)
        some = ids >= 0
        ends = np.cumsum(some.sum(axis=1)) * 4
        raw, score, losses = ids[some].tobytes(), top[size].tolist(), loss[size].tolist()
        starts, ends = (ends - some.sum(axis=1) * 4).tolist(), ends.tolist()
        return [best_of_unit(w, self.v) if o else (raw[a:b], x, y) for w, o, a, b, x, y in zip(words, odd.tolist(), starts, ends, score, losses)]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, n: int):
        self.v, self.n, self.finder = vocabulary, n, re.compile(vocabulary.cut).findall
        self.options: dict[str, list] = {}
        if vocabulary.lattice is None:  # one for all tasks of a worker
            vocabulary.lattice = Lattice(vocabulary)
        self.lattice = vocabulary.lattice

    def learn(self, units: set[str]) -> None:
        """Puts the best segmentations of units into the cache. When it is full, those of other units become the
        older generation, from which units come back when they are met again, and the one before that goes."""
        v = self.v
        new = units.difference(v.cache)
        if len(v.cache) + len(new) > CACHE:
            v.older, v.cache = v.cache, {u: v.cache[u] for u in units.intersection(v.cache)}
        by_size: dict[int, list[str]] = {}
        for u in new:
            got = v.older.get(u)
            if got is not None:
                v.cache[u] = got
            elif len(u) <= LONGEST_WORD:
                by_size.setdefault(len(u), []).append(u)
            else:
                v.cache[u] = best_of_unit(u, v)
        for words in by_size.values():
            if len(words) < FEW:
                v.cache.update((u, best_of_unit(u, v)) for u in words)
                continue
            for a in range(0, len(words), 20_000):
                part = words[a : a + 20_000]
                v.cache.update(zip(part, self.lattice.best(part)))

    def alternatives(self, unit: str) -> list:
        got = self.options.get(unit)
        if got is None:
            if len(self.options) > CACHE // 10:
                self.options.clear()
            got = self.options[unit] = nbest_of_unit(unit, self.n, self.v)
        return got

    def encode(self, text: str) -> tuple[np.ndarray, float, list[dict]]:
        """ids, score, and the n best: their scores and what they change in the ids of the best."""
        if not text:
            return np.empty(0, dtype=np.int32), 0.0, [{"score": 0.0, "changes": []}]
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[tuple | None]:
        """encode of each text; words that are new are searched together."""
        every = [self.finder(SPACE + swap(t)) if t else [] for t in texts]
        self.learn(set().union(*every))
        return [None if t is None else self.encode_units(u) if t else self.encode("") for t, u in zip(texts, every)]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, float, list[dict]]:
        cache, v = self.v.cache, self.v
        parts, scores, losses = zip(*[cache[u] for u in units])
        ids, score = np.frombuffer(b"".join(parts), dtype=np.int32), float(sum(scores))
        if self.n < 2:
            return ids, score, []
        ways = nbest_of_chain(units, np.array(losses), self.n, v, self.alternatives)
        place = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4)]) if len(ways) > 1 else None
        out = []
        for loss, changes in ways:
            other = [{"token_start": int(place[i]), "n_tokens": len(parts[i]) // 4, "ids": self.alternatives(units[i])[r][1].tolist()} for i, r in changes]
            out.append({"score": score - loss, "changes": other})
        return ids, score, out


class Decoder:
    """The text that ids spell, without the space that encoding puts before it."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = np.array([len(x) for x in vocabulary.surface], dtype=np.int64)
        self.raw = np.frombuffer(b"".join(vocabulary.surface), dtype=np.uint8)
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> bytes:
        data = self.raw[B.runs(self.start[ids], self.size[ids])].tobytes() if len(ids) else b""
        return data[1:] if data[:1] == b" " else data


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, n: int = NBEST, text: str = "text", digest: str | None = None) -> DataFrame:
    """docs without `text`, with RESULT; existing columns of these names are replaced.

    token_ids: the best segmentation of the whole text, with a space put before it; characters in no piece become
    their UTF-8 bytes. nbest: the n best, best first (fewer if there are no more): the score and the runs of
    token_ids, by place and length, that other ids replace. A null text gives nulls, an empty one no ids. With
    `digest`, a column of that name has the SHA-256 of the bytes that the ids decode to, from the same pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = ["token_ids", "score", "nbest", *([digest] if digest else [])]
    keep = [c for c in docs.columns if c != text and c not in names]
    result = RESULT + (f", {digest} string" if digest else "")
    fields = docs.select(*keep).schema
    fields = type(fields)([*fields, *docs.sparkSession.createDataFrame([], result).schema])
    change = pa.struct([("token_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    kinds = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value, n), Decoder(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                rows = encoder.encode_many(part.column(text).to_pylist())
                ids = [r[0] if r else np.empty(0, dtype=np.int32) for r in rows]
                bounds = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                null = np.array([r is None for r in rows], dtype=bool)
                column = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)), mask=pa.array(null))
                out = [column, pa.array([r[1] if r else None for r in rows], pa.float64()), pa.array([r[2] if r else None for r in rows], kinds)]
                if digest:
                    out.append(pa.array([hashlib.sha256(decoder.decode(r[0])).hexdigest() if r else None for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *out], [*keep, *names])

    return docs.select(*keep, text).mapInArrow(run, fields)


def decode_tokens(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """encoded with `out`: the text that the ids spell, without the space before it. Exact for what encode_texts gives."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    keep = [c for c in encoded.columns if c != out]
    fields = encoded.select(*keep).schema
    fields = type(fields)([*fields]).add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [decoder.decode(x.values.to_numpy(zero_copy_only=False)).decode("utf-8", "replace") if x.is_valid else None for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, out])

    return encoded.mapInArrow(run, fields)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vocabulary = load_vocabulary()
    out = encode_texts(docs, vocabulary, digest="decoded_sha256")
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "score", "nbest", "decoded_sha256")


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
ORACLE_SQL: dict[str, str] = {}

"""MinHash near-dedup with b-bit signatures (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.llm import blocks as B
from stagelight.llm.common import Scratch, fresh, with_row_id
from stagelight.llm.components import components
from stagelight.llm.groups import shared_keys, whole_groups

SHINGLE = 5
#: 32 bands of 4 minima: a pair of similarity 0.75 shares no band with probability 5e-6.
BANDS, ROWS = 32, 4
BITS = 4
PERMUTATIONS = BANDS * ROWS
#: Candidates whose collision-corrected estimate is below this are not confirmed on full sets. It lies 5.7 standard
#: errors of the estimate (0.04 at similarity 0.75) under the least similarity of a link: 6e-9 of such pairs.
LEAST_ESTIMATE = 0.52
#: Members of a band bucket that are compared at once.
BUCKET = 1024
#: Members of a bucket with several components whose full sets meet at once; larger ones meet block by block.
BLOCK = 2048
#: Bytes of full sets in a block, and of the cells that a task holds at once.
BLOCK_SETS, HELD_SETS = 6 << 20, 24 << 20
#: Values in at least so many sets are counted by matrix products.
DENSE = 16

_rng = np.random.default_rng(7)
MULTIPLIERS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_VALUES = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
DOCS = "_row long, doc_id long, n_shingles int, cls binary, bands array<long>, sig binary"


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their bounds."""
    low = B.LOWER[data]
    start, end, first = B.word_spans(low, bounds)
    words = B.span_hashes(low, start, end)[0]
    n_words = np.diff(first)
    n = np.where(n_words >= size, n_words - size + 1, 0)
    rows = [np.repeat(np.arange(len(n)), n)]
    hashes = [B.rolling(words, size)[B.runs(first[:-1], n)]]
    for k in range(1, size):  # texts of fewer words: the whole sequence
        short = np.flatnonzero(n_words == k)
        if len(short):
            rows.append(short)
            hashes.append(B.rolling(words, k)[first[short]])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[keep], h[keep]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed b-bit signatures of the rows that have shingles."""
    at = bounds[:-1][np.diff(bounds) > 0]
    minima = np.empty((len(at), PERMUTATIONS), dtype=np.uint64)
    for p in range(PERMUTATIONS):
        minima[:, p] = np.minimum.reduceat(h * MULTIPLIERS[p], at)
    minima = B.mix(minima)
    keys = B.mix((minima.reshape(-1, BANDS, ROWS) * BAND_VALUES).sum(axis=2, dtype=np.uint64))
    low = (minima & np.uint64((1 << BITS) - 1)).reshape(len(at), -1, 64 // BITS)
    packed = np.zeros(low.shape[:2], dtype=np.uint64)
    for i in range(64 // BITS):
        packed |= low[:, :, i] << np.uint64(BITS * i)
    return keys, packed


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = B.utf8(batch.column("text"))
        for a, b in B.blocks(off):
            buf, bounds = data[off[a] : off[b]], off[a : b + 1] - off[a]
            h, at = shingle_sets(buf, bounds, SHINGLE)
            n = np.diff(at)
            some = n > 0
            keys, sig = signatures(h, at) if some.any() else (np.empty((0, BANDS), np.uint64), np.empty((0, 8), np.uint64))
            low = bytes(B.LOWER[buf])
            cls = [hashlib.blake2b(b" ".join(low[bounds[i] : bounds[i + 1]].split()), digest_size=16).digest() if some[i] else None for i in range(b - a)]
            width = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
            raw = sig.tobytes()
            place = np.cumsum(some) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(n.astype(np.int32)), pa.array(cls, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(width), pa.array(keys.reshape(-1).view(np.int64))), pa.array([raw[64 * place[i] : 64 * place[i] + 64] if some[i] else None for i in range(b - a)], pa.binary())],
                ["_row", "doc_id", "n_shingles", "cls", "bands", "sig"],
            )


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from the equal b-bit values of packed signatures, corrected for chance collisions (Li and König, 2010)."""
    x = a ^ b
    x = x | (x >> np.uint64(1))
    x = x | (x >> np.uint64(2))
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((PERMUTATIONS - differ) / PERMUTATIONS - chance) / (1 - chance)


def _packed(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sig = np.frombuffer(bytes(B.utf8(table.column("sig"))[0]), dtype=np.uint64).reshape(-1, 8)
    cls = np.frombuffer(bytes(B.utf8(table.column("cls"))[0]), dtype="S16")
    return sig, cls


def _binary16(values: np.ndarray) -> pa.Array:
    raw = values.tobytes()
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(0, 16 * len(values) + 1, 16, dtype=np.int32)), pa.py_buffer(raw)])


def _best(child, other, est, earlier) -> tuple:
    """Of candidate rows, each child's best one and its best earlier one."""
    out = []
    for pick in (slice(None), earlier):
        c, o, e = child[pick], other[pick], est[pick]
        order = np.lexsort((-o, e, c))
        c, o, e = c[order], o[order], e[order]
        last = np.append(c[1:] != c[:-1], True) if len(c) else np.empty(0, dtype=bool)
        out.append((c[last], o[last], e[last]))
    return out


def _nearest(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Each bucket member's most similar other member, and its most similar earlier one, by estimate.

    Buckets beyond `most` members are compared in blocks, each with itself and with the bucket's first block. Members
    of these that find none there are named with themselves (kind 2), so that the search across components has them.
    """

    def rows(cls, found):
        for kind, (c, o, e) in enumerate(found):
            yield pa.RecordBatch.from_arrays([_binary16(cls[c]), _binary16(cls[o]), pa.array(e), pa.array(np.full(len(c), kind, dtype=np.int32))], ["child", "other", "est", "kind"])

    def dense(cls, sig, pool):
        """pool: index of the first block's rows in front of this block's, or none."""
        n = len(cls)
        parts = []
        for a in range(0, n, 32):
            est = estimate(sig[a : a + 32, None, :], sig[None, :, :])
            est[np.arange(len(est)), np.arange(a, a + len(est))] = -1
            i, j = np.nonzero(est >= LEAST_ESTIMATE)
            if len(i):
                parts.append(_best(i + a, j, est[i, j], j < i + a))
        for kind in (0, 1):
            if parts:
                c, o, e = (np.concatenate([p[kind][x] for p in parts]) for x in range(3))
                own = c >= pool
                yield c[own], o[own], e[own]

    first: tuple | None = None
    for table, part in whole_groups(batches, "key", most * 4):
        sig, cls = _packed(table)
        key = table.column("key").to_numpy()
        begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        size = np.diff(begin)
        # small buckets: all pairs of all of them at once
        few = np.flatnonzero((size > 1) & (size <= 32)) if not part else np.empty(0, dtype=np.int64)
        for at in range(0, len(few), 2000):
            some = few[at : at + 2000]
            member = B.runs(begin[some], size[some])
            i = np.repeat(member, np.repeat(size[some], size[some]))
            j = B.runs(np.repeat(begin[some], size[some]), np.repeat(size[some], size[some]))
            keep = i != j
            i, j = i[keep], j[keep]
            est = estimate(sig[i], sig[j])
            keep = est >= LEAST_ESTIMATE
            i, j, est = i[keep], j[keep], est[keep]
            if len(i):
                yield from rows(cls, _best(i, j, est, j < i))
        for g in np.arange(len(size)) if part else np.flatnonzero(size > 32):
            a, b = int(begin[g]), int(begin[g + 1])
            if not part or first is None or first[0] != key[a]:
                first = (key[a], sig[a : a + most], cls[a : a + most])
            for x in range(a, b, most):
                s, c = sig[x : min(x + most, b)], cls[x : min(x + most, b)]
                alone = len(c) == len(first[2]) and c[0] == first[2][0]
                pool = 0 if alone else len(first[2])
                both_c = c if alone else np.concatenate([first[2], c])
                found = list(dense(both_c, s if alone else np.concatenate([first[1], s]), pool))
                yield from rows(both_c, found)
                lone = np.setdiff1d(np.arange(pool, len(both_c)), found[0][0] if found else [])
                if len(lone) and (part or b - a > most):
                    yield from rows(both_c, [(z := np.empty(0, dtype=np.int64), z, np.empty(0))] * 2 + [(lone, lone, np.zeros(len(lone)))])


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets: a product of 0-1 matrices for values in many sets,
    their pairs for values in a few."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    row = np.repeat(np.arange(len(sets)), size)[order]
    new = np.append(True, flat[order][1:] != flat[order][:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(flat)))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    often = first[times >= DENSE]
    for at in range(0, len(often), 1024):
        some = often[at : at + 1024]
        n = times[np.searchsorted(first, some)]
        one = np.zeros((len(sets), len(some)), dtype=np.float32)
        one[row[B.runs(some, n)], np.repeat(np.arange(len(some)), n)] = 1
        out += one[left] @ one[right].T
    to_left, to_right = np.full(len(sets), -1), np.full(len(sets), -1)
    to_left[left], to_right[right] = np.arange(len(left)), np.arange(len(right))
    for t in range(2, DENSE):
        starts = first[times == t]
        for at in range(0, len(starts), 20_000):
            members = row[starts[at : at + 20_000, None] + np.arange(t)]
            i, j = np.broadcast_arrays(to_left[members][:, :, None], to_right[members][:, None, :])
            keep = (i >= 0) & (j >= 0)
            np.add.at(out, (i[keep], j[keep]), 1)
    return out


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links across components in each cell (a bucket, or two blocks of a large one), all pairs by their full sets:
    a spanning forest of them, a row for each member that has one."""
    for table, _ in whole_groups(batches, "pair", HELD_SETS, lambda b: b.nbytes, whole=True):
        pair = table.column("pair").to_numpy()
        left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        cls, root = (np.frombuffer(bytes(B.utf8(table.column(c))[0]), dtype="S16") for c in ("cls", "root"))
        data, off = B.utf8(table.column("shingles"))
        begin = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])
        for a, b in zip(begin[:-1], begin[1:]):
            own = np.unique(root[a:b], return_inverse=True)[1]
            if own.max(initial=0) == 0:
                continue
            sets = [np.frombuffer(bytes(data[off[i] : off[i + 1]]), dtype=np.uint64) for i in range(a, b)]
            size = np.array([len(x) for x in sets], dtype=np.int64)
            li, ri = np.flatnonzero(left[a:b]), np.flatnonzero(right[a:b])
            # pairs within the most frequent component are none of those asked for
            most = np.bincount(own).argmax()
            sides = [(li[own[li] != most], ri)]
            if not (left[a:b] & right[a:b]).all():
                sides.append((li[own[li] == most], ri[own[ri] != most]))
            ends = []
            for x, y in sides:
                if len(x) and len(y):
                    common = common_counts(sets, x, y).astype(np.float64)
                    i, j = np.nonzero((100 * common >= percent * (size[x][:, None] + size[y][None, :] - common)) & (own[x][:, None] != own[y][None, :]))
                    ends.append((x[i], y[j]))
            if not ends:
                continue
            i, j = (np.concatenate(side) for side in zip(*ends))
            if not len(i):
                continue
            top = np.arange(b - a)
            while True:
                new = top.copy()
                np.minimum.at(new, i, top[j])
                np.minimum.at(new, j, top[i])
                if (new == top).all():
                    break
                top = new
            some = np.flatnonzero(top != np.arange(b - a))
            yield pa.RecordBatch.from_arrays([_binary16(cls[a:b][some]), _binary16(cls[a:b][top[some]])], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = B.utf8(batch.column("text"))
        for a, b in B.blocks(off):
            h, at = shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], SHINGLE)
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("cls").slice(a, b - a), pa.array([raw[8 * at[i] : 8 * at[i + 1]] for i in range(b - a)], pa.binary())], ["cls", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("x"), batch.column("y")
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (left, right))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """`labelled_rows` without its keys: doc_id, n_shingles, component_id, kept."""
    return labelled_rows(with_row_id(docs.select("doc_id", "text")), percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs with one row of each component: one of the smallest doc_id, the first of equal ones. Rows without a word
    all stay. Columns stay as they are, whatever their names. An empty table stays empty."""
    scratch, row = Scratch(docs.sparkSession, "drop"), fresh(docs, "_row")
    keyed = with_row_id(docs, row)
    labels = labelled_rows(keyed.select(F.col(row).alias("_row"), "doc_id", "text"), percent)
    dropped = scratch.write(labels.where("_row != keep_row").select(F.col("_row").alias(row)), "dropped")
    return keyed.join(scratch.small(dropped, "dropped"), row, "left_anti").drop(row)


def labelled_rows(keyed: DataFrame, percent: int) -> DataFrame:
    """_row, doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id = component_id),
    keep_row (the row that stands for the component).

    Texts link if 100 * |intersection| >= percent * |union| of their sets of 5-word shingles, words lower-cased in
    A-Z only. A text of one to four words is one shingle; texts that are null or have no word link with nothing, not
    even each other. Equal word sequences are one class and link at once. Band buckets give candidates, b-bit
    signatures estimate them, and full sets confirm each link: first each class's best candidates, then, where a
    bucket still holds several components, all its pairs across them, in blocks. So no link between members of a bucket
    that could join two components is left out, but for pairs whose only estimates are below LEAST_ESTIMATE. A dense
    group costs a few rows a member; a bucket of many components costs its pairs, and a copy of each member's set for
    each of its blocks. Rows with equal doc_id are texts of their own under one name; a null doc_id is kept unless its component has a number. Other columns are not read. `docs` has to be a
    scan or a written table.
    """
    scratch = Scratch(keyed.sparkSession, "minhash")
    signed = scratch.write(keyed.mapInArrow(_sign, DOCS), "docs")
    classes = signed.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("low"), "_row")).alias("first"), F.min(F.struct("_row", "bands", "sig")).alias("r"))
    classes = scratch.write(classes.select("cls", "first", "r._row", "r.bands", "r.sig"), "classes")
    thin = classes.select(F.explode("bands").alias("key"), "cls")
    multi = scratch.write(thin.repartition("key").sortWithinPartitions("key").mapInArrow(shared_keys("key"), "key long, cls binary"), "multi")
    sigs = classes.select("cls", "sig")
    near = multi.join(sigs, "cls").repartition("key").sortWithinPartitions("key", "cls").mapInArrow(partial(_nearest, most=BUCKET), "child binary, other binary, est double, kind int")
    near = scratch.write(near.groupBy("child", "kind").agg(F.max_by("other", F.struct("est", "other")).alias("other")), "near")
    best = near.where("kind < 2")
    pairs = scratch.write(best.select(F.least("child", "other").alias("a"), F.greatest("child", "other").alias("b")).distinct(), "pairs")
    involved = near.select(F.explode(F.array("child", "other")).alias("cls")).distinct()
    rows = scratch.write(classes.select("cls", "_row").join(involved, "cls", "left_semi"), "rows")
    # shuffled at every size: these rows grow with the near copies, and a broadcast of a few would tell nothing about many
    sets = scratch.write(keyed.select("_row", "text").join(rows.hint("shuffle_hash"), "_row").mapInArrow(_sets, "cls binary, shingles binary"), "sets")

    x = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    links = scratch.write(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a binary, b binary"), "links1")
    roots = scratch.write(components(links, scratch, "first"), "roots1")
    labelled = multi.join(sets.select("cls", F.length("shingles").alias("bytes")), "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "bytes", F.coalesce("root", "cls").alias("root"))
    labelled = scratch.write(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("lo != hi").select("key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_SETS)).cast("int").alias("blocks"))
    cells = labelled.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("pair"), "cls", "root", (F.col("own") <= F.col("with")).alias("left"), (F.col("own") >= F.col("with")).alias("right"))
    across = cells.join(sets, "cls").repartition("pair").sortWithinPartitions("pair").mapInArrow(partial(_across, percent=percent), "a binary, b binary")
    later = scratch.write(across.distinct(), "links2")
    if not later.isEmpty():
        roots = scratch.write(components(links.unionByName(later), scratch, "second"), "roots2")
    labels = classes.select("cls", "first").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    firsts = labels.groupBy("root").agg(F.min("first").alias("first"))
    labels = labels.select("cls", "root").join(firsts, "root").select("cls", F.col("first.low").alias("component"), F.col("first._row").alias("keep"))
    labels = scratch.write(labels, "labels")
    out = signed.select("_row", "doc_id", "n_shingles", "cls").join(scratch.small(labels, "labels"), "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    keep = F.when(F.col("cls").isNull(), F.col("_row")).otherwise(F.col("keep"))
    return out.select("_row", "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), keep.alias("keep_row"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}

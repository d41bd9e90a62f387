"""Embedding near-dedup by cross-polytope hashing (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.llm import blocks as B
from stagelight.llm.common import Scratch, with_row_id
from stagelight.llm.components import components
from stagelight.llm.groups import shared_keys, whole_groups

LEAST_COSINE = 0.9
#: Share of the pairs at the least cosine that may share no bucket in any table.
MISS = 0.005
#: Members of a bucket that are compared at once.
BLOCK = 1024
#: Bytes of the cells that a task holds at once.
HELD = 32 << 20


def parameters(rows: int, dim: int) -> tuple[int, int]:
    """(polytopes of a key, tables) for so many rows: unrelated rows share a bucket about once a table and probe.

    A pair of cosine 0.9 shares one of the probed buckets of a table with probability 0.93 * 0.67 ** (polytopes - 1),
    measured in 64 dimensions; tables are as many as MISS asks for.
    """
    polytopes = max(1, min(6, math.ceil(math.log(max(rows, 2)) / math.log(2 * dim))))
    share = 0.93 * 0.67 ** (polytopes - 1)
    return polytopes, math.ceil(math.log(MISS) / math.log(1 - share))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def bucket_keys(x: np.ndarray, polytopes: int, tables: int) -> np.ndarray:
    """[row, table, probe] keys: the nearest vertices of rotated polytopes, and with one vertex each replaced by the
    second nearest, most doubtful first."""
    n, d = x.shape
    width = max(2, 1 << (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - d)))
    rng = np.random.default_rng(23)
    out = np.empty((n, tables, polytopes + 1), dtype=np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        main, second, gap = (np.empty((n, polytopes), dtype=kind) for kind in (np.int64, np.int64, np.float64))
        for k in range(polytopes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            first = size.argmax(axis=1)
            top = size[rows, first]
            size[rows, first] = -1
            other = size.argmax(axis=1)
            main[:, k] = 2 * first + (y[rows, first] > 0)
            second[:, k] = 2 * other + (y[rows, other] > 0)
            gap[:, k] = top - size[rows, other]
        scale = B.U64(2 * width) ** np.arange(polytopes, dtype=np.uint64)
        order = np.argsort(gap, axis=1)
        for p in range(polytopes + 1):
            code = main.copy()
            if p:
                code[rows, order[:, p - 1]] = second[rows, order[:, p - 1]]
            out[:, t, p] = B.mix((code.astype(np.uint64) * scale).sum(axis=1, dtype=np.uint64) + B.U64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return out


def _vectors(table: pa.Table | pa.RecordBatch, column: str = "vector") -> np.ndarray:
    data, off = B.utf8(table.column(column))
    return np.frombuffer(bytes(data), dtype="<f8").reshape(len(off) - 1, -1)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows scaled to length 1 in double precision, as bytes."""
    for batch in batches:
        out = []
        for v in batch.column("embedding"):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x / np.abs(x).max()
            out.append((x / math.sqrt(float(x @ x))).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "low", "n", "dim")), pa.array(out, pa.binary())], ["cls", "low", "n", "dim", "vector"])


def _keys(polytopes: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dim = batch.column("dim").to_numpy()
                for d in np.unique(dim):
                    some = batch.filter(pa.array(dim == d))
                    for a in range(0, some.num_rows, 2000):
                        part = some.slice(a, 2000)
                        keys = bucket_keys(_vectors(part), polytopes, tables) ^ B.mix(np.full(1, d, dtype=np.uint64))
                        flat = keys.reshape(part.num_rows, -1)
                        raw = flat.tobytes()
                        w = flat.shape[1]
                        yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([raw[8 * w * i : 8 * w * (i + 1)] for i in range(part.num_rows)], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, w * part.num_rows + 1, w, dtype=np.int32)), pa.array(flat.reshape(-1).view(np.int64)))], ["cls", "signature", "keys"])

    return run


def _links(polytopes: int, least: float):
    """In each cell (a bucket, or two blocks of a large one): (cls, links, root). Links are counted in the one cell of
    a pair's smallest common key; root is the smallest row of the cell that links lead to."""
    probes = polytopes + 1

    def cell(rows: pa.Table) -> pa.RecordBatch | None:
        cls, n = rows.column("cls").to_numpy(), rows.column("n").to_numpy()
        left, right = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        key = rows.column("key").to_numpy().view(np.uint64)[0]
        x = _vectors(rows)
        sig = np.frombuffer(bytes(B.utf8(rows.column("signature"))[0]), dtype=np.uint64).reshape(len(cls), -1, probes)
        same = bool((left & right).all())
        ii, jj = [], []
        li, ri = np.flatnonzero(left), np.flatnonzero(right)
        for a in range(0, len(li), 256):
            hit = (x[li[a : a + 256]] @ x[ri].T) >= least
            i, j = np.nonzero(hit)
            i, j = li[a : a + 256][i], ri[j]
            keep = cls[i] < cls[j] if same else cls[i] != cls[j]
            ii.append(i[keep])
            jj.append(j[keep])
        i, j = np.concatenate(ii), np.concatenate(jj)
        if not len(i):
            return None
        links = np.zeros(len(cls), dtype=np.int64)
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        for a in range(0, len(i), 4000):
            p, q = i[a : a + 4000], j[a : a + 4000]
            common = (sig[p][:, :, :, None] == sig[q][:, :, None, :]).any(axis=3)
            own = np.where(common, sig[p], top).reshape(len(p), -1).min(axis=1) == key
            np.add.at(links, p[own], n[q[own]])
            np.add.at(links, q[own], n[p[own]])
        root = cls.copy()
        while True:
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            if (new == root).all():
                break
            root = new
        some = np.zeros(len(cls), dtype=bool)
        some[i] = some[j] = True
        return pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(links[some]), pa.array(root[some])], ["cls", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a cell has two blocks at most, so whole cells fit
        for table, _ in whole_groups(batches, "pair", HELD, lambda b: b.nbytes, whole=True):
            pair = table.column("pair").to_numpy()
            begin = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])
            for a, b in zip(begin[:-1], begin[1:]):
                if b - a > 1 and (out := cell(table.slice(int(a), int(b - a)).combine_chunks())) is not None:
                    yield out

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept.

    Vectors link if they share a bucket of some table and their cosine, in double precision, is at least `least`.
    Parameters follow from the number of distinct vectors; at cosine 0.9 all but MISS of the pairs are found, above
    it more. Null, empty and zero vectors, and those with null, NaN or infinite components, link with nothing; vectors
    of different lengths never link. Equal vectors are one class with its count, so a hot vector costs one row. Large
    buckets are split into blocks that meet pair by pair; a task holds two blocks. Rows with equal vec_id are vectors
    of their own; null vec_ids get null components unless linked with a numbered one. Labels and other columns are not
    read. `vectors` has to be a scan or a written table.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    infinite = F.lit(float("inf"))
    usable = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = with_row_id(vectors.select("vec_id", "embedding")).withColumn("usable", usable)
    classes = keyed.where("usable").groupBy("embedding").agg(F.min("_row").alias("cls"), F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = classes.withColumn("dim", F.size("embedding")).mapInArrow(_unit, "cls long, low long, n long, dim int, vector binary")
    classes = scratch.write(classes, "classes")
    rows, dim = classes.agg(F.count("*"), F.max("dim")).first()
    polytopes, tables = parameters(rows, dim or 2)
    signed = scratch.write(classes.mapInArrow(_keys(polytopes, tables), "cls long, signature binary, keys array<long>"), "signed")
    thin = signed.select(F.explode(F.array_distinct("keys")).alias("key"), "cls")
    multi = scratch.write(thin.repartition("key").sortWithinPartitions("key").mapInArrow(shared_keys("key"), "key long, cls long"), "multi")
    size = multi.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cells = multi.join(size, "key").withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("pair"), "cls", (F.col("own") <= F.col("with")).alias("left"), (F.col("own") >= F.col("with")).alias("right"))
    payload = classes.select("cls", "n", "vector").join(signed.select("cls", "signature"), "cls")
    found = cells.join(payload, "cls").repartition("pair").sortWithinPartitions("pair").mapInArrow(_links(polytopes, least), "cls long, links long, root long")
    found = scratch.write(found, "found")
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("node", "cls")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    labels = classes.select("cls", "low", "n").join(roots, "cls", "left").join(counts, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lows = labels.groupBy("root").agg(F.min("low").alias("component"))
    labels = labels.join(lows, "root").select("cls", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    member = classes.select("cls").join(keyed.select(F.col("_row").alias("cls"), "embedding"), "cls")
    labels = scratch.write(labels.join(member, "cls"), "labels")
    out = keyed.select("vec_id", "embedding", "usable").join(labels.select("embedding", "component", "n_links").withColumn("usable", F.lit(True)), ["embedding", "usable"], "left")
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op4_embedding_near_dedup": op4_embedding_near_dedup}
ORACLE_SQL: dict[str, str] = {}

"""Hard-negative mining by ball-tree branch-and-bound (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stagelight.llm.common import Scratch, with_row_id

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
#: The query's integer form of a component: floor(SCALE * c).
SCALE = 256
#: Bytes of the vectors of one tree, at 4 a component; a task holds one tree and a batch of queries.
TREE_BYTES = 64 << 20
#: Trees get at least this many rows before there are more of them than the memory asks for.
TREE_ROWS = 512
LEAF = 64
#: Queries that walk a tree together.
QUERIES_AT_ONCE = 512
#: Scores stay below this, so that their hundredfold is still a long.
MOST_SCORE = float(1 << 55)

NONE = np.iinfo(np.int64).min + 1


class BallTree:
    """Rows of one partition in nested balls, each with its smallest and largest label and its first row by (id, row)."""

    def __init__(self, row: np.ndarray, key: np.ndarray, label: np.ndarray, x: np.ndarray):
        n = len(row)
        rank = np.empty(n, dtype=np.int64)
        rank[np.lexsort((row, key))] = np.arange(n)
        perm = np.arange(n)
        self.start, self.end, self.left, self.right, self.center, self.radius = [0], [n], [-1], [-1], [], []
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = self.start[node], self.end[node]
            own = perm[a:b]
            if b - a > LEAF:
                by = label[own]
                if by.min() != by.max():  # labels apart first: cut where one ends, as near to the middle as can be
                    order = np.lexsort((rank[own], by))
                    ends = np.flatnonzero(np.diff(by[order])) + 1
                    cut = int(ends[np.abs(ends - (b - a) // 2).argmin()])
                else:
                    y = x[own].astype(np.float64)
                    one = y[((y - y.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                    two = y[((y - one) ** 2).sum(axis=1).argmax()]
                    order, cut = np.lexsort((rank[own], y @ (two - one))), (b - a) // 2
                perm[a:b] = own[order]
                for side, (s, e) in ((self.left, (a, a + cut)), (self.right, (a + cut, b))):
                    side[node] = len(self.start)
                    todo.append(len(self.start))
                    self.start.append(s)
                    self.end.append(e)
                    self.left.append(-1)
                    self.right.append(-1)
        self.row, self.key, self.label, self.rank, self.x = row[perm], key[perm], label[perm], rank[perm], x[perm]
        for a, b in zip(self.start, self.end):
            y = self.x[a:b].astype(np.float64)
            c = y.mean(axis=0)
            self.center.append(c)
            self.radius.append(float(np.sqrt(((y - c) ** 2).sum(axis=1).max())))
        self.low_label = [int(self.label[a:b].min()) for a, b in zip(self.start, self.end)]
        self.high_label = [int(self.label[a:b].max()) for a, b in zip(self.start, self.end)]
        self.first = [int(self.rank[a:b].min()) for a, b in zip(self.start, self.end)]
        self.largest = int(np.abs(self.x).max(initial=0))

    def search(self, row: np.ndarray, label: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the k best (score, rank) of rows with its label (or, unless `same`, another label) whose inner
        product lies in [low, high]; its own row is never one of them.

        Queries go down the tree together. A query leaves a node whose bounds lie outside its window, or whose upper
        bound lies beneath its kth score so far (or just at it, while the node's rows all come later).
        """
        n = len(row)
        score, rank = np.full((n, k), NONE), np.full((n, k), len(self.row))
        places, of = np.unique(row, return_index=True)[1], np.unique(row, return_inverse=True)[1]
        wide = x[places].astype(np.float64)
        length = np.sqrt((wide * wide).sum(axis=1))
        exact = float(self.largest) * max(float(np.abs(wide).max(initial=0)), 1.0) * x.shape[1] < 2**53

        def bounds(node: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            some, back = np.unique(of[active], return_inverse=True)
            middle, reach = wide[some] @ self.center[node], length[some] * self.radius[node]
            reach += 1e-9 * (np.abs(middle) + reach) + 1e-6
            return (middle - reach)[back], (middle + reach)[back]

        def open_(node: int, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if same:
                active = active[(label[active] >= self.low_label[node]) & (label[active] <= self.high_label[node])]
            elif self.low_label[node] == self.high_label[node]:
                active = active[label[active] != self.low_label[node]]
            below, above = bounds(node, active)
            kth = score[active, -1]
            keep = (above >= low[active]) & (below <= high[active]) & ((np.floor(above) > kth) | (np.floor(above) == kth) & (self.first[node] < rank[active, -1]))
            return active[keep], above[keep]

        stack = [(0, np.arange(n))]
        while stack:
            node, active = stack.pop()
            active, above = open_(node, active)
            if not len(active):
                continue
            if self.left[node] >= 0:
                left, right = self.left[node], self.right[node]
                nearer = wide[of[active]].mean(axis=0) @ (self.center[left] - self.center[right]) > 0
                stack += [(right, active), (left, active)] if nearer else [(left, active), (right, active)]
                continue
            a, b = self.start[node], self.end[node]
            some, back = np.unique(of[active], return_inverse=True)
            if exact:
                found = (wide[some] @ self.x[a:b].astype(np.float64).T).astype(np.int64)[back]
            else:
                found = (x[places[some]].astype(np.int64) @ self.x[a:b].astype(np.int64).T)[back]
            fits = (self.label[a:b] == label[active, None]) == same
            fits &= (found >= np.maximum(low[active], score[active, -1])[:, None]) & (found <= high[active, None]) & (self.row[a:b] != row[active, None])
            hot = np.flatnonzero(fits.any(axis=1))
            if len(hot):
                mine = active[hot]
                scores = np.concatenate([score[mine], np.where(fits[hot], found[hot], NONE)], axis=1)
                ranks = np.concatenate([rank[mine], np.where(fits[hot], self.rank[a:b], len(self.row))], axis=1)
                best = np.lexsort((ranks, -scores), axis=1)[:, :k]
                score[mine], rank[mine] = np.take_along_axis(scores, best, axis=1), np.take_along_axis(ranks, best, axis=1)
        return score, rank


def _ids(column: pa.Array) -> np.ndarray:
    """Ids to sort by; null comes last."""
    return column.fill_null(np.iinfo(np.int64).max).to_numpy()


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


FOUND = "row long, tag long, found_row long, found_id long, score long"


def _walk(k: int, same: bool):
    """Over partitions sorted by (tree, kind): first a tree's rows, then the queries that come to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            trees, kinds = batch.column("tree").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(trees) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(trees)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if trees[a] != at:
                    at, held, tree = trees[a], [], None
                if kinds[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    tree = BallTree(rows["row"].to_numpy(), _ids(rows["id"].combine_chunks()), rows["label"].to_numpy(), _vectors(rows["x"].combine_chunks()))
                    back = dict(ids=rows["id"].combine_chunks(), of=np.argsort(np.lexsort((rows["row"].to_numpy(), _ids(rows["id"].combine_chunks())))))
                    back["at"] = np.argsort(back["of"])  # place in rows of each rank
                    numbers, held = rows["row"].to_numpy(), []
                if tree is None:
                    continue
                for c in range(a, b, QUERIES_AT_ONCE):
                    part = batch.slice(c, min(QUERIES_AT_ONCE, b - c))
                    score, rank = tree.search(*(part.column(name).to_numpy() for name in ("row", "label")), _vectors(part.column("x")), part.column("low").to_numpy(), part.column("high").to_numpy(), k, same)
                    i, j = np.nonzero(score != NONE)
                    if len(i):
                        places = back["at"][rank[i, j]]
                        yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(i)), part.column("tag").take(pa.array(i)), pa.array(numbers[places]), back["ids"].take(pa.array(places)), pa.array(score[i, j])], ["row", "tag", "found_row", "found_id", "score"])

    return run


def search(rows: DataFrame, queries: DataFrame, trees: int, k: int, same: bool) -> DataFrame:
    """row and tag of each query with its k best (found_row, found_id, score), by falling score and rising id, numbered in `rank`.

    rows: row, id, label, x (array of ints); queries: row, tag, label, x, low, high. Rows are dealt to `trees` trees by
    a hash, so hot labels and copies spread; each query visits all trees, and vectors of other lengths have trees of
    their own. A tree's rows fit a task, queries stream past it, and only the k best of a tree are shuffled on.
    """
    length = F.size("x").cast("long") * trees
    no = F.lit(None).cast("long")
    data = rows.select((length + F.pmod(F.xxhash64("row"), F.lit(trees))).alias("tree"), F.lit(0).alias("kind"), "row", no.alias("tag"), "id", "label", "x", no.alias("low"), no.alias("high"))
    asked = queries.select(F.explode(F.sequence(length, length + F.lit(trees - 1))).alias("tree"), F.lit(1).alias("kind"), "row", "tag", no.alias("id"), "label", "x", "low", "high")
    met = data.unionByName(asked).repartition("tree").sortWithinPartitions("tree", "kind", "row", "tag")
    found = met.mapInArrow(_walk(k, same), FOUND)
    order = Window.partitionBy("row", "tag").orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hundredths(score: str, share: int, up: bool) -> Column:
    """share / 100 of a score, rounded down or up to an integer, for scores of either sign."""
    whole = f"({score} * {-share if up else share})"
    down = F.expr(f"({whole} - pmod({whole}, 100)) div 100")
    return -down if up else down


def mine_hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """For each anchor and each of its best `positives` rows of the same label, the best `negatives` rows of another
    label whose score lies between `low` and `high` hundredths of the positive's.

    vectors: vec_id, label and x, an array of integers; scores are exact inner products, ties go to the smaller vec_id
    (null last), then to the earlier row. Rows with a null label, a null or empty vector, or a null component take no
    part, nor do rows so long that a score could leave the range (MOST_SCORE). Vectors of different lengths never
    meet. Rows are told apart by place, not by vec_id: repeated ids are rows and anchors of their own, a copy of an
    anchor can be its positive, and a null `anchor` is none. Anchors without a positive, and positives without a
    negative in the window, have no row; an empty table gives none. Other columns are not read. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. `vectors` has to be a scan or a written table.
    """
    scratch = Scratch(vectors.sparkSession, "negatives")
    known = F.coalesce(F.forall("x", lambda c: c.isNotNull() & (F.pow(c.cast("double"), 2) * F.size("x") < MOST_SCORE)) & (F.size("x") > 0), F.lit(False))
    rows = with_row_id(vectors.select("vec_id", "label", "x", anchor.alias("anchor")), "row").where(F.col("label").isNotNull() & known)
    rows = scratch.write(rows.select("row", F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("x").cast("array<int>").alias("x"), F.coalesce("anchor", F.lit(False)).alias("anchor")), "rows")
    n, size = rows.agg(F.count("*"), F.sum(F.size("x"))).first()
    spread = 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trees = max(1, -(-4 * (size or 0) // TREE_BYTES), min(-(-n // TREE_ROWS), spread))
    anchors = rows.where("anchor").select("row", "id", "label", "x")
    everything = (F.lit(NONE + 1).alias("low"), F.lit(-NONE).alias("high"))
    first = scratch.write(search(rows, anchors.select("row", F.lit(0).cast("long").alias("tag"), "label", "x", *everything), trees, positives, True), "positives")
    pairs = first.select("row", F.col("found_row").alias("tag"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = pairs.join(anchors.withColumnRenamed("id", "anchor_id"), "row").withColumn("low", hundredths("positive_score", low, True)).withColumn("high", hundredths("positive_score", high, False))
    windows = scratch.write(windows.where("low <= high"), "windows")
    second = search(rows, windows, trees, negatives, False)
    out = second.join(windows.select("row", "tag", "anchor_id", "positive_id", "positive_score"), ["row", "tag"])
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = F.forall("embedding", lambda c: ~F.isnan(c) & (F.abs(c) < float(1 << 22)))  # null components pass and are met later
    x = F.when(finite | finite.isNull(), F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")).cast("int")))
    return mine_hard_negatives(table.select("vec_id", label.alias("label"), x.alias("x")), F.col("vec_id") % 50 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE_SQL = {
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND a.vec_id % 50 = 0
),
positive AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id, b) <= 5
),
ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.other_id, n.b)::INTEGER AS "rank",
    n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positive p JOIN scored n ON p.a = n.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT * FROM ranked WHERE "rank" <= 3
"""
}

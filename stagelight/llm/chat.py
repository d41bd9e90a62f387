"""Chat formatting into prefix trees (operator 2).

Conversations that begin with the same turns share a path of a tree whose nodes are turns. All trees stand in one
stream of code points, depth first, each node once. A node has its place in the stream, the position ids of its code
points (they go on from its parent's, not from the stream's), and the intervals of the stream that hold its
ancestors: with them a model attends to a code point's own conversation and to no other.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from stagelight.llm.common import Scratch

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates; none of them is left whole inside an escaped text.
CONTROL = re.compile(r"<(?=\||s>|/s>|<SYS>>|</SYS>>|unk>|pad>)|\[(?=INST\]|/INST\])")
LEARNED_ROLE = "assistant"
BATCH = 2000

TURNS = "conv_id long, depth int, node binary, parent binary, position long, length long, role string, segment string, loss_start long, loss_length long, last boolean"
NODES = "node binary, parent binary, depth int, stream_start long, length long, position_start long, role string, segment string, loss_start long, loss_length long"
DIGEST = "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attends array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    """Reversible: a backslash is doubled, and one is put after the first character of a control string."""
    return CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment of a turn, and start and length of its loss mask."""
    head = f"{START}{escape(role)}".replace("\n", "\\\n") + "\n"
    body = escape(text)
    learned = role == LEARNED_ROLE
    return f"{head}{body}{END}\n", len(head) if learned else 0, len(body) if learned else 0


SEGMENT = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(END) + r"\n", re.S)


def parse(segment: str) -> tuple[str, str]:
    role, text = SEGMENT.fullmatch(segment).groups()
    return unescape(role), unescape(text)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of conversations, sorted: each with its node, which is a digest of all turns up to it. Only the last
    node of the conversation at hand is held."""
    names = [x.strip().split()[0] for x in TURNS.split(", ")]
    out: list[list] = [[] for _ in names]
    conv, started, parent, depth, place = None, False, None, 0, 0
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("position", pa.int64()), ("length", pa.int64()), ("role", pa.string()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64()), ("last", pa.bool_())])

    def flush(keep: int) -> pa.RecordBatch:
        ready = [c[: len(c) - keep] for c in out]
        for c in out:
            del c[: len(c) - keep]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(ready, schema)], schema=schema)

    for batch in batches:
        ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
        for c, role, text in zip(ids, roles, texts):
            if not started or c != conv:
                if started:
                    out[-1][-1] = True
                conv, started, parent, depth, place = c, True, None, 0, 0
            role, text = role or "", text or ""
            segment, loss_start, loss_length = render(role, text)
            node = hashlib.blake2b(f"{len(role)}|{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16, key=parent or b"").digest()
            for column, value in zip(out, (c, depth, node, parent, place, len(segment), role, segment, loss_start, loss_length, False)):
                column.append(value)
            parent, depth, place = node, depth + 1, place + len(segment)
            if len(out[0]) > BATCH:
                yield flush(1)
    if started:
        out[-1][-1] = True
    yield flush(0)


def _running(value: str, names: list[str]):
    """Adds to rows of sorted partitions the partition's number and the sum of `value` over the rows before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            v = batch.column(value).to_pylist()
            before = []
            for x in v:
                before.append(total)
                total += x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([part] * len(v), pa.int32()), pa.array(before, pa.int64())], [*names, "part", "before"])

    return run


def running_sum(df: DataFrame, order: list[str], value: str, out: str, scratch: Scratch, name: str) -> DataFrame:
    """df with `out`: the sum of `value` over all rows before each row in the global order of the (unique) `order`.

    A range shuffle and a sum for each partition; the partitions' sums, one row each, are all that is gathered.
    """
    fields = StructType([*df.schema, StructField("part", IntegerType()), StructField("before", LongType())])
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_running(value, df.columns), fields)
    ranged = scratch.write(ranged, name)
    sums, offset, at = ranged.groupBy("part").agg(F.sum(value).alias("s")).orderBy("part").collect(), {}, 0
    for r in sums:
        offset[r.part] = at
        at += r.s
    if not offset:
        return ranged.withColumn(out, F.col("before")).drop("part", "before")
    starts = F.array(*(F.lit(offset.get(i, 0)).cast("long") for i in range(max(offset) + 1)))
    return ranged.withColumn(out, F.col("before") + F.get(starts, F.col("part"))).drop("part", "before")


def _leaf_turns(members: DataFrame) -> DataFrame:
    """(leaf, leaf_depth, depth, node, parent): the turns of one conversation for each leaf."""
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id")))
    leaves = members.where("last").groupBy(F.col("node").alias("leaf"), F.col("depth").alias("leaf_depth")).agg(first.alias("c"))
    leaves = leaves.select("leaf", "leaf_depth", F.col("c.id").alias("c"))
    return members.join(leaves, F.col("conv_id").eqNullSafe(F.col("c"))).select("leaf", "leaf_depth", "depth", "node", "parent")


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of rows conv_id, turn, role, text.

    nodes: one row for each distinct prefix of turns, with columns NODES: its place in the stream, position ids
    position_start .. position_start + length - 1, its segment (the formatted turn), and the span of the segment that
    the loss takes (an assistant's escaped text). members: conv_id, depth, node, parent, last: a row for each turn.

    Depth-first order compares conversations by the nodes at which paths part alone: the children of forks. A
    conversation has as many of these as there are others that leave it, however long it is.

    Turns are ordered by turn, then role and text; null turns come first. Null roles and texts are empty; rows with a
    null conv_id are one conversation. Conversations with equal turns share all nodes. A conversation streams through
    one task, as its digests ask for, of which only the last is held. Other columns are not read.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = scratch.write(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_chain, TURNS), "turns")
    members = turns.select("conv_id", "depth", "node", "parent", "last")
    own = scratch.write(_leaf_turns(members), "own")
    forks = own.where("parent is not null").select("parent", "node").distinct().groupBy("parent").count().where("count > 1").select("parent")
    marks = own.where("parent is null").unionByName(own.join(forks, "parent", "left_semi").select(*own.columns))
    path = F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"])
    paths = marks.groupBy("leaf", "leaf_depth").agg(path.alias("path")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sum(paths, ["path", "leaf_depth"], "one", "rank", scratch, "paths")
    # a node belongs to its first path in this order: (rank, depth) is depth-first order
    owners = own.select("leaf", "node").join(ranked.select("leaf", "rank"), "leaf").groupBy("node").agg(F.min("rank").alias("rank"))
    nodes = turns.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "depth", "length", "position", "role", "segment", "loss_start", "loss_length")))
    placed = running_sum(nodes.join(owners, "node"), ["rank", "depth"], "length", "stream_start", scratch, "nodes")
    return placed.select("node", "parent", "depth", "stream_start", "length", F.col("position").alias("position_start"), "role", "segment", "loss_start", "loss_length"), members


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests and ancestor intervals of each leaf from its nodes, sorted by leaf and depth."""
    schema = pa.schema([("leaf", pa.binary()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    out, leaf, state = [], None, None

    def close() -> None:
        turns, loss, n, loss_chars, chars, spans = state
        out.append((leaf, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, [{"start": a, "end": b} for a, b in spans]))

    def flush() -> pa.RecordBatch:
        rows, columns = list(out), range(len(schema))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema[i].type) for i in columns], schema=schema)

    for batch in batches:
        for r in batch.to_pylist():
            if state is None or r["leaf"] != leaf:
                if state is not None:
                    close()
                leaf, state = r["leaf"], [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, []]
            role, text = parse(r["segment"])
            state[0].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(r["segment"][r["loss_start"] : r["loss_start"] + r["loss_length"]])
            state[1].update(masked.encode("utf-8", "surrogatepass"))
            state[2] += 1
            state[3] += len(masked)
            state[4] += len(r["segment"])
            start, end = r["stream_start"], r["stream_start"] + r["length"]
            if state[5] and state[5][-1][1] == start:
                state[5][-1][1] = end
            else:
                state[5].append([start, end])
        if len(out) > BATCH:
            yield flush()
    if state is not None:
        close()
    yield flush()


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """What each conversation's part of the stream holds: DIGEST for each conv_id. attends: the stream's intervals
    that its last turn attends to, its own last, merged where they touch."""
    steps = _leaf_turns(members).select("leaf", F.col("depth").alias("at"), "node").join(nodes.select("node", "stream_start", "length", "segment", "loss_start", "loss_length"), "node")
    digests = steps.repartition("leaf").sortWithinPartitions("leaf", "at").mapInArrow(_read, DIGEST)
    return members.where("last").select("conv_id", F.col("node").alias("leaf")).join(digests, "leaf").drop("leaf")


#: The conversation that the query adds: control strings as texts.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return read_back(*prefix_tree(rows.unionByName(extra))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES = {"op2_chat_formatting": op2_chat_formatting}
ORACLE_SQL = {}

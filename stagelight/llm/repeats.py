"""Repeated windows of a fixed number of units (words or bytes), counted exactly over a whole corpus.

Each window of k units is owned by its trigger: the leftmost of the smallest rolling hashes of w units in it.
Equal windows have equal triggers at equal offsets, so consecutive windows with one trigger (a run) travel together:

1. `_thin` cuts each text into runs and writes a thin row for each: trigger, hash of the run's string, place. The hash
   has 64 bits (`two` mixes it with trigger and place, for joins by one long), and tells strings of one trigger apart.
   Runs that a text holds twice are repeated already; one of them stands for all of them from here on.
2. Thin rows meet by trigger. Runs whose trigger occurs once hold no repeated window. Equal strings are repeated
   whole, without a look inside. Where a trigger has different strings, one run of each string has to be looked at.
3. Those runs' units are cut from their texts and travel, as one packed string, to the bucket of their trigger.
4. In a bucket, the suffixes of the parts up to the trigger and the parts behind it are sorted apart, by their
   units; the two ranks sort the bucket's windows, and neighbours with k equal units are repeated.

No key meets in one task whatever its share of the rows: triggers and windows that may hold more than a thousandth
of the rows are found by a mergeable sketch, so there are a thousand at most. Their runs are counted with map-side
combining, joined by broadcast, and their windows are rows of their own that are counted by a 128-bit hash, as are
the windows of triggers with more strings than a bucket takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelight.llm import blocks as B
from stagelight.llm.common import Scratch, heavy_keys, split_semi_join, with_row_id
from stagelight.llm.groups import whole_groups

#: Low bits of a key that hold the position, so that the leftmost of equal hashes is the smallest key.
POSITION_BITS = 22
#: Windows of a text that are looked at in one piece.
PIECE = 1 << 19
#: Windows of the buckets that are sorted at once.
IN_MEMORY = 1 << 18
#: Strings of a trigger that make one bucket; the windows of triggers with more are counted as rows.
BUCKET = 1 << 12

RUN = ["trigger", "one", "two", "_row", "start", "n", "x", "times"]
#: A run of n windows from unit `start` on, whose trigger lies x units behind its first one; `times` in its text.
#: With a null trigger: windows known to be repeated.
THIN = "trigger long, one long, two long, _row long, start long, n int, x int, times int"
#: kind 0: repeated; 1: to be looked at in its bucket; 2: its windows are to be counted as rows.
MET = f"{THIN}, kind int"
PACKED = "trigger long, _row long, start long, n int, x int, times int, packed binary"
WINDOWS = "one long, two long, _row long, start long, times int"
RANGES = "_row long, start long, n int"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names, kinds = zip(*(x.strip().split() for x in schema.split(",")))
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c, _ARROW[k]) for c, k in zip(columns, kinds)], list(names))


@dataclass(frozen=True)
class Units:
    """k units make a window, w a trigger; words are taken unchanged."""

    words: bool
    k: int
    w: int


def _values(buf: np.ndarray, bounds: np.ndarray, units: Units) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Two 64-bit values for each unit, and the first unit of each row (with the total at the end)."""
    if not units.words:
        return (B.BYTE_VALUES[0][buf], B.BYTE_VALUES[1][buf]), bounds
    start, end, first = B.word_spans(buf, bounds)
    return B.span_hashes(buf, start, end), first


def _runs_of(values: np.ndarray, first: np.ndarray, units: Units) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start unit in the row, number of windows, trigger, its offset, string hash) of the runs, a piece at a time."""
    k, w = units.k, units.w
    windows = np.maximum(np.diff(first) - k + 1, 0)
    mask = B.U64((1 << POSITION_BITS) - 1)
    # pieces: whole rows together while small, long rows cut by window starts; a piece overlaps the next by k - 1 units
    row, n_rows = 0, len(windows)
    total = np.concatenate([[0], np.cumsum(windows)])
    while row < n_rows:
        if windows[row] > PIECE:
            cuts, upto = [(row, row + 1, a, min(a + PIECE, int(windows[row]))) for a in range(0, int(windows[row]), PIECE)], row + 1
        else:
            upto = max(row + 1, int(np.searchsorted(total, total[row] + PIECE, side="right")) - 1)
            # rows in between shorter than k have no windows but take part of the array
            upto = max(row + 1, min(upto, int(np.searchsorted(first, first[row] + (1 << POSITION_BITS), side="left")) - 1, n_rows))
            cuts = [(row, upto, 0, None)]
        for a, b, lo, hi in cuts:
            base = int(first[a]) + lo
            stop = int(first[b]) if hi is None else int(first[a]) + hi + k - 1
            if stop - base < k:
                continue
            h, whole = B.rollings(values[base:stop], [w, k])
            keys = (h & ~mask) | np.arange(len(h), dtype=B.U64)
            low = B.sliding_min(keys, k - w + 1)
            counts = windows[a:b] if hi is None else np.array([hi - lo])
            starts = first[a:b] - base if hi is None else np.array([0])
            at = B.runs(starts, counts)
            if not len(at):
                continue
            trig = (low[at] & mask).astype(np.int64)
            begin = np.concatenate([[0], np.flatnonzero(trig[1:] != trig[:-1]) + 1])
            rows = np.repeat(np.arange(a, b), counts)[begin]
            n = np.diff(np.append(begin, len(trig)))
            # first and last window cover the run's string
            string = B.join(whole[at[begin]], whole[at[begin + n - 1]]) + n.astype(B.U64)
            yield rows, at[begin] + base - first[rows], n, h[trig[begin]], trig[begin] - at[begin], string
        row = upto


def _thin(units: Units):
    def rows_of(ids, parts) -> Iterator[pa.RecordBatch]:
        rows, start, n, trigger, x, one = parts
        two = B.mix(one + trigger * B.U64(B.FACTORS[1][0]) + x.astype(B.U64))
        # runs that a text holds twice: one stays, all are known to be repeated
        order = np.lexsort((start, one, trigger, rows))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (rows[order][1:] != rows[order][:-1]) | (trigger[order][1:] != trigger[order][:-1]) | (one[order][1:] != one[order][:-1])
        heads = np.flatnonzero(new)
        times = np.diff(np.append(heads, len(order)))
        keep = order[heads]
        yield _batch(THIN, trigger[keep], one[keep], two[keep], ids[rows[keep]], start[keep], n[keep].astype(np.int32), x[keep].astype(np.int32), times.astype(np.int32))
        again = np.sort(order[np.repeat(times, times) > 1])
        if len(again):
            row, lo, hi = rows[again], start[again], start[again] + n[again]
            cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (lo[1:] != hi[:-1])))
            size = hi[np.append(cut[1:], len(again)) - 1] - lo[cut]
            none = [None] * len(cut)
            yield _batch(THIN, none, none, none, ids[row[cut]], lo[cut], size.astype(np.int32), none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_row").to_numpy(zero_copy_only=False)
            data, off = B.utf8(batch.column("text"))
            for a, b in B.blocks(off):
                values, first = _values(data[off[a] : off[b]], off[a : b + 1] - off[a], units)
                for parts in _runs_of(values[0], first, units):
                    yield from rows_of(ids[a:b], parts)

    return run


def _rows(table: pa.Table | pa.RecordBatch, kind: np.ndarray, times: np.ndarray | None = None) -> pa.RecordBatch:
    columns = [c.combine_chunks() if isinstance(c := table.column(name), pa.ChunkedArray) else c for name in RUN]
    if times is not None:
        columns[-1] = pa.array(times.astype(np.int32))
    return pa.RecordBatch.from_arrays([*columns, pa.array(kind.astype(np.int32))], [*RUN, "kind"])


def _judged(rows: pa.Table, most: int, over: int | None) -> Iterator[pa.RecordBatch]:
    """Kinds of the runs of whole strings; all strings of the trigger `over` have theirs counted as rows."""
    trigger, one, two, times = (rows.column(c).to_numpy() for c in ("trigger", "one", "two", "times"))
    if not len(trigger):
        return
    new_trigger = np.append(True, trigger[1:] != trigger[:-1])
    new = new_trigger | np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(trigger)))
    whole = np.repeat(size, size) > 1  # what one text holds twice is known
    if whole.any():
        yield _rows(rows.filter(pa.array(whole)), np.zeros(int(whole.sum())))
    group = np.cumsum(new_trigger[head]) - 1
    strings = np.bincount(group)[group]
    counted = (strings > most) | (trigger[head] == over if over is not None else False)
    look = (strings > 1) | counted
    if look.any():
        yield _rows(rows.take(pa.array(head[look])), np.where(counted, 2, 1)[look], np.minimum(np.add.reduceat(times, head), 2)[look])


def _meet(most: int, held_rows: int = 1 << 17):
    """Kinds of the runs of sorted partitions (trigger, one, two). Of a trigger with more than held_rows runs, which
    aren't held, the windows are counted as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, over = [], 0, None
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < held_rows // 4:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            trigger, one, two = (rows.column(c).to_numpy() for c in ("trigger", "one", "two"))
            last = int(np.searchsorted(-(trigger != trigger[-1]).astype(np.int8), 0))
            if last:
                yield from _judged(rows.slice(0, last), most, over)
            if len(trigger) - last > held_rows:
                over = int(trigger[-1])
                other = (trigger != trigger[-1]) | (one != one[-1]) | (two != two[-1])
                string = int(np.searchsorted(-other.astype(np.int8), 0))
                yield from _judged(rows.slice(last, string - last), most, over)
                # of a string's many runs two stay behind, which is enough to tell that it is found twice
                if len(trigger) - string > 2:
                    yield _rows(rows.slice(string + 2), np.zeros(len(trigger) - string - 2))
                last, rows = string, rows.slice(0, string + 2)
            held = rows.slice(last).combine_chunks().to_batches()
            size = sum(x.num_rows for x in held)
        if held:
            yield from _judged(pa.Table.from_batches(held).combine_chunks(), most, over)

    return run


def _cut(units: Units):
    """The packed strings of a text's runs, or their windows' hashes."""

    def strings(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], dict]]:
        data, off = B.utf8(batch.column("text"))
        raw = memoryview(data)
        rows = batch.column("_row").to_pylist()
        names = ("trigger", "start", "n", "x", "times", "kind")
        for i, row in enumerate(rows):
            runs = batch.column("runs")[i].values
            field = {c: runs.field(c).to_numpy(zero_copy_only=False) for c in names}
            text = bytes(raw[off[i] : off[i + 1]])
            words = text.split() if units.words else None
            for at in range(0, len(runs), 20_000):
                part = {c: v[at : at + 20_000] for c, v in field.items()}
                begin = part["start"].tolist()
                end = (part["start"] + part["n"] + units.k - 1).tolist()
                packed = [b" ".join(words[s:e]) for s, e in zip(begin, end)] if words is not None else [text[s:e] for s, e in zip(begin, end)]
                part["_row"] = np.full(len(packed), row)
                yield packed, part

    def joined(held: list[tuple[list[bytes], dict]]) -> pa.RecordBatch:
        part = {c: np.concatenate([p[c] for _, p in held]) for c in held[0][1]}
        return _batch(f"{PACKED}, kind int", *(part[c] for c in ("trigger", "_row", "start", "n", "x", "times")), [s for p, _ in held for s in p], part["kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for packed, part in strings(batch):
                held.append((packed, part))
                size += sum(map(len, packed))
                if size > 4 << 20:
                    yield joined(held)
                    held, size = [], 0
            if held:
                yield joined(held)

    return run


def _windows(units: Units):
    """A row for each window of packed runs: its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.utf8(batch.column("packed"))
            row, start, n, times = (batch.column(c).to_numpy() for c in ("_row", "start", "n", "times"))
            for a, b in B.blocks(off):
                values, first = _values(data[off[a] : off[b]], off[a : b + 1] - off[a], units)
                at = B.runs(first[:-1], n[a:b])
                hashes = [B.rolling(v, units.k, which)[at] for which, v in enumerate(values)]
                owner = np.repeat(np.arange(a, b), n[a:b])
                yield _batch(WINDOWS, *hashes, row[owner], start[owner] + B.runs(np.zeros(b - a, dtype=np.int64), n[a:b]), times[owner])

    return run


def unit_ids(data: np.ndarray, bounds: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """A number from 1 on for each unit, equal for equal units only, in the order of bytes if units are bytes; first units."""
    if not words:
        return data.astype(np.int64) + 1, bounds
    start, end, first = B.word_spans(data, bounds)
    size = end - start
    letters = np.ascontiguousarray(data[B.runs(start, size)])
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64) + 1, first


def suffix_ranks(ids: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
    """Rank of each position's suffix ids[i : ends[i]], of at most `longest` units, by prefix doubling; equal suffixes
    have equal ranks, and one that ends before another's next unit comes first."""
    rank, span = ids, 1
    place = np.arange(len(ids))
    while span < longest:
        base = int(rank.max(initial=0)) + 1
        if base >= 1 << 31:
            rank = np.unique(rank, return_inverse=True)[1] + 1
            base = int(rank.max(initial=0)) + 1
        other = np.zeros(len(rank), dtype=np.int64)
        more = place + span < ends
        other[more] = rank[np.flatnonzero(more) + span]
        rank = rank * base + other
        span *= 2
    return np.unique(rank, return_inverse=True)[1]


def bucket_order(ids: np.ndarray, first: np.ndarray, trigger: np.ndarray, n: np.ndarray, x: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of the windows of packed runs: (owner, j, repeats the one before) of each window j of each owner.

    The dictionary is the runs' phrases, their units up to the end of the trigger; the parse is what follows from the
    trigger on. A window is a phrase's suffix and a parse suffix, so both suffix orders give that of the windows: by
    trigger, then the phrase's suffix, which no other one begins with, then the rank of the parse suffix. A window
    repeats the one before it if phrase suffixes are equal and the parse suffixes share what the window still lacks.
    """
    k, w, m = units.k, units.w, len(n)
    # the dictionary's suffixes that windows start at
    size = x + w
    at = B.runs(first[:-1], size)
    ends = np.cumsum(size)
    alpha = suffix_ranks(ids[at], np.repeat(ends, size), k)
    pick = B.runs(ends - size, n)
    owner, j = np.repeat(np.arange(m), n), B.runs(np.zeros(m, dtype=np.int64), n)
    alpha = alpha[pick]
    # the parse's suffixes, from each trigger on, and what neighbours share
    length = first[1:] - first[:-1] - x
    wide = np.zeros((m, k), dtype=np.int64)
    inside = np.arange(k) < length[:, None]
    wide[inside] = ids[B.runs(first[:-1] + x, np.minimum(length, k))]
    kind = ">u2" if wide.max(initial=0) < 1 << 16 else ">u4"
    rows = np.ascontiguousarray(wide.astype(kind)).view(f"S{k * int(kind[2])}").reshape(-1)
    by_parse = np.lexsort((rows, trigger))
    w_sorted = wide[by_parse]
    differ = w_sorted[1:] != w_sorted[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), k)
    shared = np.minimum(shared, np.minimum(length[by_parse][1:], length[by_parse][:-1]))
    shared[trigger[by_parse][1:] != trigger[by_parse][:-1]] = -1
    parse = np.empty(m, dtype=np.int64)
    parse[by_parse] = np.arange(m)
    # classes of parse suffixes with equal heads, for each length that a window may lack: w to k
    heads = np.zeros((k - w + 1, m), dtype=np.int32)
    np.cumsum(shared[None, :] < np.arange(w, k + 1)[:, None], axis=1, out=heads[:, 1:])
    bucket = np.unique(trigger, return_inverse=True)[1][owner]
    order = np.lexsort((parse[owner], alpha, bucket))
    lack = k - (x[owner] - j)  # units of the window from its trigger on
    head = heads[lack - w, parse[owner]]
    owner, j, alpha, head, bucket = (v[order] for v in (owner, j, alpha, head, bucket))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (bucket[1:] == bucket[:-1]) & (alpha[1:] == alpha[:-1]) & (head[1:] == head[:-1])
    return owner, j, same


def _bucket(table: pa.Table, units: Units) -> Iterator[pa.RecordBatch]:
    """Repeated windows of whole buckets, for runs that are the only ones of their string."""
    trigger, row, start, n, x, times = (table.column(c).to_numpy() for c in ("trigger", "_row", "start", "n", "x", "times"))
    data, off = B.utf8(table.column("packed"))
    ids, first = unit_ids(data, off, units.words)
    owner, j, same = bucket_order(ids, first, trigger, n.astype(np.int64), x.astype(np.int64), units)
    twin = same.copy()
    twin[:-1] |= same[1:]
    twin &= times[owner] == 1
    owner, j = owner[twin], j[twin]
    order = np.lexsort((j, owner))
    owner, j = owner[order], j[order]
    if len(owner):
        cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (j[1:] != j[:-1] + 1)))
        yield _batch(RANGES, row[owner[cut]], start[owner[cut]] + j[cut], np.diff(np.append(cut, len(owner))).astype(np.int32))


def _buckets(units: Units, in_memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, "trigger", in_memory, lambda b: int(np.maximum(b.column("n").to_numpy(), 64).sum()), whole=True):
            yield from _bucket(table, units)

    return run


def repeated_ranges(docs: DataFrame, units: Units, scratch: Scratch, in_memory: int = IN_MEMORY, bucket: int = BUCKET) -> DataFrame:
    """One row for each text with repeated windows: _row, spans (start and end of the covered units, packed pairs).

    docs: _row and text. The result is a written table.
    """
    thin = scratch.write(docs.mapInArrow(_thin(units), THIN), "thin")
    known = thin.where("trigger is null").select("_row", "start", "n")
    runs = thin.where("trigger is not null")
    heavy = heavy_keys(runs, "trigger")
    is_heavy = F.col("trigger").isin(heavy) if heavy else F.lit(False)
    light = runs.where(~is_heavy).repartition("trigger").sortWithinPartitions("trigger", "one", "two")
    met = scratch.write(light.mapInArrow(_meet(bucket), MET), "met")
    known = known.unionByName(met.where("kind = 0").select("_row", "start", "n"))
    look = met.where("kind > 0")
    if heavy:
        hot = runs.where(is_heavy)
        strings = hot.groupBy("trigger", "one", "two").agg(F.min(F.struct("_row", "start", "n", "x")).alias("r"), F.sum("times").alias("all"), F.count("*").alias("texts"))
        strings = scratch.write(strings, "strings")
        both = split_semi_join(hot, strings.where("texts > 1").select("trigger", "one", "two"), ["one", "two", "trigger"])
        known = known.unionByName(both.select("_row", "start", "n"))
        look = look.unionByName(strings.select("trigger", "one", "two", "r.*", F.least("all", F.lit(2)).cast("int").alias("times"), F.lit(2).alias("kind")))
    wanted = look.groupBy("_row").agg(F.collect_list(F.struct("trigger", "start", "n", "x", "times", "kind")).alias("runs"))
    packed = scratch.write(docs.join(wanted.hint("shuffle_hash"), "_row").mapInArrow(_cut(units), f"{PACKED}, kind int"), "packed")
    buckets = packed.where("kind = 1").drop("kind").repartition("trigger").sortWithinPartitions("trigger")
    found = known.unionByName(buckets.mapInArrow(_buckets(units, in_memory), RANGES))
    rest = packed.where("kind = 2")
    if not rest.isEmpty():
        windows = scratch.write(rest.drop("kind").mapInArrow(_windows(units), WINDOWS), "windows")
        often = windows.groupBy("one", "two").agg(F.sum("times").alias("total")).where("total > 1").select("one", "two")
        twins = split_semi_join(windows.where("times = 1"), scratch.write(often, "often"), ["one", "two"])
        found = found.unionByName(twins.select("_row", "start", F.lit(1).alias("n")))
    listed = found.groupBy("_row").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    return scratch.write(listed.mapInArrow(_merge(units.k), "_row long, spans binary"), "ranges")


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for ranges in batch.column("ranges"):
                flat = ranges.values.flatten()
                start = flat[0].to_numpy(zero_copy_only=False).astype(np.int64)
                end = start + flat[1].to_numpy(zero_copy_only=False) + k - 1
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.append(True, start[1:] > end[:-1])
                last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
                spans.append(np.stack([start[new], end[last]], axis=1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(spans, pa.binary())], ["_row", "spans"])

    return run


def covered(n_units: int, spans: bytes) -> np.ndarray:
    """Which units lie in a repeated window."""
    gone = np.zeros(n_units, dtype=bool)
    for start, end in np.frombuffer(spans, dtype="<i8").reshape(-1, 2):
        gone[start:end] = True
    return gone


def remove_repeats(docs: DataFrame, units: Units, out, schema: str, columns: list[str], in_memory: int = IN_MEMORY, bucket: int = BUCKET) -> DataFrame:
    """docs' rows with the result of out(text bytes, spans or None) beside `columns`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    keyed = with_row_id(docs.select(*columns, "text"))
    ranges = repeated_ranges(keyed.select("_row", "text"), units, scratch, in_memory, bucket)
    scratch.keep_only("ranges")
    # shuffled at every size: spans grow with the repeats, and a broadcast of a few would tell nothing about many
    joined = keyed.join(ranges.hint("shuffle_hash"), "_row", "left").select(*columns, "text", "spans")
    names = [x.split()[0] for x in schema.split(", ")]
    fields = docs.select(*columns).schema
    for part in schema.split(", "):
        fields = fields.add(*part.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.utf8(batch.column("text"))
            raw, found = memoryview(data), batch.column("spans")
            rows = [out(bytes(raw[off[i] : off[i + 1]]), found[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array([r[j] for r in rows], _ARROW[p.split()[1]]) for j, p in enumerate(schema.split(", ")))], [*columns, *names])

    return joined.mapInArrow(run, fields)

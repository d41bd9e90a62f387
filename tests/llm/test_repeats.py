"""Operators 5 and 6 against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from stagelight.llm.bytespans import dedup_bytes
from stagelight.llm.substrings import dedup_substrings


def written(spark, tmp_path, rows, schema="doc_id long, text string, _row string, start long"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 10) : rng.randint(12, 30)]
        rows.append((i, rng.choice([" ", "  ", "\t", "\n"]).join(words), "x", 1))
    rows += [(3, rows[3][1], None, 2), (None, rows[4][1], None, 3), (100, None, "y", 4), (101, "", "y", 4), (102, "a " * 500, "y", 4), (103, "a" * 700, "y", 4), (104, " \n ", "z", 1), (105, "   b", "z", 1)]
    return rows


def removed(units, k):
    count = Counter(tuple(u[i : i + k]) for u in units for i in range(len(u) - k + 1))
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - k + 1):
            if count[tuple(u[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        yield gone


@pytest.mark.parametrize("in_memory, bucket", [(1 << 18, 1 << 12), (40, 2)])
@pytest.mark.parametrize("k", [6, 9])
def test_words(spark, tmp_path, k, in_memory, bucket):
    rows = corpus(k)
    units = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    want = Counter((r[0], len(u), sum(g), " ".join(w for w, x in zip(u, g) if not x)) for r, u, g in zip(rows, units, removed(units, k)))
    got = dedup_substrings(written(spark, tmp_path, rows), k, 3, in_memory, bucket).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got) == want
    assert sum(n * x[2] for x, n in want.items()) > 100


@pytest.mark.parametrize("in_memory, bucket", [(1 << 18, 1 << 12), (60, 2)])
@pytest.mark.parametrize("k", [12, 25])
def test_bytes(spark, tmp_path, k, in_memory, bucket):
    rows = corpus(k)
    units = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, u, g in zip(rows, units, removed(units, k)):
        spans = sum(x and not y for x, y in zip(g, [False, *g]))
        want[(r[0], len(u), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest())] += 1
    got = dedup_bytes(written(spark, tmp_path, rows), k, 5, in_memory, bucket).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == want


def test_long_text_in_pieces(spark, tmp_path, monkeypatch):
    from stagelight.llm import repeats

    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, base + base[5_000:9_000], "", 0), (2, base[20_000:21_000], "", 0)]
    units = [r[1].encode() for r in rows]
    monkeypatch.setattr(repeats, "PIECE", 1000)
    import numpy as np

    from stagelight.llm import blocks

    values = blocks.BYTE_VALUES[0][np.frombuffer(units[0], dtype=np.uint8)]
    unit = repeats.Units(False, 50, 10)
    cut = [x for part in repeats._runs_of(values, np.array([0, len(values)]), unit) for x in zip(*part)]
    monkeypatch.setattr(repeats, "PIECE", 1 << 19)
    whole = [x for part in repeats._runs_of(values, np.array([0, len(values)]), unit) for x in zip(*part)]
    at = lambda rows: {int(s) + i: int(t) for _, s, n, t, _, _ in rows for i in range(n)}
    assert at(cut) == at(whole) and len(at(whole)) == len(values) - 49
    got = {r.doc_id: r.n_removed for r in dedup_bytes(written(spark, tmp_path, rows), 50, 10).collect()}
    assert got == {r[0]: sum(g) for r, g in zip(rows, removed(units, 50))}


def production_corpus():
    """Texts with shared passages, some longer than a window and some not, periodic texts, and repeats within a text."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (34, 36, 60, 120)]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        for passage in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text[at:at] = passage[rng.randint(0, 3) :] if rng.random() < 0.3 else passage
        rows.append((i, " ".join(text), None, i))
    twice = " ".join(rng.choice(words) for _ in range(90))
    return rows + [(200, f"{twice} x {twice}", None, 0), (201, "ab " * 3000, None, 0), (202, "a" * 5000, None, 0), (203, "a" * 4000 + "b", None, 0), (204, "ab " * 40 + "x", None, 0)]


@pytest.mark.parametrize("hot", [False, True])
def test_production_parameters(spark, tmp_path, monkeypatch, hot):
    """Both ways to treat a trigger: in its bucket, and as one with too many rows or strings."""
    from functools import partial

    from stagelight.llm import common, repeats

    if hot:
        monkeypatch.setattr(common, "LEAST_HEAVY", 3)
        monkeypatch.setattr(repeats, "_meet", partial(repeats._meet, held_rows=4))
    rows = production_corpus()
    docs = written(spark, tmp_path, rows)
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1]) for r in rows]
    got = {r.doc_id: (r.n_removed, bytes(r.kept).decode()) for r in dedup_substrings(docs, bucket=3 if hot else 4096).collect()}
    assert got == {r[0]: (sum(g), " ".join(w for w, x in zip(u, g) if not x)) for r, u, g in zip(rows, words, removed(words, 35))}
    units = [r[1].encode() for r in rows]
    got = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in dedup_bytes(docs, bucket=3 if hot else 4096).collect()}
    assert got == {r[0]: (sum(g), bytes(b for b, x in zip(u, g) if not x)) for r, u, g in zip(rows, units, removed(units, 200))}


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_that_differ(spark, tmp_path):
    head = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{head} {word}", None, 0) for i, word in enumerate(thue_morse(4096), 1)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in dedup_substrings(written(spark, tmp_path, rows)).collect()}
    assert got == {1: (35, 0), 2: (35, 0)}


def test_suffix_order():
    """The order that a bucket's suffix arrays give is that of a brute-force suffix array, up to a window's length."""
    import numpy as np

    from stagelight.llm import blocks, repeats

    unit = repeats.Units(False, 30, 4)
    rng = random.Random(2)
    passage = "".join(rng.choice("ab") for _ in range(80))
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) + passage + "".join(rng.choice("ab") for _ in range(40)) for _ in range(30)]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    runs = [np.concatenate(c) for c in zip(*repeats._runs_of(blocks.BYTE_VALUES[0][data], bounds, unit))]
    row, start, n, trigger, x, _ = runs
    trigger = trigger.view(np.int64)
    packed = [texts[r][s : s + m + 29] for r, s, m in zip(row, start, n)]
    ids, first = repeats.unit_ids(np.frombuffer("".join(packed).encode(), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in packed])]), False)
    owner, j, same = repeats.bucket_order(ids, first, trigger, n, x, unit)
    windows = [packed[o][k : k + 30] for o, k in zip(owner, j)]
    assert len(windows) == sum(max(0, len(t) - 29) for t in texts)
    for bucket in np.unique(trigger):
        some = [w for w, o in zip(windows, owner) if trigger[o] == bucket]
        assert some == sorted(some)
    assert [bool(s) for s in same] == [i > 0 and trigger[owner[i]] == trigger[owner[i - 1]] and windows[i] == windows[i - 1] for i in range(len(windows))]
    assert len({w for w, s in zip(windows, same) if not s}) == len(set(windows)) == int((~same).sum())


def test_empty_table(spark, tmp_path):
    assert dedup_substrings(written(spark, tmp_path, [])).count() == 0
    (tmp_path / "b").mkdir()
    assert dedup_bytes(written(spark, tmp_path / "b", [])).count() == 0

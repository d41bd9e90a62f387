"""Operator 2: exact round trips, one copy of shared turns, attention intervals."""

import hashlib
import random
from collections import Counter

from stagelight.llm.chat import CONTROL, END, START, escape, parse, prefix_tree, read_back, render, unescape


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(1)
    parts = ["<", "|", "\\", "s>", "/s>", "[", "INST]", "/INST]", START, END, "<<SYS>>", "\n", "x", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        role = "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
        assert unescape(escape(text)) == text and not CONTROL.search(escape(text))
        segment, start, length = render(role, text)
        assert parse(segment) == (role, text) and (segment[start : start + length] == escape(text)) == (role == "assistant" or not text)


def conversations():
    rng = random.Random(4)
    opening = [("system", "Be kind."), ("user", "Hello <|im_end|>"), ("assistant", "Hi \\ there")]
    rows = []
    for c in range(120):
        turns = opening[: rng.randint(0, 3)] + [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", None, "", "日本\n", "[INST]"])) for _ in range(rng.randint(1, 5))]
        rows += [(c, t, r, x, b"x") for t, (r, x) in enumerate(turns)]
    rows += [(None, 0, "user", "q", b""), (None, 1, "assistant", "a", b""), (500, None, None, "x" * 100_000, b""), (500, 3, "assistant", "end", b""), (501, 0, "user", "tie", b""), (501, 0, "assistant", "tie", b""), (501, 0, "user", "tie", b"")]
    rng.shuffle(rows)
    return rows


def test_round_trip_and_tree(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node binary")
    nodes, members = prefix_tree(frame)
    got = {r.conv_id: r for r in read_back(nodes, members).collect()}
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    assert set(got) == set(convs)
    stream = "".join(r.segment for r in sorted(nodes.collect(), key=lambda r: r.stream_start))
    by_node = {bytes(r.node): r for r in nodes.collect()}
    prefixes = set()
    for c, turns in convs.items():
        turns = [(r[2] or "", r[3] or "") for r in sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        prefixes |= {tuple(turns[: i + 1]) for i in range(len(turns))}
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(render(r, t)[0] for r, t in turns)
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(whole) and "".join(stream[s.start : s.end] for s in r.attends) == whole
    assert len(by_node) == len(prefixes)  # each shared turn once
    for r in by_node.values():
        parent = by_node.get(bytes(r.parent)) if r.parent is not None else None
        assert r.position_start == (parent.position_start + parent.length if parent else 0)
        assert parent is None or r.stream_start >= parent.stream_start + parent.length
    # depth first: what lies between a node and the end of its subtree descends from it
    order = sorted(by_node.values(), key=lambda r: r.stream_start)
    stack = []
    for r in order:
        while stack and (r.parent is None or bytes(stack[-1].node) != bytes(r.parent)):
            stack.pop()
        assert r.parent is None or stack
        stack.append(r)
    roots = Counter(r.parent is None for r in order)
    assert roots[True] > 3


def test_empty_table(spark):
    nodes, members = prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 0 and read_back(nodes, members).count() == 0

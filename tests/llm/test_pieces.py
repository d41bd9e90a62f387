"""Operator 3: N-best against all segmentations, exact round trips, whole texts."""

import itertools
import random

import numpy as np
import pytest

from stagelight.llm.pieces import SPACE, Encoder, Vocabulary, decode_tokens, encode_texts, load_vocabulary, nbest_of_unit, swap


def small():
    rng = random.Random(2)
    pieces = {}
    for text in [SPACE, SPACE + SPACE, SPACE + "a", "a", "b", "ab", "ba", "aba", SPACE + "ab", "bb", "aab", "é"]:
        pieces[text] = (len(pieces) + 256, -float(rng.randint(1, 30)) - rng.random())
    return Vocabulary(pieces, list(range(256)), [bytes([i]) for i in range(256)] + [p.replace(SPACE, " ").encode() for p in pieces])


def all_ways(unit, v):
    """Scores of all segmentations."""
    if not unit:
        return [(0.0, ())]
    out = []
    for j in range(1, len(unit) + 1):
        got = v.pieces.get(unit[:j])
        if got:
            out += [(got[1] + s, (got[0], *ids)) for s, ids in all_ways(unit[j:], v)]
    if unit[0] not in v.pieces:
        out += [(v.unknown + s, (*swap(unit[0]).encode(), *ids)) for s, ids in all_ways(unit[1:], v)]
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_unit_nbest(n):
    v = small()
    for unit in ["".join(x) for k in range(1, 6) for x in itertools.product("ab" + SPACE + "x", repeat=k)][::7]:
        want = sorted((s for s, _ in all_ways(unit, v)), reverse=True)[:n]
        got = nbest_of_unit(unit, n, v)
        assert np.allclose([s for s, _ in got], want) and len({tuple(i) for _, i in got}) == len(want)


@pytest.mark.parametrize("n", [2, 4, 9])
def test_chain_nbest(n):
    v, rng = small(), random.Random(n)
    for _ in range(60):
        text = "".join(rng.choice("aabb xé" + SPACE) for _ in range(rng.randint(1, 9)))
        ids, score, ways = Encoder(v, n).encode(text)
        every = sorted(all_ways(SPACE + swap(text), v), reverse=True)
        want = [s for s, _ in every[:n]]
        assert abs(score - want[0]) < 1e-9 and np.allclose([w["score"] for w in ways], want)
        scores = {}
        for s, i in every:
            scores.setdefault(i, s)
        seen = set()
        for w in ways:  # the changes spell a segmentation of that score
            new, at = [], 0
            for c in w["changes"]:
                new += [*ids[at : c["token_start"]].tolist(), *c["ids"]]
                at = c["token_start"] + c["n_tokens"]
            new = tuple([*new, *ids[at:].tolist()])
            seen.add(new)
            assert abs(scores[new] - w["score"]) < 1e-9
        assert len(seen) == len(ways)


def test_round_trip_with_public_vocabulary(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "  a  b ", "\n\n", "a\nb\tc", SPACE, f" {SPACE}a ", "日本語 и 😀", "<s></s><unk><0x41>", "x" * 5000, "The quick brown fox. " * 300]
    texts += ["".join(rng.choice("abc ,.\n é日" + SPACE) for _ in range(rng.randint(1, 200))) for _ in range(100)]
    rows = [(i, t, "keep", 1.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(2)
    v = load_vocabulary()
    encoded = encode_texts(docs, v, 3)
    assert encoded.columns == ["doc_id", "lang", "token_ids", "score", "nbest"]
    got = {r.doc_id: r for r in decode_tokens(encoded, v).collect()}
    assert {i: r.text for i, r in got.items()} == dict(enumerate(texts))
    assert got[0].token_ids is None and got[1].token_ids == [] and len(got[11].token_ids) < 300 * 22
    assert all(0 <= x < 32_000 for r in got.values() for x in r.token_ids or [])
    scores = [[w.score for w in r.nbest] for r in got.values() if r.nbest]
    assert all(s == sorted(s, reverse=True) for s in scores) and any(len(s) == 3 for s in scores)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    v = small()
    assert decode_tokens(encode_texts(docs, v), v).count() == 0


def test_array_pass_equals_word_by_word():
    v, rng = load_vocabulary(), random.Random(3)
    words = ["".join(rng.choice("etaoinshrd▁é日x.,") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    from stagelight.llm.pieces import Lattice, best_of_unit

    lattice = Lattice(v)
    for size in range(1, 13):
        some = [w for w in words if len(w) == size]
        for w, got in zip(some, lattice.best(some)):
            want = best_of_unit(w, v)
            assert got[0] == want[0] and np.allclose(got[1:], want[1:]), w


def test_more_words_than_the_cache_holds(monkeypatch):
    """Results don't depend on what the cache has dropped, nor on how words are searched."""
    import random

    from stagelight.llm import pieces

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(40)]
    want = pieces.Encoder(pieces.load_vocabulary(), 4).encode_many(texts)
    monkeypatch.setattr(pieces, "CACHE", 150)
    for few in (0, 10**6):
        monkeypatch.setattr(pieces, "FEW", few)
        encoder = pieces.Encoder(pieces.load_vocabulary(), 4)
        got = [x for a in range(0, 40, 8) for x in encoder.encode_many(texts[a : a + 8])] + [encoder.encode(t) for t in texts]
        for g, w in zip(got, want + want):
            assert (g[0] == w[0]).all() and g[1] == w[1] and g[2] == w[2]

"""Operator 7: counts against brute force, thresholds on planted outliers."""

import random
import re
from collections import Counter

from stagelight.llm.quality import FENCE, LEAST_GROUP, RATES, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(windows), [False] * len(words)
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit[i : i + 8] = [True] * 8
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(hit), n < 20 or 100 * sum(hit) > 30 * n


def test_counts_and_verdicts(spark, tmp_path):
    rng = random.Random(2)
    word = lambda n=5: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(3, n)))
    rows = []
    for i in range(400):
        words = [word() + rng.choice(["", "", "", ".", "\n"]) for _ in range(rng.randint(0, 80))]
        if i % 7 == 0:
            words += words[: rng.randint(0, 30)]
        if i % 50 == 3:
            words = [w.strip() + "$$$" for w in words] + ["x"] * 3 + [word() for _ in range(30)]
        rows.append((i, rng.choice([" ", "\n"]).join(words), rng.choice(["en", None]), "s"))
    rows += [(900, None, "en", None), (901, "", None, None), (901, "\n\n a\n a\n", "zz", "s"), (902, "w " * 200, "en", "s"), (None, "日本 " * 3, "en", "s"), (903, "  x y\x1cz", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = quality_rules(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r[0], *brute(r[1])) for r in rows)
    assert all(not r.kept for r in got if r.base_failed)
    planted = [r for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 50 == 3 and not r.base_failed and r.n_symbols > r.n_words]
    assert planted and all(r.reason == "symbol_rate" for r in planted)
    plain = [r for r in got if not r.base_failed and r.n_symbols == 0 and r.n_dup_lines == 0 and r.n_repeat_words == 0]
    assert len(plain) > 100 and sum(not r.kept for r in plain) <= len(plain) // 50


def rates(r, lines):
    return {"symbol_rate": r.n_symbols / r.n_words, "word_length": r.word_chars / r.n_words, "repeat_rate": r.n_repeat_words / r.n_words, "dup_line_rate": r.n_dup_lines / max(lines, 1)}


def test_verdicts_against_exact_quantiles(spark, tmp_path):
    """Outliers of each rate, in a large group and in one that takes its language's sketch; verdicts by exact quantiles."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    rows = []
    for i in range(700):
        source = "big" if i % 8 else "small"
        lines = [" ".join(word() for _ in range(8)) for _ in range(10)]
        if i % 100 == 11:
            lines = lines[:6] + lines[:4]
        text = "\n".join(lines)
        if i % 100 == 23:
            words = [word() for _ in range(90)]
            text = " ".join(words + words[:12])  # 24 of 102 words
        if i % 100 == 37:
            text = text.replace(" ", " ## ", 30)
        if i % 100 == 49:
            text = " ".join(word() * 2 for _ in range(80))
        rows.append((i, text, "en", source))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in quality_rules(spark.read.parquet(str(tmp_path / "d"))).collect()}
    for planted, reason in ((23, "repeat_rate"), (37, "symbol_rate"), (49, "word_length")):
        assert {got[i].reason for i in range(planted, 700, 100)} == {reason}
    assert all(not got[i].kept for i in range(11, 700, 100))
    n_lines = {r[0]: len([x for x in r[1].split("\n") if x.strip()]) for r in rows}
    good = {i: rates(r, n_lines[i]) for i, r in got.items() if not r.base_failed}
    by = {s: [i for i in good if rows[i][3] == s] for s in ("big", "small")}
    assert len(by["small"]) < LEAST_GROUP < len(by["big"])
    checked = 0
    for i, rate in good.items():
        group = sorted(good) if rows[i][3] == "small" else by["big"]
        verdicts = set()
        for off in (-0.02, 0.0, 0.02):  # a sketch's quantiles lie within 2 % of the ranks
            ok = True
            for name, least in RATES.items():
                values = sorted(good[g][name] for g in group)
                q = [values[min(len(values) - 1, max(0, int((x + off) * len(values))))] for x in (0.1, 0.5, 0.9)]
                ok &= q[1] - FENCE * max(q[1] - q[0], least) <= rate[name] <= q[1] + FENCE * max(q[2] - q[1], least)
            verdicts.add(ok)
        if len(verdicts) == 1:
            checked += 1
            assert got[i].kept == verdicts.pop(), (i, got[i])
    assert checked > 0.95 * len(good)


def test_long_lines_and_words_that_differ(spark, tmp_path):
    """Strings on which polynomials modulo a power of two agree are neither equal lines nor equal windows."""
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    seven = "p q r s t u v"
    text = f"{a}\n{b}\n{seven} {a}\n{seven} {b}\n" + " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    r = quality_rules(spark.read.parquet(str(tmp_path / "d"))).first()
    assert (r.n_dup_lines, r.n_repeat_words) == (0, 0)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "d"))
    assert quality_rules(spark.read.parquet(str(tmp_path / "d"))).count() == 0

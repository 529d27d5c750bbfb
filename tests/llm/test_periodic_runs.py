"""Runs against a search over all lags and positions."""

import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from newstide.llm import periodic_runs

SF = "/root/testdata/sf0.001"


def brute(words):
    """Every maximal stretch at every lag; of those with the same ends the smallest lag."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            first = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - first + q
            if length >= max(24, 3 * q):
                found.setdefault((first, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def rest(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def same(texts):
    for text, (words, runs) in zip(texts, periodic_runs.text_runs([t.encode() for t in texts]), strict=True):
        tokens = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert [w.decode() for w in words] == tokens
        assert runs == brute(tokens), text[:200]
        assert periodic_runs.collapsed(words, runs).decode() == rest(tokens, runs)


def nested(dice, depth):
    """A word made of powers of words, down to single letters."""
    if depth == 0:
        return [dice.choice("abcd") for _ in range(dice.randint(1, 5))]
    return [x for _ in range(dice.randint(1, 3)) for x in nested(dice, depth - 1) * dice.randint(1, 5)]


def test_random_words_over_small_alphabets():
    dice = random.Random(1)
    same([" ".join(dice.choice("ab"[: 1 + k % 2] if k % 7 else "aaaaaaaaab") for _ in range(dice.randint(0, 90))) for k in range(400)])


def test_nested_repeats():
    dice = random.Random(2)
    same([" ".join(nested(dice, dice.randint(1, 3))[:700]) for _ in range(300)])


def test_every_period_at_the_least_length():
    dice = random.Random(3)
    texts = []
    for q in [*range(1, 40), 63, 64, 65, 127, 128, 129]:
        block = [f"w{dice.randrange(3 if q > 12 else 99)}" for _ in range(q)]
        for more in (-1, 0, 1):
            run = (block * 30)[: max(24, 3 * q) + more]
            texts.append(" ".join(["left", *run, "right"]))
    same(texts)


def test_blocks_whose_grams_all_repeat():
    """Two loops through one word: each gram of the period stands in it several times."""
    p, q = [f"p{k}" for k in range(20)], [f"q{k}" for k in range(23)]
    for block in (p + p + q + q, p + p + p + q + q + q, p + q + q + p + p + q, ["a"] * 18 + ["b", "c"], (["a"] * 40 + ["b"]) * 3 + ["c"]):
        same([" ".join(["x", "y", *block * 3, *block[: len(block) // 2], "z"])])


def test_one_text_does_not_run_into_the_next():
    same(["a b " * 11, "a b " * 11, "a b " * 12, "", "   ", "a b " * 13] * 3)


def test_long_texts_take_seconds():
    import time

    dice = random.Random(4)
    start = time.perf_counter()
    one = "a " * 300_000
    ((_, runs),) = periodic_runs.text_runs([one.encode()])
    assert runs == [(0, 300_000, 1)]
    block = [f"w{dice.randrange(50)}" for _ in range(99_991)]
    ((_, runs),) = periodic_runs.text_runs([" ".join(block * 3).encode()])
    assert (0, 299_973, 99_991) in runs
    p, q = "a " * 30 + "b ", "a " * 30 + "c "
    ((_, runs),) = periodic_runs.text_runs([((p * 50 + q * 50) * 40).encode()])
    assert (0, 40 * 3100, 3100) in [(s, n - n % 100, q) for s, n, q in runs]
    assert time.perf_counter() - start < 30


ODD = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "é ß " * 20, "x\x85y " * 30, "a\x0bb\x0c" * 30, "A a " * 12]


def test_operator_keeps_rows_and_columns(spark):
    texts = ODD + ODD
    df = spark.createDataFrame([(k, t, "mine", "new", k) for k, t in enumerate(texts)], "doc_id int, text string, runs string, row string, `n.words` int")
    got = periodic_runs.with_runs(df)
    assert got.columns == ["doc_id", "text", "row", "n.words", "n_words", "runs", "collapsed"]
    for r in got.collect():
        tokens = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = brute(tokens)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.row, r["n.words"]) == (len(tokens), runs, rest(tokens, runs), "new", r.doc_id)
    assert periodic_runs.with_runs(df.limit(0)).count() == 0


def test_strongest_run_and_list(spark):
    kind = "runs array<struct<start: bigint, length: bigint, period: bigint>>"
    big = 10**9
    rows = [[], [(5, 24, 8)], [(0, 30, 10), (40, 24, 8), (9, 27, 9)], [(3, 24, 3), (3, 48, 6)], [(0, 3 * big + 1, big), (1, 3 * big - 2, big - 1)]]
    df = spark.createDataFrame([(r,) for r in rows], kind).select(periodic_runs.strongest(F.col("runs")).alias("best"), periodic_runs.listed(F.col("runs")).alias("listed"))
    got = df.collect()
    assert [r.best and tuple(r.best) for r in got] == [None, (5, 24, 8), (0, 30, 10), (3, 24, 3), (1, 3 * big - 2, big - 1)]
    assert got[2].listed == "0,30,10\n40,24,8\n9,27,9\n" and got[0].listed == ""


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_query(spark):
    from newstide.llm import catalog

    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.op12_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        words = planted(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id] or ""))
        runs = brute(words) if len(words) < 1500 else next(iter(periodic_runs.text_runs([" ".join(words).encode()])))[1]
        assert r.n_runs == len(runs) and r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == digest(rest(words, runs))
        if runs:
            s, n, q = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4


def test_planting_odd_rows(spark):
    texts = [(k, t) for k in (0, 3, 17, 29, 54, -8, None) for t in (None, "", "  ", "a b c", "a b c d e f g h i j " * 5)] + [(k, "w1 w2 w3 w4 w5 w6 w7 w8 w9") for k in range(80)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("out", periodic_runs.repeated_tail(F.col("text"), F.col("doc_id")))
    for r in df.collect():
        words = (r.text or "").split()
        assert (r.out or "").split() == (planted(r.doc_id, words) if r.doc_id is not None else words)

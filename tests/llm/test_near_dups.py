"""Near-duplicate groups against brute force over all pairs."""

import os
import random
import re

import numpy as np
import pytest

from newstide.llm import near_dups, shingles

SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_sets(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """id -> (n_shingles, component) by comparing all pairs."""
    sets = [(i, brute_sets(t)) for i, t in rows if i is not None]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    index = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(k)
    seen = set()
    for members in index.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if 100 * len(x & y) >= 75 * len(x | y):
                        parent[root(a)] = root(b)
    lowest = {}
    for k, (i, _) in enumerate(sets):
        lowest[root(k)] = min(i, lowest.get(root(k), i))
    return sorted((i, len(s), lowest[root(k)]) for k, (i, s) in enumerate(sets))


def test_sets_are_those_of_the_words():
    dice = random.Random(2)
    texts = ["", None, " \n", "a", "A b\tc", "one two three four five", "É é ß Ä K", *(" ".join(dice.choice("aBcd") for _ in range(dice.randint(0, 40))) for _ in range(200))]
    by_number = {}
    for t, s in zip(texts, shingles.shingle_sets(texts, chunk=300), strict=True):
        assert len(s) == len(brute_sets(t))
        by_number.setdefault(s.tobytes(), set()).add(frozenset(brute_sets(t)))
    assert all(len(v) == 1 for v in by_number.values())
    assert len(by_number) == len({frozenset(brute_sets(t)) for t in texts})


@pytest.mark.parametrize("size", [1, 3, 40, 500, 6000])
def test_signatures_estimate_similarity(size):
    dice = np.random.default_rng(size)
    errors = []
    for _ in range(20):
        both, a, b = (dice.integers(0, 1 << 63, n).astype(np.uint64) for n in (3 * size, size, size))
        x, y = (near_dups.signature(np.concatenate([both, s])) for s in (a, b))
        assert np.isfinite(x).all() and (np.sort(x.astype(int)) == x.astype(int)[np.argsort(x)]).all()
        errors.append((x == y).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.06


def test_every_step_is_a_permutation():
    """One item alone gives every component exactly one step of its walk."""
    steps = np.sort(near_dups.signature(np.array([12345], np.uint64)).astype(int))
    assert steps.tolist() == list(range(near_dups.LENGTH))


def planted():
    dice = random.Random(7)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(5))
    rows = []
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    for k in range(150):  # near copies of one text, about as far from each other as the threshold
        w = list(base)
        for _ in range(dice.randint(0, 4)):
            w[dice.randrange(len(w))] = word()
        rows.append((len(rows), " ".join(w)))
    for _ in range(60):  # a shared passage does not make texts similar
        rows.append((len(rows), " ".join(passage + [word() for _ in range(dice.randint(10, 80))])))
    chain = [word() for _ in range(100)]
    for k in range(30):  # a chain: neighbours are similar, the ends are not
        rows.append((len(rows), " ".join(chain)))
        chain[3 * k % 100] = word()
    rows += [(len(rows) + k, t) for k, t in enumerate(["a b c", "a B c", "a b", "", None, " ", "one two three four five", "one two three four five six"])]
    return rows


def test_against_all_pairs(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = near_dups.near_duplicates(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_the_last_pass_finds_what_stars_leave(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "STARS", 0)
    monkeypatch.setattr(near_dups, "CELL", 7)
    monkeypatch.setattr(near_dups, "FAMILY_CELL", 5)
    rows = planted()[150:]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string, label string"
    assert near_dups.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    text = "one two three four five six"
    rows = [(None, text, "a"), (5, text, "b"), (5, text, "c"), (7, text.upper(), "d"), (7, "other", "e"), (8, None, "f"), (9, "", "g")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (7, 1, 7, True), (8, 0, 8, True), (9, 0, 9, True)], key=str)
    left = near_dups.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.label for r in left.collect()) == ["a", "b", "c", "d", "e", "f", "g"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_sample_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = near_dups.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])

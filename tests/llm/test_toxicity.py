"""The chain against enumeration of all paths, and toxicity scores on labelled documents that were held out."""

import itertools
import os
import zlib

import numpy as np
import pytest

from newstide.llm import crf, toxicity

SF = "/root/testdata/sf0.01"


def chain_of(dice, labels):
    return crf.Chain(np.zeros((1, labels)), dice.normal(size=(labels, labels)), dice.normal(size=labels))


@pytest.mark.parametrize("labels", [2, 3])
def test_marginals_and_best_path_by_enumeration(labels):
    dice = np.random.default_rng(labels)
    chain = chain_of(dice, labels)
    lengths = np.array([3, 0, 1, 5, 4, 2])
    scores = dice.normal(size=(lengths.sum(), labels)) * 2
    got, moved, begun = crf.marginals(chain, scores, lengths, pairs=True)
    best, at = crf.viterbi(chain, scores, lengths), 0
    moves = np.zeros((labels, labels))
    for n in lengths:
        e = scores[at : at + n]
        paths = list(itertools.product(range(labels), repeat=int(n)))
        value = [chain.begins[p[0]] + sum(e[t, p[t]] for t in range(n)) + sum(chain.moves[p[t], p[t + 1]] for t in range(n - 1)) if n else 0.0 for p in paths]
        weight = np.exp(value) / np.exp(value).sum()
        for t in range(n):
            for k in range(labels):
                assert got[at + t, k] == pytest.approx(sum(w for w, p in zip(weight, paths, strict=True) if p[t] == k))
        for w, p in zip(weight, paths, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                moves[a, b] += w
        if n:
            assert tuple(best[at : at + n]) == paths[int(np.argmax(value))]
        at += n
    assert moved == pytest.approx(moves) and begun.sum() == pytest.approx((lengths > 0).sum())


def test_training_learns_moves_and_features():
    dice = np.random.default_rng(0)
    lengths = np.full(100, 40)
    gold = np.concatenate([np.repeat([0, 1], 20) if dice.random() < 0.5 else np.repeat([1, 0], 20) for _ in lengths])
    noisy = np.where(dice.random(len(gold)) < 0.3, 1 - gold, gold)
    chain = crf.train(np.array([[1], [2]]), noisy, gold, lengths, 2, 4, rounds=80)
    assert (crf.viterbi(chain, chain.weights[np.array([1, 2])[noisy]], lengths) == gold).mean() > (noisy == gold).mean() + 0.1
    assert chain.moves[0, 0] + chain.moves[1, 1] > chain.moves[0, 1] + chain.moves[1, 0]


def test_held_out_rows(spark):
    ids = [None, 0, 1, 2, 3, 17, -4, 10**12]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("h", toxicity.held_out()).collect()
    assert [r.h for r in got] == [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_documents_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged = toxicity.assess(docs, labels).where(toxicity.held_out()).join(labels, "doc_id").collect()
    toxic = [r for r in judged if r.toxic]
    clean = [r for r in judged if not r.toxic]
    assert sum(r.score >= 0.7 for r in toxic) >= 0.7 * len(toxic)  # some have lost their toxic words to junk
    assert np.mean([t.score > c.score for t in toxic for c in clean]) > 0.9
    assert sum(r.score >= 0.7 for r in clean) <= 0.03 * len(clean)
    for r in judged:
        assert 0 <= r.score <= 1
        for s in r.spans:
            assert r.text[s.start : s.stop].split() == [r.text[s.start : s.stop]]


def test_edges(spark):
    texts = [f"a fine day number {k} . all is well here" for k in range(40)] + [f"u{k} {a} v{k} {b} stuff . so bad {k}" for k, (a, b) in enumerate(itertools.product(["zarg", "zargo", "florp"], repeat=2))] * 4
    toxic = [0] * 40 + [1] * 36
    rows = [(k, t, "mine") for k, t in enumerate(texts)] + [(None, "zarg zarg", "x"), (900, None, "x"), (901, "", "x"), (902, " \n", "x"), (903, "what a zarg florp thing . " * 4000, "x"), (903, "fine", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(toxic)] + [(None, 1), (900, None), (901, 1)], "doc_id long, toxic int")
    out = toxicity.assess(docs, labels).collect()
    by_text = {r.text: r for r in out}
    assert by_text["zarg zarg"].score > 0.7 > by_text[None].score == by_text[""].score == by_text[" \n"].score
    assert by_text[rows[-2][1]].score > 0.7 and len(by_text[rows[-2][1]].spans) >= 4000
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.where("doc_id = 903").count() == 1 and left.where("doc_id = 900").count() == 1
    assert toxicity.assess(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.assess(docs, labels.limit(0)).collect()} == {0.0}


def test_sample_is_the_same_for_any_layout(spark):
    """Labels without documents use up no place; repeated ids and labels have one meaning."""
    how = toxicity.Training(docs_per_class=5)
    docs = [(k, f"text {k} of a document") for k in range(60)] + [(3, "another text of 3"), (3, "a third"), (None, "no id"), (61, ""), (62, None)]
    labels = [(k, int(k % 2)) for k in range(60)] + [(k, 1) for k in range(1000, 3000)] + [(4, 1), (4, None), (None, 1), (61, 1), (62, 1)]
    seen = set()
    for order in (1, -1):
        d = spark.createDataFrame(docs[::order], "doc_id long, text string").repartition(3 + order)
        texts, ys = toxicity.sample(d, spark.createDataFrame(labels[::order], "doc_id long, toxic int"), how)
        assert sorted(ys) == [0] * 5 + [1] * 5
        assert all(not (zlib.crc32(t.split()[1].encode()) % 3 == 1) for t in texts if t.startswith("text"))
        seen.add(tuple(zip(texts, ys, strict=True)))
    assert len(seen) == 1

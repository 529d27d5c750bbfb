"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are known for documents only. The tokens of the training sample get theirs from the words: a word that toxic
documents use in many contexts and others hardly ever is a toxic token there. The field then learns from their spelling
and neighbours, so it finds forms that the sample lacks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newstide.llm import crf
from newstide.llm.worker import release

SIZE = 1 << 17
STRIP = ".,;:!?\"'()[]«»"
TOKEN = re.compile(r"\S+")


@dataclass(frozen=True)
class Training:
    """The bounds of the sample that is fitted on, and what makes a word a toxic token."""

    docs_per_class: int = 1000
    longest: int = 100_000  # characters of a training document
    sentences: int = 12_000
    share: float = 0.005  # of the toxic documents that have the word, and three of them at least
    contexts: float = 0.4  # different words before it in toxic documents, by document with it, and three at least
    odds: float = 8.0  # share of toxic documents with the word, over that of the others
    rounds: int = 50
    prior: float = 0.2  # share of toxic documents that scores are calibrated for


def word_features(token: str) -> list[int]:
    word = token.strip(STRIP).lower()
    return crf.hashed(["w" + word, "p3" + word[:3], "p4" + word[:4], "p5" + word[:5], "s3" + word[-3:], "n" + str(min(len(word), 12)), "c" + str(word.isalpha())], SIZE)


class Kinds:
    """A number for each distinct token of a worker, with its emission and whether it ends a sentence."""

    def __init__(self, chain: crf.Chain | None = None, limit: int = 400_000):
        self.chain, self.limit = chain, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ends = np.zeros(0, bool)
        self.scores = np.zeros((0, 2))

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self.number) > self.limit:
            self.clear()
        found = list(map(self.number.get, tokens))
        if None in found:
            new = list(dict.fromkeys(t for t, k in zip(tokens, found, strict=True) if k is None))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.ends = np.concatenate([self.ends, [t[-1] in ".!?" for t in new]])
            if self.chain is not None:
                self.scores = np.concatenate([self.scores, crf.emissions(self.chain, np.array([word_features(t) for t in new]))])
            found = list(map(self.number.__getitem__, tokens))
        return np.array(found, np.int64)


def sentences(ends: np.ndarray, doc_lengths: np.ndarray) -> np.ndarray:
    """The lengths of the sentences, none over two documents."""
    stop = ends.copy()
    stop[np.cumsum(doc_lengths)[doc_lengths > 0] - 1] = True
    return np.diff(np.flatnonzero(stop), prepend=-1)


def toxic_words(texts: Sequence[str], toxic: Sequence[int], how: Training) -> set[str]:
    """Words that mark toxic documents: they, or all words with their first four letters, are far more frequent there.

    Copies of one document repeat its rare words, but always after the same word; so several words before are asked for.
    """
    count = (Counter(), Counter())
    before: dict[str, set[str]] = {}
    for text, y in zip(texts, toxic, strict=True):
        words = [t.strip(STRIP).lower() for t in text.split()]
        count[y].update({w for w in words if w} | {w[:4] + "*" for w in words if len(w) > 4})
        if y:
            for a, b in zip(["", *words], words, strict=False):
                before.setdefault(b, set()).add(a)
                before.setdefault(b[:4] + "*", set()).add(a)
    n = [max(1, sum(1 for y in toxic if y == k)) for k in (0, 1)]
    least = max(3, how.share * n[1])
    marks = {w for w, c in count[1].items() if c >= least and len(before[w]) >= max(3, how.contexts * c) and c / n[1] >= how.odds * (count[0][w] + 0.1) / n[0]}
    return {w for w in count[1] if w in marks or (len(w) > 4 and w[:4] + "*" in marks)}


def fit(texts: Sequence[str], toxic: Sequence[int], how: Training = Training()) -> crf.Chain:
    """A field from labelled documents. Without documents of both labels every score is the share of toxic ones."""
    share = sum(toxic) / len(toxic) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return crf.Chain(np.zeros((SIZE, 2)), np.zeros((2, 2)), np.zeros(2), {"constant": float(share)})
    marks = toxic_words(texts, toxic, how)
    kinds = Kinds()
    docs = [t.split() for t in texts]
    lengths = np.array([len(d) for d in docs])
    number = kinds.of([t for d in docs for t in d])
    names = list(kinds.number)
    is_mark = np.array([t.strip(STRIP).lower() in marks for t in names])
    gold = (is_mark[number] & np.repeat(np.array(toxic, bool), lengths)).astype(np.int64)
    parts = sentences(kinds.ends[number], lengths)
    starts = np.cumsum(parts) - parts
    marked = np.add.reduceat(gold, starts) > 0
    order = np.random.default_rng(0).permutation(len(parts))
    pick = np.concatenate([order[marked[order]][: how.sentences // 2], order[~marked[order]][: how.sentences // 2]])
    place = np.concatenate([np.arange(starts[k], starts[k] + parts[k]) for k in pick])
    some, kind = np.unique(number[place], return_inverse=True)
    features = np.array([word_features(names[k]) for k in some])
    chain = crf.train(features, kind, gold[place], parts[pick], 2, SIZE, how.rounds)
    sums = np.array([_summary(p) for p in Scorer(chain).documents(texts)])
    chain.more["calibration"] = _logistic(sums, np.array(toxic), how.prior)
    chain.weights = chain.weights.astype(np.float32)
    return chain


def _summary(p: np.ndarray) -> tuple[float, float, float]:
    """What a document's marginals come down to: the expected toxic tokens, and the odds of the two most toxic ones."""
    two = [*np.sort(np.partition(p, -2)[-2:])[::-1]] if len(p) > 1 else [*p, 0.0, 0.0][:2]
    odds = [math.log(x / (1 - x)) for x in (min(max(float(v), 1e-4), 1 - 1e-4) for v in two)]
    return math.log1p(float(p.sum())), odds[0], odds[1]


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, rounds: int = 200) -> tuple[float, ...]:
    """Slopes and an offset by Newton steps with a small ridge; toxic documents weigh ``prior`` of all."""
    x1 = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (weight * (p - y)) + 0.1 * w
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + 0.1 * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


class Scorer:
    """Marginals of whole documents, chunk by chunk."""

    def __init__(self, chain: crf.Chain):
        self.chain, self.kinds = chain, Kinds(chain)

    def documents(self, texts: Iterable[str | None], chunk: int = 1 << 20) -> Iterator[np.ndarray]:
        """Per document the marginals of its tokens."""
        some, size = [], 0
        for text in texts:
            some.append((text or "").split())
            size += len(text or "")
            if size >= chunk:
                yield from self._chunk(some)
                some, size = [], 0
        yield from self._chunk(some)

    def _chunk(self, docs: list[list[str]]) -> Iterator[np.ndarray]:
        lengths = np.array([len(d) for d in docs], np.int64)
        p = np.zeros(0)
        if lengths.sum():
            number = self.kinds.of([t for d in docs for t in d])
            parts = sentences(self.kinds.ends[number], lengths)
            p = crf.marginals(self.chain, self.kinds.scores[number], parts)[:, 1]
        yield from np.split(p, np.cumsum(lengths)[:-1]) if len(docs) else []

    def score(self, p: np.ndarray) -> float:
        if "constant" in self.chain.more:
            return self.chain.more["constant"]
        value = sum(a * x for a, x in zip(self.chain.more["calibration"], (*_summary(p), 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, value))))


def score(docs: DataFrame, chain: crf.Chain, text: str = "text", span: float = 0.5) -> DataFrame:
    """Add score (0 to 1), expected (sum of the marginals) and spans (start, stop in code points, and the marginal).

    ``spans`` holds the tokens whose marginal is at least ``span``. A null or empty text has no tokens and the score of
    an expectation of 0. Columns already called so are replaced, all others stay. Rows are independent of each other.
    """
    kind = "struct<score: double, expected: double, spans: array<struct<start: int, stop: int, prob: double>>>"
    typed = pa.struct([("score", pa.float64()), ("expected", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("prob", pa.float64())])))])

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        scorer = Scorer(chain)
        for part in parts:
            out = []
            texts = (x.as_py() for x in part)
            for k, p in enumerate(scorer.documents(texts)):
                spans = []
                found = np.flatnonzero(p >= span)
                if len(found):
                    places = [m.span() for m in TOKEN.finditer(part[k].as_py())]
                    spans = [{"start": places[t][0], "stop": places[t][1], "prob": float(p[t])} for t in found]
                out.append({"score": scorer.score(p), "expected": float(p.sum()), "spans": spans})
            yield pa.array(out, typed)
            part = out = None  # not while the next batch comes in
            release()
        del scorer
        release()

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), run(F.col(text)).alias("new"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("score", "expected", "spans")], "new.*")


def held_out(id: str = "doc_id") -> Column:
    """Rows that no model may learn from: those whose crc32 of the id as text leaves 1 modulo 3. False without an id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, how: Training = Training(), id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int]]:
    """A bounded sample of labelled documents that are not held out: at most ``docs_per_class`` ids of each label.

    Ids are counted among documents that can be learnt from, and which are taken depends on a hash of the id alone. A null label
    or id, an empty text and one above ``longest`` characters take no part. An id with several labels is toxic if one of them
    says so; of several texts of an id the one with the least hash is taken, so the layout of the tables does not matter.
    """
    usable = docs.where(F.length(F.col(text)).between(1, how.longest) & ~held_out(id)).select(F.col(id).alias("_id"))
    marks = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    open_ = marks.join(usable, "_id", "left_semi")
    order = (F.xxhash64("_id"), F.col("_id"))
    ids = reduce(DataFrame.union, [open_.where(F.col("_y") == y).orderBy(*order).limit(how.docs_per_class) for y in (1, 0)])
    found = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id").where(F.length("_text").between(1, how.longest))
    first = found.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text"))["_text"].alias("_text"), F.max("_y").alias("_y"))
    rows = first.orderBy(*order).select("_text", "_y").collect()  # two bounded classes
    return [r["_text"] for r in rows], [r["_y"] for r in rows]


def assess(docs: DataFrame, labels: DataFrame, how: Training = Training(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` with a field fitted on ``sample`` of the same documents."""
    return score(docs, fit(*sample(docs, labels, how, id, text), how), text)


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7, how: Training = Training(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose score is below ``limit``, with their own columns, whatever they are called.

    Rows with a null or empty text have the score of a text without tokens; repeated rows all stay or all go.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return assess(whole, labels.withColumnRenamed(id, "doc_id"), how, "doc_id", "text").where(F.col("score") < limit).select("_row.*")

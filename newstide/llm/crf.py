"""A linear-chain conditional random field in numpy, over many sequences at once.

Emission scores come from hashed features of a token; transitions from one matrix. Sequences are dealt into matrices of
about equal length, so that each step of a recursion works on all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Chain:
    """``weights``: by hashed feature and label; ``moves``: from label to label; ``begins``: of the first label."""

    weights: np.ndarray
    moves: np.ndarray
    begins: np.ndarray
    more: dict = field(default_factory=dict)

    @property
    def labels(self) -> int:
        return self.weights.shape[1]


def hashed(features: Sequence[str], size: int) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % size for f in features]


def buckets(lengths: np.ndarray, cells: int = 1 << 18) -> Iterator[np.ndarray]:
    """Sequences by about equal length; an empty sequence is in none."""
    order = np.argsort(lengths, kind="stable")
    at = int(np.searchsorted(lengths[order], 1))
    while at < len(order):
        width = int(lengths[order[at]])
        end = at + 1
        most = max(width + 8, width + width // 4)
        while end < len(order) and lengths[order[end]] <= most and (end - at) * most < cells:
            end += 1
        yield order[at:end]
        at = end


def _matrix(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the scores by step, sequence and label; the place of each cell; which cells are inside."""
    columns = np.arange(int(lengths.max()))
    inside = columns < lengths[:, None]
    place = np.where(inside, starts[:, None] + columns, starts[:, None])
    values = scores[place]
    values = np.exp(values - values.max(2, keepdims=True))
    values[~inside] = 1.0
    return values, place, inside


def marginals(chain: Chain, scores: np.ndarray, lengths: np.ndarray, pairs: bool = False):
    """Forward-backward: the probability of each label at each token, and of each move if ``pairs`` (summed up).

    ``scores`` has the emission of each token of all sequences, one sequence after the other.
    """
    out = np.zeros_like(scores, dtype=np.float64)
    starts = np.cumsum(lengths) - lengths
    moves, begins = np.exp(chain.moves), np.exp(chain.begins)
    moved, begun = np.zeros_like(moves), np.zeros_like(begins)
    for some in buckets(lengths):
        e, place, inside = _matrix(scores, starts[some], lengths[some])
        n, width, _ = e.shape
        ahead = np.empty_like(e)
        a = begins * e[:, 0]
        ahead[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, width):
            a = (ahead[:, t - 1] @ moves) * e[:, t]
            ahead[:, t] = np.where(inside[:, t, None], a / a.sum(1, keepdims=True), ahead[:, t - 1])
        behind = np.ones((n, chain.labels))
        prob = np.empty_like(e)
        for t in range(width - 1, -1, -1):
            p = ahead[:, t] * behind
            prob[:, t] = p / p.sum(1, keepdims=True)
            if t:
                back = e[:, t] * behind
                if pairs:
                    joint = ahead[:, t - 1, :, None] * moves * back[:, None, :]
                    moved += (joint / joint.sum((1, 2), keepdims=True))[inside[:, t]].sum(0)
                b = back @ moves.T
                behind = np.where(inside[:, t, None], b / b.sum(1, keepdims=True), behind)
        begun += prob[:, 0].sum(0)
        out[place[inside]] = prob[inside]
    return (out, moved, begun) if pairs else out


def viterbi(chain: Chain, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The labels of the best path of each sequence; of equal paths the one with smaller labels at its end."""
    out = np.zeros(len(scores), np.int64)
    starts = np.cumsum(lengths) - lengths
    for some in buckets(lengths):
        columns = np.arange(int(lengths[some].max()))
        inside = columns < lengths[some][:, None]
        place = np.where(inside, starts[some][:, None] + columns, starts[some][:, None])
        best = chain.begins + scores[place[:, 0]]
        came = np.zeros((len(some), len(columns), chain.labels), np.int8)
        for t in range(1, len(columns)):
            paths = best[:, :, None] + chain.moves
            came[:, t] = paths.argmax(1)
            best = np.where(inside[:, t, None], paths.max(1) + scores[place[:, t]], best)
        label = best.argmax(1)
        path = np.zeros(inside.shape, np.int64)
        rows = np.arange(len(some))
        for t in range(len(columns) - 1, -1, -1):
            path[:, t] = label
            if t:
                label = np.where(inside[:, t], came[rows, t, label], label)
        out[place[inside]] = path[inside]
    return out


def emissions(chain: Chain, features: np.ndarray) -> np.ndarray:
    """Scores by token and label from rows of hashed features."""
    return chain.weights[features].sum(1)


def train(
    features: np.ndarray,
    kinds: np.ndarray,
    gold: np.ndarray,
    lengths: np.ndarray,
    labels: int,
    size: int,
    rounds: int = 60,
    rate: float = 0.3,
    decay: float = 1e-4,
    watch: Callable[[int, float], None] | None = None,
) -> Chain:
    """Maximum likelihood by full gradients with steps scaled per parameter (Adam).

    ``features``: rows of hashed features by kind of token; ``kinds``: the kind of each token; ``gold``: its label.
    """
    chain = Chain(np.zeros((size, labels)), np.zeros((labels, labels)), np.zeros(labels))
    used = np.unique(features)
    local = np.searchsorted(used, features)
    weights = np.zeros((len(used), labels))
    right = np.eye(labels)[gold]
    starts = np.cumsum(lengths) - lengths
    first = starts[lengths > 0]
    follows = np.ones(len(gold), bool)
    follows[first] = False
    seen_moves = np.zeros((labels, labels))
    np.add.at(seen_moves, (gold[:-1][follows[1:]], gold[1:][follows[1:]]), 1)
    seen_begins = right[first].sum(0)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, chain.moves, chain.begins)]
    total = max(len(gold), 1)
    for turn in range(1, rounds + 1):
        scores = weights[local].sum(1)[kinds]
        prob, moved, begun = marginals(chain, scores, lengths, pairs=True)
        wrong = np.stack([np.bincount(kinds, (prob - right)[:, k], len(features)) for k in range(labels)], 1)
        slope = np.stack([np.bincount(local.ravel(), np.repeat(wrong[:, k], local.shape[1]), len(used)) for k in range(labels)], 1)
        for p, g, (m, v) in zip((weights, chain.moves, chain.begins), (slope, moved - seen_moves, begun - seen_begins), state, strict=True):
            g = g / total + decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        if watch:
            watch(turn, float(np.log(np.maximum((prob * right).sum(1), 1e-12)).mean()))
    chain.weights[used] = weights
    return chain

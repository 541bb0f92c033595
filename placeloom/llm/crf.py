"""A small linear-chain conditional random field over hashed features.

Training maximises the regularised conditional log-likelihood with AdaGrad; gradients come from
forward-backward. Decoding is Viterbi. A sequence may be a piece of a longer one between two
positions of known state: its ends then count the moves from and to these states.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np

NEVER = -1e30


@lru_cache(maxsize=1 << 16)
def bucket(feature: str, n: int) -> int:
    return crc32(feature.encode()) % n


@dataclass
class LinearChainCRF:
    weights: np.ndarray  # features x states
    moves: np.ndarray  # state to state
    first: np.ndarray  # of the first state

    @property
    def n_features(self) -> int:
        return len(self.weights)

    def ids(self, features: list[str]) -> list[int]:
        return [bucket(f, self.n_features) for f in features]

    def emissions(self, seq: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[ids].sum(axis=0) for ids in seq])

    def viterbi(self, seq: list[list[int]], before: int | None = None, after: int | None = None) -> list[int]:
        e = self.emissions(seq)
        score, back = (self.first if before is None else self.moves[before]) + e[0], []
        for row in e[1:]:
            ways = score[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + row
        path = [int((score if after is None else score + self.moves[:, after]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    @classmethod
    def fit(cls, data: list[tuple], n_features: int, n_states: int, epochs: int = 8, rate: float = 0.3, l2: float = 1e-4, seed: int = 0, forbidden: tuple = (), forbidden_first: tuple = ()) -> LinearChainCRF:
        """``data``: sequences of feature ids with their states, and the states before and after where
        there are; equal data and seed give equal models."""
        model = cls(np.zeros((n_features, n_states)), np.zeros((n_states, n_states)), np.zeros(n_states))
        for a, b in forbidden:
            model.moves[a, b] = NEVER
        for a in forbidden_first:
            model.first[a] = NEVER
        gw, gm, gf = np.full_like(model.weights, 1e-2), np.full_like(model.moves, 1e-2), np.full_like(model.first, 1e-2)
        rng = np.random.Generator(np.random.PCG64(seed))
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                model._step(*(*data[i], None, None)[:4], gw, gm, gf, rate, l2)
        return model

    def _step(self, seq, tags, before, after, gw, gm, gf, rate, l2) -> None:
        e = self.emissions(seq)
        n = len(e)
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[0] = (self.first if before is None else self.moves[before]) + e[0]
        if after is not None:
            bwd[-1] = self.moves[:, after]
        for t in range(1, n):
            fwd[t] = _logsum(fwd[t - 1][:, None] + self.moves) + e[t]
        for t in range(n - 2, -1, -1):
            bwd[t] = _logsum((self.moves + (e[t + 1] + bwd[t + 1])[None, :]).T)
        z = _logsum((fwd[-1] + bwd[-1])[:, None])[0]
        g = np.exp(fwd + bwd - z)
        start = g[0].copy()
        pair = np.zeros_like(self.moves)
        for t in range(1, n):
            pair += np.exp(fwd[t - 1][:, None] + self.moves + (e[t] + bwd[t])[None, :] - z)
            pair[tags[t - 1], tags[t]] -= 1
        start[tags[0]] -= 1
        if before is not None:
            pair[before] += start
            start[:] = 0
        if after is not None:
            pair[:, after] += g[-1]
            pair[tags[-1], after] -= 1
        g[np.arange(n), tags] -= 1
        flat = np.concatenate([np.asarray(ids, np.int64) for ids in seq])
        grad = np.repeat(g, [len(ids) for ids in seq], axis=0)
        grad += l2 * self.weights[flat]
        np.add.at(gw, flat, grad**2)
        np.add.at(self.weights, flat, -rate * grad / np.sqrt(gw[flat]))
        for value, of, at in ((pair, gm, self.moves), (start, gf, self.first)):
            of += value**2
            at -= np.where(at <= NEVER / 2, 0, rate * value / np.sqrt(of))


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))

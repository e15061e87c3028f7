"""Descriptors of state sequences that need the whole sequence at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class Automaton:
    """The suffix automaton of a sequence: the length, suffix link, moves and first end of each class of stretches."""

    def __init__(self, states: list[int]):
        self.length, self.link, self.first, self.move = [0], [-1], [-1], [{}]
        last = 0
        for at, s in enumerate(states):
            last = self._extend(last, s, at)

    def _add(self, length: int, link: int, first: int, move: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        self.move.append(move)
        return len(self.length) - 1

    def _extend(self, last: int, s: int, at: int) -> int:
        new = self._add(self.length[last] + 1, 0, at, {})
        p = last
        while p >= 0 and s not in self.move[p]:
            self.move[p][s] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.move[p][s]
        if self.length[q] != self.length[p] + 1:  # a shorter class of q's stretches becomes one of its own
            copy = self._add(self.length[p] + 1, self.link[q], self.first[q], dict(self.move[q]))
            while p >= 0 and self.move[p].get(s) == q:
                self.move[p][s] = copy
                p = self.link[p]
            self.link[q] = copy
            q = copy
        self.link[new] = q
        return new


def novel_lengths(states: np.ndarray) -> np.ndarray:
    """For each place, the length of the shortest stretch from there that no earlier place begins.

    A stretch began earlier if the first end of its class in the suffix automaton lies
    before its own end.  The longest known stretch of a place is at most one shorter
    than that of the place before, so both ends only move forward: the work is linear.
    """
    states = np.asarray(states).tolist()
    a, n = Automaton(states), len(states)
    out, node, size = np.ones(n, int), 0, 0
    for i in range(n):
        while i + size < n:
            there = a.move[node].get(states[i + size])
            if there is None or a.first[there] >= i + size:
                break
            node, size = there, size + 1
        out[i] = size + 1
        if size:
            size -= 1
            if node and size <= a.length[a.link[node]]:
                node = a.link[node]
    return np.minimum(out, np.arange(n, 0, -1) + 1)


def lz_rate(states: list | None, n_states: int = 5, least: int = 20, cap: float = 1.5) -> float | None:
    if states is None or len(states) < least:
        return None
    n = len(states)
    return float(min(n * math.log(n) / novel_lengths(np.asarray(states)).sum() / math.log(n_states), cap))


@F.pandas_udf(DoubleType())
def lz_entropy(states: pd.Series) -> pd.Series:
    """Entropy rate of each sequence from match lengths, over log(5), at most 1.5; null below 20 states."""
    return states.map(lz_rate, na_action="ignore").astype(float)

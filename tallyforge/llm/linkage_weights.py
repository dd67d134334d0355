"""Weights of probabilistic record linkage, fitted by expectation-maximisation.

The comparison of a pair is a vector of levels, one a field, ``MISSING`` where one side states
nothing, which is no evidence either way. The fit needs only how often each vector occurs, so it
runs on the driver over at most as many rows as there are vectors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

MISSING = -1


@dataclass(frozen=True)
class LinkageWeights:
    """log2(m / u) for each level of each field, and the share of matches among the pairs."""

    weights: tuple[tuple[float, ...], ...]
    prior: float

    def score(self, vector: Sequence[int]) -> float:
        """Bits of evidence that a pair with this comparison vector is a match."""
        return sum(w[v] for w, v in zip(self.weights, vector) if v >= 0)

    def posterior(self, vector: Sequence[int]) -> float:
        odds = math.log2(self.prior / (1 - self.prior)) + self.score(vector)
        return 1 / (1 + 2 ** -max(-500.0, min(500.0, odds)))


def fit(
    counts: dict[tuple[int, ...], float],
    first: Sequence[Sequence[float]],
    fixed_u: Sequence[Sequence[float]] | None = None,
    total: float | None = None,
    first_prior: float = 0.1,
    held: float = 0.1,
    rounds: int = 200,
) -> LinkageWeights:
    """EM over the counts of comparison vectors.

    ``first`` has the m-probability of each level of each field to start from (they say which class is
    the match); they, and ``first_prior``, count as ``held`` pairs of their own, so that a small table
    keeps near them. ``fixed_u`` gives u-probabilities known from all pairs, where those of the
    candidates are distorted by blocking; ``total`` is then the number of all pairs, of which those
    that blocking left out are no matches. Without any pair the start is returned.
    """
    n = float(sum(counts.values()))
    of_all = max(n, total or n)
    m = [list(map(float, ps)) for ps in first]
    if fixed_u:
        u = [[max(1e-9, p) for p in ps] for ps in fixed_u]
    else:
        seen = [[sum(c for v, c in counts.items() if v[f] == k) for k in range(len(ps))] for f, ps in enumerate(first)]
        u = [[(c + 0.5) / (sum(cs) + 0.5 * len(cs)) for c in cs] for cs in seen]
    prior = first_prior
    for _ in range(rounds if n else 0):
        share = {}
        for v in counts:
            a, b = prior, 1 - prior
            for f, k in enumerate(v):
                if k >= 0:
                    a *= m[f][k]
                    b *= u[f][k]
            share[v] = a / (a + b) if a + b else 0.5
        matched = sum(share[v] * c for v, c in counts.items())
        new = min(0.999, max(1e-12, (matched + held * first_prior) / (of_all + held)))
        for f, start in enumerate(first):
            known = sum(share[v] * c for v, c in counts.items() if v[f] >= 0)
            others = sum((1 - share[v]) * c for v, c in counts.items() if v[f] >= 0)
            for k, p in enumerate(start):
                in_k = [(share[v], c) for v, c in counts.items() if v[f] == k]
                m[f][k] = (sum(s * c for s, c in in_k) + held * p) / (known + held)
                if not fixed_u:
                    u[f][k] = (sum((1 - s) * c for s, c in in_k) + 0.1) / (others + 0.1 * len(start))
        if abs(new - prior) < 1e-12:
            break
        prior = new
    weights = tuple(tuple(math.log2(max(1e-9, a) / b) for a, b in zip(ms, us)) for ms, us in zip(m, u))
    return LinkageWeights(weights, min(0.999, max(1e-12, prior)))

"""Random draws that a seed fixes, wherever a task runs."""

from __future__ import annotations

from bisect import bisect_right
from functools import cache
from math import ceil, exp
from statistics import NormalDist

import numpy as np


class Dice:
    """Draws of a seed: a counter, scrambled (SplitMix64), so they are the same wherever a task runs."""

    def __init__(self, *seed):
        self.state = 0
        for part in seed:
            for byte in str(part).encode() + b"|":
                self.state = (self.state * 0x100000001B3 ^ byte) & 0xFFFFFFFFFFFFFFFF

    def random(self) -> float:
        """In [0, 1)."""
        self.state = (self.state + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        z = (z ^ z >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        return ((z ^ z >> 31) >> 11) / (1 << 53)

    def pick(self, values, weights=None):
        if weights is None:
            return values[int(self.random() * len(values))]
        at = np.searchsorted(np.cumsum(weights), self.random() * sum(weights), side="right")
        return values[min(int(at), len(values) - 1)]

    def normal(self, mean: float, sd: float) -> float:
        return NormalDist(mean, sd).inv_cdf(min(max(self.random(), 1e-12), 1 - 1e-12))

    def poisson(self, rate: float) -> int:
        return bisect_right(_totals(rate), self.random())

    def poissons(self, rate: float, n: int) -> np.ndarray:
        """The next n draws of ``poisson`` at once."""
        z = np.uint64(self.state) + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=np.uint64)  # modulo 2^64
        self.state = int(z[-1]) if n else self.state
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return np.searchsorted(_totals(rate), ((z ^ z >> np.uint64(31)) >> np.uint64(11)) / float(1 << 53), side="right")


@cache
def _totals(rate: float) -> list[float]:
    """Probabilities of at most 0, 1, ... rows, as far as draws go."""
    p, out = exp(-rate), [exp(-rate)]
    for k in range(1, ceil(100 + 10 * rate)):
        p *= rate / k
        out.append(out[-1] + p)
    return out

"""Consistent weighted sampling over hashed terms, shared by fingerprints and near-duplicate search.

For sample k, a term of weight w has r, c ~ Gamma(2, 1) and β ~ U(0, 1), drawn from
its hash alone; t = floor(ln w / r + β) and ln a = ln c − r (t − β + 1).  The term with
the smallest a is the sample, together with its t.  Two weighted sets agree in a
sample with the probability of their generalised Jaccard similarity.

The draws are made so that most terms need one number only.  At weight 1, t is 0
and a = c / z with z = exp(r (1 − β)); r (1 − β) is exponential, so z has the density
1 / z² from 1 on, and a and z together have the density a·exp(−a z): a is exponential,
z − 1 exponential with rate a, and, given p = ln z, r − p is exponential too.  So a comes
from one 64-bit hash of (term, sample), of which terms of weight 1 only need the
least; z and r come from a second one, for terms of other weights.  No draw is
shared by two terms, so sets of any size are sampled alike.
"""

from __future__ import annotations

import numpy as np

from quarry.llm.common import mix

CHUNK = 1024
#: Sets the second hash of a (term, sample) apart from the first, and the steps t of a term from one another.
SECOND, STEP = np.uint64(0xD1B54A32D192ED03), np.uint64(0x9E3779B97F4A7C15)


def _exponential(bits: np.ndarray) -> np.ndarray:
    """Exponential draws, ascending with the 64-bit hashes."""
    return -np.log1p(-((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)


def _half(bits: np.ndarray) -> np.ndarray:
    """Exponential draws from 32 bits."""
    return -np.log((bits.astype(np.float64) + 0.5) * 2.0 ** -32)


class Sampler:
    """Weights are taken relative to ``base_weight``, the weight that most terms have."""

    def __init__(self, samples: int, base_weight: float = 1.0, seed: int = 42):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.odd = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
        self.base = base_weight

    def _hashes(self, terms: np.ndarray) -> np.ndarray:
        x = terms[None, :] ^ self.salt[:, None]
        x *= self.odd[:, None]
        return x

    def sample(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Codes (uint64) of all samples of one set; ``terms`` distinct, at least one."""
        rows = np.arange(len(self.odd))
        usual = weights == self.base
        best, code = np.full(len(rows), np.inf), np.zeros(len(rows), np.uint64)
        part = terms[usual]
        if len(part):
            least, which = np.full(len(rows), np.iinfo(np.uint64).max), np.zeros(len(rows), np.uint64)
            for at in range(0, len(part), CHUNK):
                h = part[at:at + CHUNK]
                x = self._hashes(h)
                first = x.argmin(axis=1)
                low = x[rows, first]
                better = low <= least
                least, which = np.where(better, low, least), np.where(better, h[first], which)
            best, code = np.log(_exponential(least)), mix(which)
        part, ln_w = terms[~usual], np.log(weights[~usual] / self.base)
        for at in range(0, len(part), CHUNK):
            h = part[at:at + CHUNK]
            x = self._hashes(h)
            a = _exponential(x)
            more = mix(x ^ SECOND)
            p = np.log1p(_half(more >> np.uint64(32)) / a)
            r = p + _half(more & np.uint64(0xFFFFFFFF))
            beta = 1 - p / r
            t = np.floor(ln_w[at:at + CHUNK][None, :] / r + beta)
            ln_a = np.log(a) + p - r * (t - beta + 1)
            first = ln_a.argmin(axis=1)
            low = ln_a[rows, first]
            found = mix(h[first] ^ (t[rows, first].astype(np.int64).astype(np.uint64) * STEP))
            better = (low < best) | ((low == best) & (found < code))
            best, code = np.where(better, low, best), np.where(better, found, code)
        return code

"""Near-duplicate detection by HyperMinHash: documents whose word-shingle sets reach a Jaccard threshold, and one document of each class.

* **Registers.** Each of ``REGISTERS`` buckets ranks all shingles by a permutation of its own and stores of the least rank the number of leading zeros (6 bits) and
  the ten bits after the first one: 16 bits instead of 64. As every shingle competes in every bucket, sets of a few shingles leave none empty.
* **Bands.** Four registers are one 64-bit word, and documents that agree in one of the 32 words are candidates. At similarity 0.8 a word agrees with probability
  0.8^4, so a pair that just reaches the threshold is missed in 5 of 10^8 cases; above it in fewer.
* **Estimate.** Different minima can look alike once compressed. The share c of such collisions follows from the sizes of two sets, and the estimate of the
  similarity from m equal registers of B is (m/B - c) / (1 - c). Candidates within six standard errors of the threshold go on.
* **Verification** is exact, on the full sets. Stars, components and the rest of the plan are those of the n-gram join: copies are one node, a node is verified
  against the best connected candidate near it, and only what is still apart is compared further.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix
from .ngram_join import Bands, similar_classes

WIDTH, PERCENT = 4, 80
REGISTERS, IN_BAND, MANTISSA = 128, 4, 10
#: Shingles that are ranked at once, so that their ranks stay in the cache.
AT_ONCE = 256
#: Standard errors between the threshold and the least estimate that is verified.
MARGIN = 6.0


def permutations(n: int) -> np.ndarray:
    """Odd multipliers: each permutes the 64-bit hashes."""
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def registers(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of the least rank in every bucket, 16 bits each; of no shingles all bits are set."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    if not len(shingles):
        return np.full(len(multipliers), 0xFFFF, np.uint16)
    for at in range(0, len(shingles), AT_ONCE):
        ranks = multipliers[:, None] * shingles[None, at : at + AT_ONCE]
        np.minimum(least, ranks.min(axis=1), out=least)
    # the upper 53 bits are exact as a double, whose exponent counts the zeros and whose first bits are the mantissa
    bits = (least >> np.uint64(11)).astype(np.float64).view(np.uint64)
    zeros = np.minimum(np.uint64(1023 + 52) - (bits >> np.uint64(52)), np.uint64(63))
    return ((zeros << np.uint64(MANTISSA)) | ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)


def collisions() -> np.ndarray:
    """Probability that a register of two sets without common shingles agrees, for sizes 2^i and 2^j."""
    sizes = 2.0 ** np.arange(48)[:, None]
    zeros = np.arange(53)[None, :]
    # the least of n uniform ranks has l leading zeros
    chance = np.exp(sizes * np.log1p(-(2.0 ** -(zeros + 1.0)))) - np.where(zeros == 0, 0.0, np.exp(sizes * np.log1p(-np.minimum(2.0 ** -zeros.astype(float), 1 - 1e-16))))
    return chance @ chance.T / (1 << MANTISSA)


class Registers(Bands):
    """Blocks and sketches of the n-gram join's plan, by HyperMinHash registers."""

    def __init__(self, percent: int):
        super().__init__(percent)
        self.multipliers, self.chance = permutations(REGISTERS), collisions()
        share = percent / 100
        self.least = share - MARGIN * (share * (1 - share) / REGISTERS) ** 0.5

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        return registers(shingles, self.multipliers).view(np.uint64)

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        bands = self.sketch(shingles)
        return mix(bands + mix(np.arange(1, len(bands) + 1, dtype=np.uint64)))

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (np.ascontiguousarray(a).view(np.uint16) != np.ascontiguousarray(b).view(np.uint16)).sum(-1)

    def estimate(self, a: np.ndarray, b: np.ndarray, differing: np.ndarray) -> np.ndarray:
        """Similarity of sets of a and b shingles with so many differing registers, collisions taken off."""
        c = self._chance(a, b)
        return (1 - differing / REGISTERS - c) / (1 - c)

    def limit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most differing registers of which the estimate is not below the least one."""
        c = self._chance(a, b)
        return np.floor(REGISTERS * (1 - c - self.least * (1 - c)) + 1e-9).astype(np.int64)

    def _chance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i, j = (np.log2(np.maximum(x, 1)).astype(np.int64) for x in (a, b))
        return self.chance[i, j]


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Classes of near duplicates: ``doc_id n_shingles component_id kept``, one row for each row.

    ``component_id`` is the smallest doc_id reachable by links, ``kept`` whether it is the row's own. A null text or one without words is linked with nothing. Rows with equal
    sets, also under one id, are linked. A null id names a class only if nothing else is in it. Other columns are not read.
    """
    classes = similar_classes(docs, width, percent, Registers(percent))
    return classes.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

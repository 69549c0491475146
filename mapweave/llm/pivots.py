"""Pivot distance tables over fingerprints: Hamming distances to reference fingerprints, and what they rule out.

By the triangle inequality two fingerprints within `bits` bits differ by no more than `bits` in any distance to a third one. So
pairs with a larger difference in some coordinate are discarded, and only survivors are compared on all their bits.
"""

from __future__ import annotations

import numpy as np

#: Coordinates of a table: one byte each in a 64-bit number.
PIVOTS = 8


def references(words: int, seed: int = 64) -> np.ndarray:
    """Fixed reference fingerprints of so many 64-bit words."""
    return np.random.default_rng(seed).integers(0, 1 << 64, (PIVOTS, words), dtype=np.uint64)


def coordinates(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots): distances of fingerprints (rows, words), of 64 bits or 128, to the pivots (pivots, words)."""
    return sum(np.bitwise_count(fp[:, w, None] ^ pivots[None, :, w]).astype(np.int16) for w in range(fp.shape[1]))


def packed(table: np.ndarray) -> np.ndarray:
    """Eight coordinates as one signed number, the first one highest, so that its order is that of the first coordinate."""
    return np.ascontiguousarray(table.astype(np.uint8)).view(">i8").ravel().astype(np.int64)


def unpacked(table: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(table.astype(">i8")).view(np.uint8).reshape(len(table), PIVOTS).astype(np.int16)


def linked(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which of the pairs i, j lie within `bits` bits: discards by coordinates, a few at a time, then verifies."""
    keep = np.arange(len(i))
    for k in range(0, table.shape[1], 4):
        keep = keep[np.abs(table[i[keep], k : k + 4] - table[j[keep], k : k + 4]).max(axis=1, initial=0) <= bits]
    return keep[np.bitwise_count(fp[i[keep]] ^ fp[j[keep]]).sum(axis=1, dtype=np.int64) <= bits]


def majority(digests: np.ndarray) -> np.ndarray:
    """Bits that over half of the digests (rows of bytes) have, as bytes."""
    counts = np.zeros(8 * digests.shape[1], np.int64)
    for k in range(0, len(digests), 1 << 15):
        counts += np.unpackbits(digests[k : k + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(digests))

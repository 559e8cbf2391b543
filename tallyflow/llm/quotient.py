"""A counting quotient filter over 64-bit fingerprints, exact because it keeps every bit of them.

A fingerprint is split in three: a block number (top bits), a quotient inside the block, and a
remainder. A block stores its occupied quotients as bits, the end of each quotient's run as bits,
the remainders of all runs in sorted order, and a count for each remainder. Nothing is lost, so two
filters merge by merging their sorted remainders and adding counts.
"""

from __future__ import annotations

import numpy as np

BLOCK_BITS = 10
QUOTIENT_BITS = 12
REMAINDER_BITS = 64 - BLOCK_BITS - QUOTIENT_BITS
BLOCKS = 1 << BLOCK_BITS


def block_of(fingerprints: np.ndarray) -> np.ndarray:
    """Block number of each unsigned fingerprint."""
    return (fingerprints >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)


def summed(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order with their counts added up."""
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    if not len(fingerprints):
        return fingerprints, counts
    first = np.flatnonzero(np.concatenate([[True], fingerprints[1:] != fingerprints[:-1]]))
    return fingerprints[first], np.add.reduceat(counts, first)


def encode(fingerprints: np.ndarray, counts: np.ndarray) -> dict[str, bytes]:
    """One block's filter from its sorted distinct fingerprints."""
    low = fingerprints & np.uint64((1 << (64 - BLOCK_BITS)) - 1)
    quotients = (low >> np.uint64(REMAINDER_BITS)).astype(np.int64)
    remainders = low & np.uint64((1 << REMAINDER_BITS) - 1)
    occupied = np.zeros(1 << QUOTIENT_BITS, bool)
    occupied[quotients] = True
    run_ends = np.concatenate([quotients[1:] != quotients[:-1], [True]])[: len(quotients)]
    return {
        "occupied": np.packbits(occupied).tobytes(),
        "run_ends": np.packbits(run_ends).tobytes(),
        "remainders": remainders.astype("<u8").tobytes(),
        "counts": counts.astype("<i8").tobytes(),
    }


def decode(block: int, occupied: bytes, run_ends: bytes, remainders: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of one block's filter and their counts."""
    rest = np.frombuffer(remainders, "<u8")
    ends = np.unpackbits(np.frombuffer(run_ends, np.uint8), count=len(rest)).astype(bool)
    used = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))
    run = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(rest) else np.zeros(0, np.int64)
    quotients = used[run].astype(np.uint64)
    high = np.uint64(block << (64 - BLOCK_BITS))
    return high | (quotients << np.uint64(REMAINDER_BITS)) | rest, np.frombuffer(counts, "<i8")

"""Counting quotient filters over packed word-id phrases, exact because they keep every bit.

Ids are packed in as many bits as the largest needs, as many ids to a 64-bit lane as fit. An invertible
permutation of the first lane's bits mixes all lanes into it. Its top bits are the block, the next ones the
quotient; its other bits and the further lanes are the remainder, kept in full. A filter of one block holds
the occupied quotients as bits, the end of each quotient's run as bits, the remainders in sorted order, and
their counts. As nothing is lost, filters merge by their sorted remainders and give the phrases back.
"""

from __future__ import annotations

import numpy as np

_ODD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15]
_INVERSE = [pow(m, -1, 1 << 64) for m in _ODD]


def lanes_of(n: int, width: int) -> int:
    """Lanes of a phrase of ``n`` ids of ``width`` bits."""
    return -(-n // (64 // width))


def first_bits(n: int, width: int) -> int:
    """Bits in use of the first lane."""
    return width * min(n, 64 // width)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def mix(x: np.ndarray, bits: int = 64) -> np.ndarray:
    """A bijection of numbers of ``bits`` bits."""
    for m in _ODD:
        x = ((x ^ (x >> np.uint64((bits + 1) // 2))) * np.uint64(m)) & _mask(bits)
    return x ^ (x >> np.uint64((bits + 1) // 2))


def unmix(x: np.ndarray, bits: int = 64) -> np.ndarray:
    """The inverse of ``mix``."""
    # a shift by half the bits or more undoes itself
    for m in reversed(_INVERSE):
        x = x ^ (x >> np.uint64((bits + 1) // 2))
        x = (x * np.uint64(m)) & _mask(bits)
    return x ^ (x >> np.uint64((bits + 1) // 2))


def _rest(lanes: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(lanes), np.uint64)
    for column in range(1, lanes.shape[1]):
        out = mix(out + lanes[:, column] + np.uint64(_ODD[2]))
    return out & _mask(bits)


def pack(grams: np.ndarray, width: int) -> np.ndarray:
    """Permuted lanes of phrases, a row of word ids of ``width`` bits each."""
    n, each = grams.shape[1], 64 // width
    lanes = np.zeros((len(grams), lanes_of(n, width)), np.uint64)
    for k in range(n):
        lanes[:, k // each] |= grams[:, k].astype(np.uint64) << np.uint64(width * (k % each))
    bits = first_bits(n, width)
    lanes[:, 0] = mix(lanes[:, 0] ^ _rest(lanes, bits), bits)
    return lanes


def unpack(lanes: np.ndarray, n: int, width: int) -> np.ndarray:
    """The word ids of permuted lanes."""
    plain, bits, each = lanes.copy(), first_bits(n, width), 64 // width
    plain[:, 0] = unmix(lanes[:, 0], bits) ^ _rest(lanes, bits)
    return np.stack([(plain[:, k // each] >> np.uint64(width * (k % each))) & _mask(width) for k in range(n)], axis=1)


def in_order(lanes: np.ndarray) -> np.ndarray:
    """The order of phrases in their filter: by block, quotient and remainder."""
    return np.lexsort(lanes.T[::-1]) if lanes.shape[1] > 1 else np.argsort(lanes[:, 0], kind="stable")


def block_of(lanes: np.ndarray, bits: int, first: int) -> np.ndarray:
    """The block of each phrase: the top ``bits`` of the ``first`` bits of the first lane."""
    return (lanes[:, 0] >> np.uint64(first - bits)).astype(np.int64) if bits else np.zeros(len(lanes), np.int64)


def _parts(size: int, bits: int, first: int) -> tuple[int, int, int]:
    """Bits of the quotient and of the first lane's remainder, and its bytes; there are about as many quotients as phrases."""
    quotient = min(max(1, size.bit_length()), first - bits)
    rest = first - bits - quotient
    return quotient, rest, -(-rest // 8)


def encode(lanes: np.ndarray, counts: np.ndarray, bits: int, first: int) -> dict[str, bytes]:
    """One block's filter of distinct phrases in order."""
    quotient_bits, rest_bits, rest_bytes = _parts(len(lanes), bits, first)
    low = lanes[:, 0] & _mask(first - bits)
    quotients = (low >> np.uint64(rest_bits)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients] = True
    run_ends = np.concatenate([quotients[1:] != quotients[:-1], [True]])
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << (8 * w - 1))
    rest = (low & _mask(rest_bits)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :rest_bytes]
    further = np.ascontiguousarray(lanes[:, 1:]).astype("<u8").view(np.uint8).reshape(len(lanes), -1)
    return {
        "occupied": np.packbits(occupied).tobytes(),
        "run_ends": np.packbits(run_ends).tobytes(),
        "remainders": np.hstack([rest, further]).tobytes(),
        "counts": counts.astype(f"<i{width}").tobytes(),
    }


def decode(
    block: int, occupied: bytes, run_ends: bytes, remainders: bytes, counts: bytes, bits: int, first: int, lanes: int, size: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one block's filter in order, as permuted lanes, and their counts."""
    _, rest_bits, rest_bytes = _parts(size, bits, first)
    raw = np.frombuffer(remainders, np.uint8).reshape(size, rest_bytes + 8 * (lanes - 1))
    rest = np.zeros((size, 8), np.uint8)
    rest[:, :rest_bytes] = raw[:, :rest_bytes]
    ends = np.unpackbits(np.frombuffer(run_ends, np.uint8), count=size).astype(bool)
    used = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))
    run = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64)
    out = np.empty((size, lanes), np.uint64)
    high = np.uint64(block << (first - bits)) if bits else np.uint64(0)
    out[:, 0] = high | (used[run].astype(np.uint64) << np.uint64(rest_bits)) | rest.view("<u8")[:, 0]
    if lanes > 1:
        out[:, 1:] = np.ascontiguousarray(raw[:, rest_bytes:]).view("<u8").reshape(size, lanes - 1)
    return out, np.frombuffer(counts, f"<i{len(counts) // size}").astype(np.int64)


def merged(lanes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filters of one block as one: distinct phrases in order, their summed counts, and each input phrase's place there."""
    every, number = np.concatenate(lanes), np.concatenate(counts)
    order = in_order(every)
    every, number = every[order], number[order]
    first = np.concatenate([[True], (every[1:] != every[:-1]).any(axis=1)])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    return every[first], np.add.reduceat(number, np.flatnonzero(first)), place

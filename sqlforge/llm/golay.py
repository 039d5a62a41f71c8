"""Keys of 64-bit fingerprints by the (23, 12) Golay code.

The code is perfect: each 23-bit word lies within three bits of exactly one codeword. The key set of a word is
the codewords nearest to it and to the words one bit away (one or six of them), so two words that
differ in at most two bits share a key.

A fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at most
four bits, then by the pigeonhole principle

- either each segment differs in at most two bits: they share a key in all three, so each triple of
  keys is one joint key (kind 0);
- or one segment takes three or four of the bits: of the other two one is equal and the other differs
  in at most one bit, so the equal segment with a key of the other is a joint key (kinds 1 to 6, by
  which segment is free and which is equal).

No pair is lost, and a joint key has 33 to 36 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR = 0b110001110101   # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
WIDTHS = (22, 21, 21)
SHIFTS = (0, 22, 43)
MOST = 4                     # bits for which the joint keys lose no pair


def _remainders(n: int) -> np.ndarray:
    """Remainder of each n-bit word times x^0 by the generator."""
    words = np.arange(1 << n, dtype=np.int64)
    for bit in range(n - 1, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


_LOW = _remainders(12)                                   # bits 0 to 11
_HIGH = np.zeros(1 << 11, dtype=np.int64)                # bits 12 to 22, by the remainders of single bits
for _bit in range(11):
    _one = 1 << (12 + _bit)
    for _k in range(22, 10, -1):
        if _one >> _k & 1:
            _one ^= GENERATOR << (_k - 11)
    _HIGH ^= np.where(np.arange(1 << 11) >> _bit & 1, _one, 0)


def syndrome(words: np.ndarray) -> np.ndarray:
    return _LOW[words & 0xFFF] ^ _HIGH[words >> 12]


_ERROR = np.zeros(1 << 11, dtype=np.int64)               # the error of up to three bits behind each syndrome
for _n in (1, 2, 3):
    _patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), _n)], dtype=np.int64)
    _ERROR[syndrome(_patterns)] = _patterns


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Number (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _ERROR[syndrome(words)]) >> 11


def key_sets(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct keys of each word of ``width`` bits, six columns, -1 where there are fewer."""
    flips = np.array([0, *(1 << b for b in range(width))], dtype=np.int64)
    found = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    new = np.ones_like(found, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    place = np.cumsum(new, axis=1) - 1
    out = np.full((len(words), 6), -1, dtype=np.int64)
    rows, cols = np.nonzero(new)
    out[rows, place[rows, cols]] = found[rows, cols]
    return out


def joint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the fingerprint, joint key) for all joint keys of unsigned 64-bit fingerprints."""
    seg = [((prints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS)]
    sets = [key_sets(v, w) for v, w in zip(seg, WIDTHS)]
    rows, keys = [], []

    def put(valid: np.ndarray, key: np.ndarray) -> None:
        at = np.nonzero(valid)
        rows.append(at[0])
        keys.append(key[at])

    a, b, c = sets[0][:, :, None, None], sets[1][:, None, :, None], sets[2][:, None, None, :]
    put((a >= 0) & (b >= 0) & (c >= 0), (a << 24) | (b << 12) | c)
    kind = 1
    for free in range(3):
        for same in range(3):
            if same != free:
                other = 3 - free - same
                put(sets[other] >= 0, np.int64(kind << 40) | seg[same][:, None] << 12 | sets[other])
                kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of unsigned 64-bit fingerprints."""
    return np.bitwise_count(a ^ b)

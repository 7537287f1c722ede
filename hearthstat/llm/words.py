"""Words of whole texts as arrays: places, owning document, 64-bit hashes, and hashes of windows of words."""

from __future__ import annotations

import copy

import numpy as np

#: Fixed odd multipliers of the rolling hashes (any odd numbers do) and the steps of the bit mixer.
_BYTE_BASE = 0x9E6D62D06F6A9A9B
_WORD_BASE = 0xC2B2AE3D27D4EB4F
_BLOCK = 1 << 16

#: The white space that parts words: space and the control characters 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """Bit mixer of 64-bit values, one to one."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class _Powers:
    """Powers of one base for large exponents, from two tables."""

    def __init__(self, base: int):
        self.low = powers(base, _BLOCK)
        self.high = powers(pow(base, _BLOCK, 1 << 64), 1 << 15)

    def __call__(self, exponents: np.ndarray) -> np.ndarray:
        return self.low[exponents & (_BLOCK - 1)] * self.high[exponents >> 16]


_BYTE_POWERS, _BYTE_INVERSES = _Powers(_BYTE_BASE), _Powers(_inverse(_BYTE_BASE))
_WORD_POWERS, _WORD_INVERSES = _Powers(_WORD_BASE), _Powers(_inverse(_WORD_BASE))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def per_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks are set in each text of a buffer."""
    sums = np.cumsum(marks, dtype=np.int32)
    return np.diff(np.where(offsets > 0, sums[offsets - 1], 0)).astype(np.int64) if len(sums) else np.zeros(len(offsets) - 1, np.int64)


class Words:
    """Words of a buffer of texts; ``offsets`` bounds the texts. Words never cross texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        solid = ~_SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        first[cuts] = solid[cuts]
        last = solid
        del solid
        follows = np.ones(len(data) + 1, bool)
        follows[:-1] = ~last
        follows[cuts] = True
        last &= follows[1:]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.docs = np.searchsorted(offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.docs, minlength=len(offsets) - 1).astype(np.int64)
        self.firsts = np.concatenate(([0], np.cumsum(self.counts)))
        if hashed:
            self.hashes = self._hashes(data)

    def of(self, data: np.ndarray) -> Words:
        """The same words in a buffer that differs in letter case only: places are kept, hashes are taken anew."""
        out = copy.copy(self)
        out.hashes = out._hashes(data)
        return out

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        heads, tails = np.empty(len(self.starts), np.uint64), np.empty(len(self.starts), np.uint64)
        carry = np.uint64(0)
        with np.errstate(over="ignore"):
            for at in range(0, len(data), _BLOCK):
                block = data[at : at + _BLOCK]
                sums = np.empty(len(block) + 1, np.uint64)
                sums[0] = carry
                np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _BYTE_POWERS.low[: len(block)], out=sums[1:])
                sums[1:] = sums[1:] * _BYTE_POWERS.high[at >> 16] + carry
                carry = sums[-1]
                low, high = np.searchsorted(self.starts, (at, at + len(block)))
                heads[low:high] = sums[self.starts[low:high] - at]
                low, high = np.searchsorted(self.ends, (at + 1, at + len(block) + 1))
                tails[low:high] = sums[self.ends[low:high] - at]
            for at in range(0, len(heads), _BLOCK):
                own = slice(at, at + _BLOCK)
                tails[own] = mix((tails[own] - heads[own]) * _BYTE_INVERSES(self.starts[own]) + (self.ends[own] - self.starts[own]).astype(np.uint64))
        return tails

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window of ``length`` words from each word on, and whether it lies in one text."""
        n = len(self.hashes)
        out, valid = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n < length:
            return out, valid
        valid[: n - length + 1] = self.docs[length - 1 :] == self.docs[: n - length + 1]
        step = max(_BLOCK, length)
        with np.errstate(over="ignore"):
            for at in range(0, n - length + 1, step):
                own = self.hashes[at : at + step + length - 1]
                places = np.arange(len(own))
                sums = np.concatenate(([np.uint64(0)], np.cumsum(own * _WORD_POWERS(places), dtype=np.uint64)))
                out[at : at + len(own) - length + 1] = mix((sums[length:] - sums[:-length]) * _WORD_INVERSES(places[: len(own) - length + 1]))
        return out, valid

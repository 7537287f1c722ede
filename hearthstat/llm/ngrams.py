"""Byte n-grams of whole texts as packed 64-bit numbers: a perfect hash, so sorted arrays of them need no keys beside."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

from hearthstat.llm import packets
from hearthstat.llm.words import mix

#: Bytes that no UTF-8 text holds: before a text's first byte, and after its last.
BEFORE, END = 0xFE, 0xFF
BLOCK_BYTES = 1 << 20


def blocks(texts: Iterable[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts in groups of some 1 MB: the n-gram of every byte and end, and how many each text has."""

    def grams(held):
        pad = bytes([BEFORE]) * (order - 1)
        data = np.frombuffer(pad + (bytes([END]) + pad).join(held) + bytes([END]), np.uint8)
        n = len(data) - order + 1
        keys = data[:n].astype(np.uint64)
        for j in range(1, order):
            keys <<= np.uint64(8)
            keys |= data[j : j + n]
        return keys[data[order - 1 :] != BEFORE], np.array([len(t) + 1 for t in held], np.int64)

    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + order
        if size >= BLOCK_BYTES:
            yield grams(held)
            held, size = [], 0
    if held:
        yield grams(held)


def count(texts: Iterable[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts, sorted, and their counts."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for own, _ in blocks(texts, order):
        distinct, number = np.unique(own, return_counts=True)
        keys.append(distinct)
        counts.append(number)
    return add_up(np.concatenate(keys), np.concatenate(counts))


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[heads], np.add.reduceat(counts, heads)


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing=0) -> np.ndarray:
    """Values of the wanted keys in sorted arrays."""
    if not len(keys):
        return np.full(len(wanted), missing, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], values.dtype.type(missing))


def sums_per_text(texts: Iterable[bytes], order: int, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each text, the sum of the values of its n-grams; all of them stand in the sorted ``keys``."""
    out = [np.zeros(0)]
    for own, sizes in blocks(texts, order):
        codes, distinct = pd.factorize(own)
        each = values[np.searchsorted(keys, distinct)].astype(np.float64)[codes]
        out.append(np.add.reduceat(each, np.cumsum(sizes) - sizes))
    return np.concatenate(out)


def by_context(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts all n-grams with the same three bytes before the last into one range, keys rising in each; and its borders."""
    part = (((mix((keys >> np.uint64(8)) & np.uint64(0xFFFFFF)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def answered(found: dict, step: int, order: np.ndarray, places: np.ndarray, dtype) -> np.ndarray:
    """Answers to a request that was sent in ``by_context`` order, in the order of the sorted keys."""
    out = np.empty(len(order), dtype)
    out[order] = packets.values_of(found, step, places, dtype)
    return out


def group_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, for each input row its key's place among them, and the sums of the values by key."""
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, which, *(np.bincount(which, weights=v, minlength=len(distinct)) for v in values)

"""Exact integer inner products by subset-sum tables (the Four-Russians way).

The dimensions go in groups of eight. For each group a table has, per anchor, the sums of all 256
subsets of its eight components. A candidate's components are written in two's complement, and bit
``b`` of the eight components of a group is one byte: the number of the subset to look up. The looked
up sums of all groups are added, and the planes are put together by shifts, the highest one negative.
"""

from __future__ import annotations

import numpy as np

#: Dimensions of a group, one bit of a byte each.
GROUP = 8


def padded(values: np.ndarray) -> np.ndarray:
    """Components filled up with zeros to whole groups."""
    return np.pad(values, ((0, 0), (0, -values.shape[1] % GROUP)))


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes (planes, groups, rows) of integer rows, as few as their components need."""
    values = padded(values.astype(np.int64))
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    made = [np.packbits((values >> b & 1).astype(np.uint8), axis=1, bitorder="little").T
            for b in range(most.bit_length() + 1)]
    return np.ascontiguousarray(made)


def components(made: np.ndarray) -> np.ndarray:
    """The integer rows of bit planes."""
    bits = np.unpackbits(np.moveaxis(made, 2, 1), axis=2, bitorder="little").astype(np.int64)
    weights = 1 << np.arange(len(made), dtype=np.int64)
    weights[-1] = -weights[-1]
    return np.tensordot(weights, bits, 1)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (groups, 256, anchors) of integer rows."""
    anchors = padded(anchors.astype(np.int64))
    groups = anchors.shape[1] // GROUP
    parts = anchors.T.reshape(groups, GROUP, len(anchors))
    out = np.zeros((groups, 1 << GROUP, len(anchors)), np.int64)
    for k in range(GROUP):
        out[:, 1 << k:2 << k] = out[:, :1 << k] + parts[:, k:k + 1]
    return out


def products(tables: np.ndarray, made: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Inner products (anchors, rows); sums that fit are made in 32 bits."""
    n, anchors = made.shape[2], tables.shape[2]
    out = np.zeros((anchors, n), np.int64)
    # Every partial result is a sum of components times less than 2 ** planes.
    reach = int(np.abs(tables).max(axis=1).sum(axis=0).max(initial=0)) << len(made) + 1
    if reach < 1 << 31:
        tables = tables.astype(np.int32)
    for start in range(0, n, rows):
        part = made[:, :, start:start + rows].astype(np.intp)
        total = np.zeros((part.shape[2], anchors), tables.dtype)
        found = np.empty_like(total)
        for b in range(len(part) - 1, -1, -1):
            total <<= 1
            for g, table in enumerate(tables):
                np.take(table, part[b, g], axis=0, out=found, mode="clip")
                if b == len(part) - 1:
                    total -= found
                else:
                    total += found
        out[:, start:start + rows] = total.T
    return out

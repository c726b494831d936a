"""Shared pieces: durable cuts of a plan, Arrow helpers, components of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..plans.durable import connected_components, cut, shared_folder, stored

__all__ = ["byte_values", "connected_components", "cut", "local_components", "shared_folder", "stored", "whole_groups"]


def byte_values(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, nulls kept, without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by the integer key columns.

    Memory: one Arrow batch and one group that spans batches.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
            same = np.ones(batch.num_rows, bool)
            for k, v in zip(keys, last, strict=True):
                same &= batch.column(k).to_numpy(zero_copy_only=False) == v
            if same.all():
                held.append(batch)
                continue
        start = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            start[1:] |= v[1:] != v[:-1]
        at = int(np.flatnonzero(start)[-1]) if start.any() else 0
        if held or at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
        held = [batch.slice(at)]
    if held:
        yield pa.Table.from_batches(held)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n nodes under edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label

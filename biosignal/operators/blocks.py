"""Bounded blocks of whole segments out of a sorted stream of Arrow batches.

A partition that is sorted by its segment keys goes through mapInPandas as many small frames. The kernels of this
package work on many segments at once, so the frames are joined up to a number of rows and cut where a segment ends.
A worker holds one block and the segment that is still open, whatever the size of the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def changes(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before it; the first row counts as a change."""
    out = np.zeros(len(frame), bool)
    out[:1] = True
    for key in keys:
        values = frame[key].to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def segmented(frames: Iterable[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of at least `rows` rows that hold whole segments."""
    held: list[pd.DataFrame] = []
    count, limit = 0, rows
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        count += len(frame)
        if count < limit:
            continue
        block = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        cut = int(np.flatnonzero(changes(block, keys))[-1])
        if cut:
            yield block.iloc[:cut].reset_index(drop=True)
            block = block.iloc[cut:].reset_index(drop=True)
        held, count = [block], len(block)
        limit = count + rows
    if count:
        yield pd.concat(held, ignore_index=True)


def map_segments(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 50_000, ranged: bool = False) -> DataFrame:
    """Bring each segment into one partition in order, and run the kernel over blocks of whole segments. ranged: partitions are
    ranges of the keys, of about equal size, so that neighbours lie together."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in segmented(frames, keys, rows):
            out = kernel(block)
            if len(out):
                yield out

    parted = df.repartitionByRange(*keys) if ranged else df.repartition(*keys)
    return parted.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)

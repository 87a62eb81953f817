"""Groups of any size as streams: rows that Spark has dealt out and sorted by key, read group by group, batch by batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def dealt(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with each group of ``keys`` in one partition and in ``order`` there, for ``groups`` to read."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator[pd.DataFrame]]]:
    """Each group's key and its rows in pieces; a piece is never longer than a batch, and keys are never null."""

    def pieces() -> Iterator[tuple[tuple, pd.DataFrame]]:
        for batch in batches:
            if not len(batch):
                continue
            changed = np.zeros(len(batch), bool)
            changed[0] = True
            for k in keys:
                values = batch[k].to_numpy()
                changed[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(changed)
            for b, e in zip(starts, [*starts[1:], len(batch)], strict=True):
                yield tuple(batch[k].iloc[b] for k in keys), batch.iloc[b:e]

    for key, group in groupby(pieces(), key=lambda piece: piece[0]):
        yield key, (rows for _, rows in group)

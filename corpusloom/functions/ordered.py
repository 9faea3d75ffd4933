"""Sequential passes over the ordered rows of each document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows of results that a task gathers before it hands them on.
ROWS_AT_ONCE = 2_000


def ordered_fold(rows: DataFrame, key: str, order: str, value: str, step: Callable[[str, list], list[tuple]], schema: str, types: dict[str, str]) -> DataFrame:
    """The rows that ``step`` makes of each key and its values in order; ``types`` are those of pandas for columns of numbers.

    One shuffle by key and one sort; the values of a key are cut from the sorted stream as a list, and those of a key that spans batches are
    held until they are whole. Results of many keys leave as one frame. A key is one document, so its rows are bounded by the document.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, held, of = [], [], None
        frame = lambda: pd.DataFrame(made, columns=names).astype(types)
        for batch in batches:
            keys, values = batch[key].to_numpy(), batch[value].tolist()
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
            for low, high in zip(starts, starts[1:]):
                if held and keys[low] != of:
                    made += step(of, held)
                    held = []
                    if len(made) >= ROWS_AT_ONCE:
                        yield frame()
                        made = []
                of = keys[low]
                held += values[low:high]
        if held:
            made += step(of, held)
        if made:
            yield frame()

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)

"""The slow way: rows as Python objects in a loop, to compare the engine with."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def execute_objects(df: DataFrame, accepts: Callable[[object], bool]) -> DataFrame:
    """The rows that a Python function of one row object accepts, called row by row."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[bool(accepts(row)) for row in frame.itertuples(index=False)]]

    return df.mapInPandas(each, df.schema)

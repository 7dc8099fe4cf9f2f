"""The surface for models as column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_model(rows: DataFrame, column: str, out: str, kind: str, load: Callable[[], Callable[[pd.Series], pd.Series]]) -> DataFrame:
    """Add ``out``: a model's value for each value of ``column``.

    ``load`` gives the model, once for each task, and the model maps a batch to a batch; ``kind`` is the type of its
    values. Nulls are handed to the model as they are.
    """

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return rows.withColumn(out, run(F.col(column)))

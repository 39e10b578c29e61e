"""Model outputs as tables: a model is a plain function of a batch.

The engine never loads a network. ``scored`` wraps a function from a pandas frame
to rows as an Arrow operator, made once per Python worker by its factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Model(Protocol):
    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def scored(images: DataFrame, factory: Callable[[], Model], schema: str) -> DataFrame:
    """Rows of ``factory()`` over batches of ``images``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in parts:
            yield model(pdf)

    return images.mapInPandas(run, schema)

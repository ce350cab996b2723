"""Model hooks as Arrow-batched UDFs. Type hints are evaluated here, so they stay real types."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def on_question(model: Callable[[str, str], str | None]):
    """A column function (question, context) -> reply."""

    @F.pandas_udf("string")
    def ask(question: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([model(q, c) for q, c in zip(question, context, strict=True)], dtype=object)

    return ask


def on_texts(model: Callable[[list[str]], list[list[float]]]):
    """A column function text -> embedding; the model sees whole batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model(batch.tolist()))

    return embed

"""Confidence values: normalisation, classes, means over tokens, spreading over text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the classes, best first; fixed values.
FOUR_CLASSES = ((0.95, "very high"), (0.85, "high"), (0.75, "medium"))
THREE_CLASSES = ((0.9, "high"), (0.75, "medium"))


def normalised(value: Column) -> Column:
    """Shares as they are, percentages divided by 100; null for negative values and nulls."""
    return F.when(value.between(0, 1), value).when(value > 1, value / 100)


def confidence_class(value: Column, classes: Sequence[tuple[float, str]] = FOUR_CLASSES, lowest: str = "low") -> Column:
    """The first class whose bound the value reaches; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in classes:
        out = out.when(value >= bound, name)
    return out.otherwise(lowest)


def token_mean(probabilities: Column, empty: float | None = None) -> Column:
    """Mean of an array of probabilities; `empty` where there are none."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(probabilities) > 0, total / F.size(probabilities)).otherwise(F.lit(empty).cast("double"))


def spread_over_text(text: Column, probabilities: Column) -> Column:
    """array<struct<part,confidence>>: the text cut into pieces of max(1, length // tokens) characters, one for each
    token; the last token takes the rest."""
    n = F.size(probabilities)
    step = F.greatest(F.lit(1), F.floor(F.length(text) / n)).cast("int")
    part = lambda i: F.when(i == n - 1, F.substring(text, i * step + 1, F.length(text))).otherwise(F.substring(text, i * step + 1, step))
    pieces = F.transform(probabilities, lambda p, i: F.struct(part(i).alias("part"), p.alias("confidence")))
    return F.filter(pieces, lambda x: x["part"] != "")

"""Evaluation helpers: bind an expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside lambdas.

    The optimizer may inline a projected column into a lambda that runs per array element; a bound
    value is a lambda variable and stays evaluated.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a generator, so that later projections and filters read values, not formulas.

    Without it the optimizer merges projections and may evaluate an expensive formula once per use.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))

"""Rule scores from true and false positive counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision(tp: Column, fp: Column) -> Column:
    """tp / (tp + fp), null when nothing is covered."""
    return F.try_divide(tp.cast("double"), (tp + fp).cast("double"))


def _positive_log(x: Column) -> Column:
    return F.ln(F.when(x > 0, x))


def information_gain(tp: Column, own: Column, parent: Column) -> Column:
    return tp.cast("double") * (_positive_log(own) - _positive_log(parent))


def maximum_gain(parent_tp: Column, parent: Column) -> Column:
    return parent_tp.cast("double") * -_positive_log(parent)


def normalised_gain(tp: Column, fp: Column, parent_tp: Column, parent_fp: Column) -> Column:
    """Gain over the best possible gain, guarded and never below zero."""
    own, parent = precision(tp, fp), precision(parent_tp, parent_fp)
    gain = F.greatest(information_gain(tp, own, parent), F.lit(0.0))
    return F.when((own == 0) | parent.isin(0.0, 1.0), F.lit(0.0)).when(
        own.isNotNull() & parent.isNotNull(),
        F.try_divide(gain, maximum_gain(parent_tp, parent)),
    )

"""Why a score moved between two runs of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions.numbers import even


def attribute(states: DataFrame, keys, order: str, score: str, causes, least: float = 0.2) -> DataFrame:
    """(keys, order, delta, cause): the first changed cause of ``causes`` (column, name), else external_noise.

    The first run of a key and moves of up to ``least`` have a null cause; a cause whose previous or
    present value is null is skipped.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    delta = even(F.col(score) - F.lag(score).over(w), 4)
    prev = {c: F.lag(c).over(w) for c, _ in causes}
    rows = states.withColumn("delta", delta).withColumns({f"_p_{c}": p for c, p in prev.items()})
    cause = F.lit("external_noise")
    for c, name in reversed(causes):
        cause = F.when(F.coalesce(F.col(c) != F.col(f"_p_{c}"), F.lit(False)), name).otherwise(cause)
    return rows.select(*keys, order, "delta", F.when(F.abs("delta") > least, cause).alias("cause"))

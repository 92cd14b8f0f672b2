"""Scoping of runs and companies over tables whose columns are only known at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_uuid(c: Column) -> Column:
    """Lower case with hyphens for 32 hex digits, else the text itself."""
    plain = F.lower(F.replace(F.trim(c), F.lit("-"), F.lit("")))
    return F.when(plain.rlike("^[0-9a-f]{32}$"), F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(F.trim(c))


def typed_eq(df: DataFrame, column: str, value: str) -> Column:
    """Equality by the column's type: numbers as numbers, the rest as text; a value that is no number equals none."""
    kind = df.schema[column].dataType.typeName()
    if kind in ("integer", "long", "short", "byte"):
        return F.coalesce(F.col(column) == F.lit(value).try_cast("long"), F.lit(False))
    return F.coalesce(F.col(column).cast("string") == F.lit(value), F.lit(False))


def choose_column(df: DataFrame, candidates: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The (column, value) with the most rows, counted in one pass; the first of equals, none where nothing fits."""
    have = [(c, v) for c, v in candidates if c in df.columns]
    if not have:
        return None
    counts = df.agg(*(F.count_if(typed_eq(df, c, v)).alias(f"n{i}") for i, (c, v) in enumerate(have))).first()
    best = max(range(len(have)), key=lambda i: (counts[i], -i))
    return have[best] if counts[best] else None


def resolve_run(runs: DataFrame, *columns: str) -> DataFrame:
    """``runs`` with run_key: the first of the columns that is there and not null, as a normal UUID."""
    have = [F.col(c).cast("string") for c in columns if c in runs.columns]
    return runs.withColumn("run_key", normal_uuid(F.coalesce(*have)))

"""Bounded samples by key hash that stay small on their way to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def under_bound(df: DataFrame, population: DataFrame, rows: int) -> DataFrame:
    """The rows of df whose 64-bit hash h lies under a bound that about a fifth more than the given number of rows pass.

    The size of the population (df, or a cheaper frame of about as many rows) sets the bound, so tasks send these rows
    alone, wherever they lie. Where many rows share a hash, fewer may pass.
    """
    n = population.count()
    wanted = 1.2 * rows + 200
    return df.where(F.col("h") < int(-(2**63) + 2**64 * (wanted / n))) if n > wanted else df


def least_hashes(df: DataFrame, population: DataFrame, rows: int, *ties: str) -> DataFrame:
    """The rows of df with the least 64-bit hashes h, at most rows of them, in order of h and ties."""
    return under_bound(df, population, rows).orderBy("h", *ties).limit(rows)

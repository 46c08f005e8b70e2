"""Costly columns, computed once per row.

A filter on a computed column is moved below the projection that makes the column, and an
inner explode adds a filter on its own input: both run the expression twice. What comes out
of an outer explode stays above it, so the filters here test that.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_known(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add the column and keep the rows where it is not null."""
    return df.withColumn(name, F.explode_outer(F.array(value))).where(F.col(name).isNotNull())


def each(df: DataFrame, keep, items: Column, position: str, item: str) -> DataFrame:
    """One row per item of the array, with its place from 0; no row for none."""
    rows = df.select(*keep, F.posexplode_outer(items).alias(position, item))
    return rows.where(F.col(position).isNotNull())

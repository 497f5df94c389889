"""Statements by primary key as DataFrame plans, and checks of what shapes state (extensions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.shapes import ShapeTable


def _match(df: DataFrame, shape: ShapeTable, key: dict[str, object]) -> Column:
    if not shape.primary_key:
        raise ValueError(f"table '{shape.name}' has no primary key")
    columns = [shape.column(k).physical or k for k in shape.primary_key]
    values = {k.upper(): v for k, v in key.items()}
    return reduce(Column.__and__, [F.col(c) == F.lit(values[k]).cast(df.schema[c].dataType) for c, k in zip(columns, shape.primary_key, strict=True)])


def select_all(df: DataFrame, shape: ShapeTable) -> DataFrame:
    return df.select(*[c.physical or c.name for c in shape.columns])


def select_by_pk(df: DataFrame, shape: ShapeTable, key: dict[str, object]) -> DataFrame:
    return select_all(df.where(_match(df, shape, key)), shape)


def insert(df: DataFrame, shape: ShapeTable, row: dict[str, object]) -> DataFrame:
    """The table with one more row; columns that are not given are null."""
    values = {k.upper(): v for k, v in row.items()}
    one = df.sparkSession.range(1).select(*[F.lit(values.get(f.name.upper())).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(one)


def update_by_pk(df: DataFrame, shape: ShapeTable, key: dict[str, object], values: dict[str, object]) -> DataFrame:
    """The table after the update; key columns never change."""
    hit, new = F.coalesce(_match(df, shape, key), F.lit(False)), {k.upper(): v for k, v in values.items() if k.upper() not in shape.primary_key}
    return df.select(*[F.when(hit, F.lit(new[f.name.upper()]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name.upper() in new else F.col(f.name) for f in df.schema])


def delete_by_pk(df: DataFrame, shape: ShapeTable, key: dict[str, object]) -> DataFrame:
    return df.where(~F.coalesce(_match(df, shape, key), F.lit(False)))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target; null references are none."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count; keys with a null are left out."""
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])
    return df.where(known).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")

"""Merging new rows into a table that has no MERGE of its own."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unique(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``source``, which fails when it is read if two of its rows share a key without nulls, as MERGE does."""
    known = [F.col(k).isNotNull() for k in keys]
    whole = known[0]
    for k in known[1:]:
        whole = whole & k
    twice = whole & (F.col("_same") > 1)
    rows = source.withColumn("_same", F.count("*").over(Window.partitionBy(*keys)))
    return rows.where(F.when(twice, F.raise_error(F.lit("several source rows have one key")).cast("boolean")).otherwise(F.lit(True))).drop("_same")


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], update: bool = True, delete_missing: bool = False) -> DataFrame:
    """Rows of ``target`` after the merge: source rows replace those of equal key and are added where there is none.

    ``update=False`` only adds; ``delete_missing`` also drops target rows whose key the source lacks. Null keys match nothing.
    Several source rows of one key are an error.
    """
    keys = list(keys)
    new = _unique(source.select(*target.columns), keys)
    if not update:
        fresh = new.join(target.select(*keys), keys, "left_anti").select(*target.columns)
        kept = target.join(new.select(*keys), keys, "left_semi") if delete_missing else target
        return kept.select(*target.columns).unionByName(fresh)
    if delete_missing:
        return new
    return target.join(new.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new)


def update_column(target: DataFrame, source: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``target`` with ``column`` from ``source`` where a row of equal key has one; several such rows are an error."""
    told = _unique(source, keys).select(*keys, F.col(column).alias("_new"))
    return target.join(told, list(keys), "left").select(*(F.coalesce("_new", column).alias(c) if c == column else F.col(c) for c in target.columns))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has; no rows if the keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def write_version(df: DataFrame, root: str) -> str:
    """Write ``df`` to a new folder under ``root``, which readers switch to afterwards; the folder read from stays whole."""
    path = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path

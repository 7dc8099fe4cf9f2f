"""Changes to tables, as plans from the old rows to the new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partial_update(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Overwrite the listed columns where a change has a value; nulls in a change leave the old value.

    ``changes`` has one row per key; keys without a row change nothing, and further columns are ignored.
    """
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else c for c in rows.columns])


def allowed_update(rows: DataFrame, key: str, value, fields: dict[str, object], allowed: Sequence[str]) -> DataFrame:
    """Set fields of the row with one key; fields that aren't allowed are refused."""
    refused = sorted(set(fields) - set(allowed))
    if refused:
        raise ValueError(f"fields that may not be changed: {', '.join(refused)}")
    hit = F.col(key) == F.lit(value)
    types = dict(rows.dtypes)
    return rows.select(*[F.when(hit, F.lit(fields[c]).cast(types[c])).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def delete_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; a condition that is null deletes nothing."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def replace_groups(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replace all rows of the keys in ``new`` by those of ``new``; missing columns become null."""
    return rows.join(new.select(key).distinct(), key, "left_anti").select(*rows.columns).unionByName(new, allowMissingColumns=True)


def remap(rows: DataFrame, mapping: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rewrite references by a table old_id -> new_id; references without an entry stay."""
    out = rows
    for c in columns:
        m = mapping.select(F.col("old_id").alias(c), F.col("new_id").alias(f"{c}__new"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce(f"{c}__new", c)).drop(f"{c}__new")
    return out.select(*rows.columns)


def merge_counts(old: DataFrame, delta: DataFrame, key: str, sums: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """Upsert by key: numbers add up, first and last times extend, lists of small sets unite."""
    both = old.select(key, *sums, *first, *last, *lists).unionByName(delta.select(key, *sums, *first, *last, *lists))
    return both.groupBy(key).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in first], *[F.max(c).alias(c) for c in last],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists],
    )


def add_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns that are missing, as nulls of the given types."""
    return rows.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in columns.items() if c not in rows.columns])


def append(rows: DataFrame, path: str) -> None:
    """Append rows to a parquet table."""
    rows.write.mode("append").parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace just the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)

"""The store's statements as functions from snapshots to snapshots.

Parquet snapshots are immutable, so an insert, update, upsert or delete is a frame that the caller writes in place of
the old one.  Deletes are anti joins, upserts a union after an anti join: none needs a full outer join or a lookup loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.text import strip
from quernstone.session import cut

DEFAULT_FOLDER = "默认"
ALL = "全部"


def folder_of(c: str = "folder") -> Column:
    return F.coalesce(F.col(c), F.lit(DEFAULT_FOLDER))


def where_all(df: DataFrame, **wanted) -> DataFrame:
    """Rows that match every argument that isn't None."""
    tests = [F.col(k) == v for k, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def latest(df: DataFrame, *keys: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def insert(df: DataFrame, new: DataFrame, id_: str, *order: str) -> DataFrame:
    """``df`` with the rows of ``new``, whose ids follow the largest one in the given order.

    Rows are range-partitioned and numbered within each partition after the counts of the partitions before it, so
    no single task sees them all."""
    parts = new.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut(parts.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    counts = numbered.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("__p", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    top = df.agg(F.coalesce(F.max(id_), F.lit(0))).first()[0]
    placed = numbered.join(F.broadcast(offsets), "__p")
    placed = placed.withColumn(id_, F.lit(top) + F.col("__before") + F.col("__i") - F.col("__first") + 1)
    return df.unionByName(placed.drop("__p", "__i", "__first", "__before"), allowMissingColumns=True)


def number_within(df: DataFrame, group: str, order: str, as_: str) -> DataFrame:
    """(group, order, as_): the place, from 0, of every row among its group's by ``order``.

    Rows are range-partitioned and numbered in each partition after the counts of the group in the partitions before it,
    so that a group that holds a third of all rows is spread like the others."""
    parts = df.select(group, order).repartitionByRange(group, order).sortWithinPartitions(group, order)
    numbered = cut(parts.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    counts = numbered.groupBy(group, "__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = numbered.join(offsets, numbered[group].eqNullSafe(offsets["__g"]) & (F.col("__p") == F.col("__q")))
    return placed.select(group, order, (F.col("__i") - F.col("__first") + F.col("__before")).alias(as_))


def insert_or_ignore(df: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the rows of ``new`` whose keys it lacks."""
    return df.unionByName(new.join(df.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def upsert(df: DataFrame, new: DataFrame, *keys: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the rows of ``new`` in place of those with the same keys; columns in ``keep`` stay as they were."""
    if keep:
        old = df.select(*keys, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(old, list(keys), "left")
        for c in keep:
            new = new.withColumn(c, F.coalesce(f"__{c}", c) if c in new.columns else F.col(f"__{c}")).drop(f"__{c}")
    return df.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*df.columns))


def replace_where(df: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``df`` without all rows of the keys in ``new``, plus ``new``."""
    return df.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def update(df: DataFrame, when: Column, **values) -> DataFrame:
    """``df`` with new values where ``when`` holds."""
    return df.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(df: DataFrame, gone: DataFrame, on: dict[str, str]) -> DataFrame:
    """``df`` without the rows whose columns match a row of ``gone`` (column of df -> column of gone)."""
    keys = gone.select(*[F.col(b).alias(a) for a, b in on.items()]).distinct()
    return df.join(keys, list(on), "left_anti")


def merge_json(old: Column, new: Column) -> Column:
    """A shallow merge of two JSON objects, the new one's keys first in force; values keep their JSON text."""
    kind = "map<string,string>"
    a, b = F.from_json(old, kind), F.from_json(new, kind)
    a = F.coalesce(a, F.create_map().cast(kind))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def dedupe_insert(df: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the rows of ``new`` whose content isn't blank and that it lacks, nulls in keys being equal."""
    new = new.where(F.length(strip(F.col("content"))) > 0).dropDuplicates(list(keys))
    same = reduce(lambda x, k: x & df[k].eqNullSafe(new[k]), keys[1:], df[keys[0]].eqNullSafe(new[keys[0]]))
    return df.unionByName(new.join(df, same, "left_anti"), allowMissingColumns=True)

"""Upserts, patches and deletes on tables that are files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after new rows are put in: where a key exists, the payload's columns are taken from the new row, the others stay.

    Keys are compared so that null equals null. Of new rows with the same key
    any one may be taken; callers make them unique before.
    """
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns), F.lit(True).alias("n_here"))
    o = old.withColumn("o_here", F.lit(True))
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"n_{k}"))
    joined = o.join(n, on, "full")
    return joined.select(*(F.when(F.col("n_here"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c) for c in old.columns))


def patched(old: DataFrame, where: Column, **values: object) -> DataFrame:
    """The table with these values in the rows of a condition; a condition of null is not met."""
    return old.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def deleted(old: DataFrame, where: Column) -> DataFrame:
    return old.where(~F.coalesce(where, F.lit(False)))


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes a table anew, also from itself.

    The new table is written beside the old one, the old one is renamed aside,
    the new one takes its place, and only then the old one is deleted. A rename
    that fails raises and the old table is put back; after a crash between the
    renames ``restored`` puts it back.
    """
    fs, path = _file_system(spark, path), path.rstrip("/")
    restored(spark, path)
    fresh, aside = f"{path}-{uuid.uuid4().hex}", f"{path}{_ASIDE}"
    df.write.parquet(fresh)
    there = fs.exists(_path(spark, path))
    if there and not fs.rename(_path(spark, path), _path(spark, aside)):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(_path(spark, fresh), _path(spark, path)):
        if there:
            fs.rename(_path(spark, aside), _path(spark, path))
        raise OSError(f"{fresh} could not take the place of {path}")
    if there and not fs.delete(_path(spark, aside), True):
        raise OSError(f"{aside} could not be deleted")


#: Ends the name of a table that is being replaced.
_ASIDE = ".replaced"


def restored(spark: SparkSession, path: str) -> bool:
    """Whether a table is there; one that a crash left moved aside is put back first."""
    fs, path = _file_system(spark, path), path.rstrip("/")
    aside, target = _path(spark, path + _ASIDE), _path(spark, path)
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        elif not fs.rename(aside, target):
            raise OSError(f"{aside} could not be put back")
    return bool(fs.exists(target))


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run_log(spark: SparkSession, name: str, counts: dict[str, DataFrame]) -> DataFrame:
    """A row a table with the number of rows that a run wrote."""
    rows = None
    for table, df in counts.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("run"), F.lit(table).alias("table"), "rows")
        rows = row if rows is None else rows.unionByName(row)
    return rows

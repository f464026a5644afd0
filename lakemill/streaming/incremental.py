"""Incremental ingest: files that have arrived since the last run are upserted into a table, once each.

The stream's checkpoint remembers which files were taken, so a run that is
started again goes on where the last one ended; the table's store remembers
which batches it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.sources.snapshots import BUCKETS, Store


def latest_rows(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: that of the largest order value; of equal ones the one whose other values come last."""
    rest = [F.desc(c) for c in batch.columns if c not in keys and c != order]
    ranked = batch.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *rest)))
    return ranked.where("rn_ = 1").drop("rn_")


def ingest_available(spark: SparkSession, source: str, schema: str, folder: str, table: str, keys: list[str], order: str, state: str, kind: str = "json", buckets: int = BUCKETS) -> int:
    """Takes all new files of a folder into a table of a store and returns the number of batches.

    The table is made with the first batch; a batch rewrites only the buckets
    that its keys fall into. The commit of a batch notes its number, so that one
    that is taken again after a crash changes nothing. Rows without a whole key
    are left out.
    """
    taken = []

    def put(batch: DataFrame, number: int) -> None:
        change = Store(spark, folder).change()
        if change.batch(f"{table} from {source}", number):
            rows = latest_rows(batch.dropna(subset=keys), keys, order)
            if table in change.store.tables():
                change.merge(table, rows)
            else:
                change.create(table, rows, keys, buckets)
            change.commit()
        taken.append(number)

    stream = spark.readStream.schema(schema).format(kind).load(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return len(taken)


def late_tolerant_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An addition of ours: counts of events by kind and window of a stream or table, late events within the watermark included."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")

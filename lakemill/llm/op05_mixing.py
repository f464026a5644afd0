"""Mixing sources to target weights as a time-varying curriculum, in DataFrame operations only.

Each source has a weight that moves in a straight line from its first to its
last value while training time runs from 0 to 1. The integral of a source's
schedule over all of the time, times a constant, is the number of words that
the mix takes of it. A document's words stand at some place in its source's
stream; the time at which the source's cumulative demand reaches that place is
the document's training position. Sorting by position in ranges gives the order
of training.

No window holds a whole source: a source's documents are dealt by a hash of
their id into buckets, sums of the buckets are accumulated over a small table,
and only a bucket is summed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakemill.llm.common import if_small, stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all words that the mix takes, and how often a source may be repeated.
SHARE, REPEATS = 1.5, 2.0
BUCKET_ROWS = 4096


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Adds target to a table of one row a source (source, source_size).

    Sources in code point order, null last, weigh as in ``weights``, repeating.
    They share ``share`` times all words by weight; none takes more than
    ``repeats`` times its size, and what is cut off is shared by weight among
    the others until none is above. The fixed point is found at once: ordered by
    limit over weight, sources are at their limit up to the first whose
    proportional part is within its limit.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    values = F.array(*[F.lit(float(w)) for w in weights])
    by_rank = sources.withColumn("weight", F.element_at(values, (rank % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("ratio"), F.col("source").isNull(), F.col("source"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        by_rank.withColumn("top", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("ratio", F.col("top") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
        .withColumn("found", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything))
    )
    return levels.select("source", "source_size", "weight", F.least(F.col("top"), F.coalesce(F.col("found.level"), F.col("level")) * F.col("weight")).alias("target"))


def demand_time(part: Column, start: Column, end: Column) -> Column:
    """The time at which a weight going from start to end has given ``part`` (0 to 1) of its integral.

    The integral up to t is start*t + (end-start)*t*t/2; t solves that for part*(start+end)/2.
    """
    wanted = part * (start + end) / 2
    root = F.sqrt(start * start + 2 * (end - start) * wanted)
    return F.when(start + root > 0, 2 * wanted / (start + root)).otherwise(part)


def mix_documents(
    documents: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: float = REPEATS,
    ramp: tuple[float, ...] = (1.5, 0.5, 1.0),
    bucket_rows: int = BUCKET_ROWS,
    keep_text: bool = False,
) -> DataFrame:
    """All input columns, of the text only if it is kept, and each document's part in the mix.

    ``ramp``: by rank, repeating, how much of its mean weight a source has at
    the start of training; at the end it has two less that, so that the integral
    is the source's target. Adds size, source_size, target, taken (words, with
    repeats) and position (0 to 1). A null text has size 0; a null source is a
    source of its own. Repeated rows are documents of their own. A document
    takes the difference of the rounded-down shares up to and before its words,
    so a source's sum is its target rounded down and nothing exceeds ``repeats``
    times its size. An empty table gives an empty table. Input columns named as
    the added ones are replaced, any others pass through.
    """
    added = ("size", "source_size", "target", "taken", "position")
    rest = [c for c in documents.columns if c not in added and (keep_text or c != "text")]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")  # the caller's columns apart from ours: no names clash
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    place = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)).alias("place")
    narrow = stored(documents.select("doc_id", "source", size, place))  # sizes are counted once; what follows reads no text
    counted = stored(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    targets = source_targets(counted, weights, share, repeats).join(counted.select(F.col("source").alias("s_"), "rows"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    ramps = F.array(*[F.lit(float(x)) for x in ramp])
    targets = stored(targets.select(
        F.col("source").alias("t_source"), "source_size", "target", F.ceil(F.col("rows") / bucket_rows).alias("buckets"), F.element_at(ramps, (rank % len(ramp) + 1).cast("int")).alias("ramp")
    ))
    small = if_small(targets)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(small, F.col("source").eqNullSafe(F.col("t_source")), "left").withColumn("bucket", F.floor(F.col("place") * F.col("buckets")))

    sums = stored(dealt(narrow).groupBy("source", "bucket").agg(F.sum("size").alias("inside")))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("base")))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = narrow.select(row, "doc_id", "source", "size", "place") if set(rest) <= {"doc_id", "source"} else documents.select(row, "doc_id", "source", size, place)
    placed = (
        dealt(rows).join(if_small(sums), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("upto", F.col("base") + F.sum("size").over(inside))
        .withColumn("share_", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    )
    upto, before = F.col("share_") * F.col("upto"), F.col("share_") * (F.col("upto") - F.col("size"))
    part = F.when(F.col("source_size") > 0, (F.col("upto") - F.col("size")) / F.col("source_size")).otherwise(F.col("place"))
    return placed.select(
        *(F.col(f"row.`{c}`").alias(c) for c in rest),
        "size",
        "source_size",
        "target",
        (F.floor(upto) - F.floor(before)).cast("long").alias("taken"),
        demand_time(part, F.col("ramp"), 2 - F.col("ramp")).alias("position"),
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """The mix sorted by position over ranges of positions."""
    return mixed.orderBy("position", "doc_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, in training order."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return in_training_order(mix_documents(documents)).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS place
  FROM {documents}),
counted AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM counted),
weighed AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
                   CASE r % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS ramp,
                   source_size * 2.0::DOUBLE AS top FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(top) OVER before, 0.0::DOUBLE)) / sum(w) OVER onwards AS level
  FROM weighed
  WINDOW before AS (ORDER BY top / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onwards AS (ORDER BY top / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
chosen AS (SELECT level FROM levels WHERE level <= top / w ORDER BY top / w, level LIMIT 1),
targets AS (SELECT source, source_size, n, ramp, least(top, coalesce((SELECT level FROM chosen), level) * w) AS target FROM levels),
running AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.ramp, s.place,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS share
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN (upto - size)::DOUBLE / source_size ELSE place END AS part FROM running)
SELECT doc_id, size, source_size, target, CAST(floor(share * upto) - floor(share * (upto - size)) AS BIGINT) AS taken,
       round(2 * part / (ramp + sqrt(ramp * ramp + 2 * (2 - 2 * ramp) * part)), 9) AS position
FROM parts
"""

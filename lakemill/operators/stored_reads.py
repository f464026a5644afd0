"""What the read side looks up again and again, stored so that a look-up reads little: postings for substring search, numbered lists for deep pages."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill.operators.people import numbered

BUCKETS = 256
#: Lengths of the pieces that texts are indexed by; a query is looked up by the longest that fits into it.
SIZES = (1, 2)
PAGE_BLOCK = 10_000
#: Of a stored list; each costs a file to write.
MOST_FOLDERS = 256


def bucket_of(gram: str, buckets: int) -> int:
    return zlib.crc32(gram.encode()) % buckets


def _pieces(text: Column, size: int) -> Column:
    n = F.char_length(text)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def write_index(rows: DataFrame, folder: str, texts: list[Column], buckets: int = BUCKETS) -> None:
    """Postings of rows by the pieces of their texts (null: none): (piece, row, texts), in folders by bucket, sorted by piece.

    Texts are compared as they are given; callers lower-case or squeeze them. A
    posting carries the row and its texts, so that a search reads nothing else.
    A piece that very many rows have lies in several files.
    """
    told = F.array_compact(F.array(*texts))
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), told.alias("texts"))
    pieces = F.flatten(F.transform("texts", lambda x: F.concat(*(_pieces(x, size) for size in SIZES))))
    postings = held.select(F.explode(F.array_distinct(pieces)).alias("piece"), "row", "texts")
    postings = postings.withColumn("bucket_", F.pmod(F.crc32(F.col("piece").cast("binary")), F.lit(buckets)).cast("int"))
    dealt = postings.repartitionByRange("bucket_", "piece", F.xxhash64("texts")).sortWithinPartitions("bucket_", "piece")
    dealt.write.option("compression", "zstd").partitionBy("bucket_").parquet(folder)


def find(spark: SparkSession, folder: str, query: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows (of ``schema``) with a text that contains the query: those in the postings of all its pieces, then compared.

    Only the buckets of the query's pieces are read, and in them only what may
    hold these pieces. An empty query finds nothing.
    """
    size = max((s for s in SIZES if s <= len(query)), default=0)
    pieces = sorted({query[i : i + size] for i in range(len(query) - size + 1)}) if size else []
    stored = spark.read.schema(f"piece string, row struct<{schema}>, texts array<string>, bucket_ int").parquet(folder)
    asked = F.lit(False)
    for b in sorted({bucket_of(p, buckets) for p in pieces}):
        asked = asked | ((F.col("bucket_") == b) & F.col("piece").isin(*(p for p in pieces if bucket_of(p, buckets) == b)))
    hits = stored.where(F.col("bucket_").isin(*{bucket_of(p, buckets) for p in pieces}) & asked) if pieces else stored.where(F.lit(False))
    hits = hits.where(F.exists("texts", lambda x: x.contains(query)))
    if len(pieces) > 1:  # a row stands once for each piece: the first of them is enough, as the comparison has been made
        hits = hits.where(F.col("piece") == pieces[0])
    return hits.select("row.*")


def write_pages(items: DataFrame, folder: str, block: int = PAGE_BLOCK) -> None:
    """The list of people in its order, each with its place, in folders of so many places, or of more where that would make more than MOST_FOLDERS; and how many people and places there are.

    So the number of files doesn't grow with the list. A folder's rows are sorted by place.
    """
    placed = numbered(items)
    n = placed.count()  # of what numbering has stored
    block = max(int(block), -(-n // MOST_FOLDERS))
    placed = placed.withColumn("block_", F.expr(f"CAST((place - 1) div {block} AS INT)"))
    placed.repartition("block_").sortWithinPartitions("block_", "place").write.option("compression", "zstd").partitionBy("block_").parquet(f"{folder}/rows")
    items.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(block).cast("long").alias("block")).write.parquet(f"{folder}/count")


def read_page(spark: SparkSession, folder: str, number: int, schema: str, size: int = 20, block: int = PAGE_BLOCK) -> DataFrame:
    """A page of a stored list with its places; the number is brought within the pages there are.

    Every page reads the folders that hold it, one or two of common size, and looks at no other. The list tells its block; ``block`` is what was asked for.
    """
    n, block = spark.read.schema("n long, block long").parquet(f"{folder}/count").first()
    at = min(max(1, number), max(1, -(-n // size)))
    low, high = (at - 1) * size + 1, min(at * size, n)
    blocks = range((low - 1) // block, (high - 1) // block + 1) if n else []
    told = f"{schema}, place long, block_ int"
    base = f"{folder}/rows"
    rows = spark.read.schema(told).option("basePath", base).parquet(*(f"{base}/block_={b}" for b in blocks)) if n else spark.createDataFrame([], told)
    return rows.where(F.col("block_").isin(*blocks) & F.col("place").between(low, high)).drop("block_")

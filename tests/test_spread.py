"""Work of a step is shared out between tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakemill.operators import claims as C
from lakemill.operators import identity as I


def test_claims_without_an_entity_are_not_one_task(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = spark.range(20_000).selectExpr(
            "concat('c', id) AS id", "concat('k', id) AS claim_key", "concat('p', id % 100) AS person_id", "'party' AS claim_type", "'v' AS claim_value", "IF(id = 7, '{\"wikidataQid\":\"Q1\"}', '{}') AS claim_json",
            "'A' AS confidence_level", "IF(id % 2 = 0, 'rejected', 'pending') AS review_status", "'private' AS visibility", "false AS is_public", "id AS updated_at",
        )
        out = C.keep_review_state(rows.withColumn("review_status", F.lit("pending")), rows)
        assert out.where("review_status = 'rejected'").count() == 10_000
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 10_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_classes_of_one_name_are_not_one_task(spark):
    n = 6_000
    rows = spark.range(n).selectExpr(
        "concat('p', lpad(id, 7, '0')) AS class_id", "'ann' AS n_name", "1L AS n", "'male' AS gender", "false AS has_birth", "concat('d', id % 50) AS district", "concat('o', id) AS position", "concat('b', id % 70) AS party",
        "CAST(array() AS array<string>) AS external_ids", "CAST(array() AS array<string>) AS birth_dates", "array('r') AS candidate_regions",
    )
    sizes = [r["n"] for r in I.class_links(rows).groupBy(F.spark_partition_id()).agg(F.sum("pairs").alias("n")).collect()]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) < sum(sizes) / 3

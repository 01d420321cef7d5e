"""Queries of the general data operations and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftara.operators.redelivery import keep_first, surplus_copies
from siftara.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surplus copies in deliveries."""
    return surplus_copies(table(spark, folder, "deliveries"))


def p5_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Exactly one copy of every message."""
    return keep_first(table(spark, folder, "deliveries")).select("delivery_id", "round_id", "status", "received_at")


def p5_round_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors per round counted once a message, beside the round's own counter."""
    kept = keep_first(table(spark, folder, "deliveries").select("delivery_id", "run_id", "received_at", "round_id", "status"))
    counted = kept.groupBy("round_id").agg(F.count("*").alias("messages"), F.count_if(F.col("status") == "error").alias("errors_counted"))
    stats = table(spark, folder, "run_stats").select("round_id", F.col("errors").alias("errors_stated"))
    return stats.join(counted, "round_id", "left").select("round_id", "messages", "errors_counted", "errors_stated", (F.col("errors_counted") == F.col("errors_stated")).alias("agrees"))


_KEY = "nullif(trim(lower(run_id), ' ' || chr(9) || chr(10) || chr(13)), '')"
_RANKED = f"select *, row_number() over (partition by {_KEY} order by received_at nulls last, delivery_id) as copy, {_KEY} as message from deliveries"

QUERIES = {"p5_found": p5_found, "p5_kept": p5_kept, "p5_round_errors": p5_round_errors}
SQL = {
    "p5_found": f"select delivery_id from ({_RANKED}) where message is not null and copy > 1",
    "p5_kept": f"select delivery_id, round_id, status, received_at from ({_RANKED}) where message is null or copy = 1",
    "p5_round_errors": f"""
        with kept as (select * from ({_RANKED}) where message is null or copy = 1),
        counted as (select round_id, count(*) as messages, count(*) filter (where status = 'error') as errors_counted from kept group by round_id)
        select s.round_id, messages, errors_counted, s.errors as errors_stated, errors_counted = s.errors as agrees
        from run_stats s left join counted c on s.round_id = c.round_id""",
}

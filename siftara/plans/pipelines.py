"""Queries that write, seal, stream and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftara.plans.registry import Registry
from siftara.sources import policy, sealed
from siftara.storage import new_path
from siftara.streaming import events as E
from siftara.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


_DENIED = " or ".join(f"coalesce(regexp_matches({c}, '(?i){p}'), false)" for p in policy.DENIED for c in ("source_key", "hf_id"))


@R.add(f"""select source_key, case when regexp_matches(license, '{policy.FORBIDDEN}') then 'deny'
    when lower(license) in ('mit', 'apache-2.0', 'bsd-2-clause', 'bsd-3-clause', 'cc0-1.0', 'cc-by-3.0', 'cc-by-4.0') then 'allow' else 'review' end as status from sources""")
def source_policy(spark: SparkSession, folder: str) -> DataFrame:
    """What each source's licence allows."""
    return table(spark, folder, "sources").select("source_key", policy.licence_status(F.col("license")).alias("status"))


@R.add(f"""with named as (select *, row_number() over (order by source_key) % 4 as k from sources),
    spoilt as (select case when k = 1 then source_key || '/gpqa_main' else source_key end as source_key, hf_id, license, decision, case when k = 2 then ' ' else evidence end as evidence, case when k = 3 then 'other' else role end as role from named),
    d as (select *, {_DENIED} or coalesce(regexp_matches(license, '{policy.FORBIDDEN}'), false) as denied from spoilt)
    select source_key, concat_ws(',', case when coalesce(decision, '') not in ('allow', 'review', 'deny') then 'decision' end, case when coalesce(role, '') not in ('train', 'heldout') then 'role' end, case when denied and decision <> 'deny' then 'denied' end,
        case when decision = 'allow' and lower(license) not in ('mit', 'apache-2.0', 'bsd-2-clause', 'bsd-3-clause', 'cc0-1.0', 'cc-by-3.0', 'cc-by-4.0') then 'licence' end, case when decision = 'allow' and trim(coalesce(evidence, '')) = '' then 'evidence' end) as problems from d""")
def registry_problems(spark: SparkSession, folder: str) -> DataFrame:
    """What breaks the policy in a registry whose rows were spoilt in known ways: denied names, empty evidence, other roles."""
    k = F.row_number().over(Window.orderBy("source_key")) % 4  # a registry is a short list
    s = table(spark, folder, "sources").withColumn("k", k)
    key, evidence, role = F.when(F.col("k") == 1, F.concat("source_key", F.lit("/gpqa_main"))).otherwise(F.col("source_key")), F.when(F.col("k") == 2, " ").otherwise(F.col("evidence")), F.when(F.col("k") == 3, "other").otherwise(F.col("role"))
    s = s.select(key.alias("source_key"), "hf_id", "license", "decision", evidence.alias("evidence"), role.alias("role"))
    return s.select("source_key", F.array_join(policy.policy_problems(*[F.col(c) for c in ("source_key", "hf_id", "license", "decision", "evidence", "role")]), ",").alias("problems"))


@R.add("select split, count(*) as n, count(distinct case_key) as keys from cases group by split")
def sealed_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Records written to a sealed folder and read back through its manifest."""
    path = new_path(spark, "sealed")
    sealed.write_sealed(table(spark, folder, "cases").select("case_id", "case_key", "split"), path, tool="round-trip", rows_per_file=50_000)
    return sealed.read_sealed(spark, path).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("case_key").alias("keys"))


@R.add("select event_type, date_trunc('hour', ts) as start, count(*) as n from events group by 1, 2")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events per hour and kind through a stream."""
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    counted = E.tumbling_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", late="2 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))
    path = new_path(spark, "windows")
    # windows leave the state and are written once they are complete; what is still open at the end of the input is counted from it
    counted.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(spark, "checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema(counted.schema).parquet(path)
    start = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    rest = table(spark, folder, "events").groupBy("event_type", start.alias("start")).agg(F.count("*").alias("n"))
    return closed.select("start", "event_type", "n").unionByName(rest.join(closed.select("event_type", "start"), ["event_type", "start"], "left_anti").select("start", "event_type", "n"))


@R.add("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def stream_last_state(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of every user, folded batch by batch from a stream."""
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).select("user_id", "ts", "event_id")
    path = new_path(spark, "last")
    E.keep_last(stream, path, ["user_id"], ["ts", "event_id"], new_path(spark, "checkpoint")).awaitTermination()
    return E.latest(spark, path).select("user_id", "event_id")

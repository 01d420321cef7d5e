"""Results of a run against its requests: option tables, payload states, complete groups and shares of what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftara.functions.hashing import digest

ANSWERS = "map<string,struct<type:string,choice:string,noul:double,probabilities:map<string,double>>>"


def option_table(results: DataFrame, keys: Sequence[str], response: str) -> DataFrame:
    """keys, question, type, option and probability of every answered question; a yes/no answer gives its two options. Responses that are no JSON or have no answers give no rows."""
    answers = F.from_json(F.get_json_object(response, "$.answers"), ANSWERS)
    rows = results.select(*keys, F.explode(answers).alias("question", "a"))
    yes_no = F.when(F.col("a.noul").isNotNull(), F.create_map(F.lit("false"), 1 - F.col("a.noul"), F.lit("true"), F.col("a.noul")))
    options = F.coalesce(F.col("a.probabilities"), yes_no)
    return rows.select(*keys, "question", F.col("a.type").alias("type"), F.explode(options).alias("option", "probability"))


def payload_states(ours: DataFrame, theirs: DataFrame, key: str, payload: str) -> DataFrame:
    """key and state of every key of either side: same, different, unknown (a payload is null), ours_only or theirs_only. Each side must hold a key once."""
    a = ours.select(key, F.col(payload).alias("_a"), F.lit(True).alias("_ours"))
    b = theirs.select(key, F.col(payload).alias("_b"), F.lit(True).alias("_theirs"))
    state = F.when(F.col("_theirs").isNull(), "ours_only").when(F.col("_ours").isNull(), "theirs_only").when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown").when(F.col("_a") == F.col("_b"), "same").otherwise("different")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def answer_states(requests: DataFrame, answers: DataFrame, key: str, option: str, probability: str, *, tolerance: float = 1e-3) -> DataFrame:
    """key and state of every request: missing, bad (the probabilities of one question do not sum to 1), or ok."""
    sums = answers.groupBy(key, "question").agg(F.sum(probability).alias("_sum"))
    per = sums.groupBy(key).agg(F.bool_and(F.abs(F.col("_sum") - 1) <= tolerance).alias("_good"))
    return requests.select(key).distinct().join(per, key, "left").select(key, F.when(F.col("_good").isNull(), "missing").when(F.col("_good"), "ok").otherwise("bad").alias("state"))


def complete_groups(rows: DataFrame, group: str, good: Column) -> DataFrame:
    """Groups whose every row is good (a null is not), with their rows."""
    n = rows.groupBy(group).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_all"), F.count("*").alias("n"))
    return n.where("_all").select(group, "n")


def epoch_slices(rows: DataFrame, key: str, size: int, seed: str, epoch: int) -> DataFrame:
    """key and slice: the rows of an epoch cut into slices of about ``size`` by ranges of their digest, without ordering all rows in one task."""
    n = max(1, -(-rows.count() // size))
    turn = F.conv(F.substring(digest(seed, str(epoch), F.col(key)), 1, 8), 16, 10).cast("double") / float(16**8)
    return rows.select(key, F.floor(turn * n).alias("slice"))


def pending(inputs: DataFrame, markers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs without a marker of the same name, input digest and fingerprint: what a resumed run has left to do. Null keys are always left."""
    return inputs.join(markers.select(*keys).distinct(), list(keys), "left_anti")

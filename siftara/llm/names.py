"""Source and language names as the registry means them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_name(name: Column) -> Column:
    """Without letter case and outer blanks, and with one sign for - _ . and blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(name)), "[-_. ]", "-"), F.lit(""))


def plain_lang(lang: Column) -> Column:
    """The primary language tag in small letters; null where none is named."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]+)", 1), F.lit(""))


def registry_names(sources: DataFrame, *columns: str) -> DataFrame:
    """One row for each name of a source (source_key or hf_id): name, source_key and the given columns. Where two sources share a name the first key has it."""
    names = sources.where("source_key is not null").select(F.explode(F.array_distinct(F.array(plain_name(F.col("source_key")), plain_name(F.col("hf_id"))))).alias("plain"), F.struct("source_key", *columns).alias("source_row")).where("plain is not null")
    return names.groupBy("plain").agg(F.min("source_row").alias("source_row")).select("plain", "source_row.*")


"""Readers of raw sources and logs, each giving a DataFrame."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftara.sources.sealed import read_sealed
from siftara.storage import file_system


class ReadQualityError(RuntimeError):
    """A source of which too little could be read."""


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None, *, partitions: int | None = None) -> DataFrame:
    """JSON lines, plain or gzip. Blank lines are no rows. A gzip file is one task; ``partitions`` spreads its rows."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.json(list(path) if not isinstance(path, str) else path)
    return df.repartition(partitions) if partitions else df


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log that is still written: lines that are no whole JSON object, as a last line cut off, are left out."""
    parsed = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", schema).alias("r"), "value")
    return parsed.where(F.col("value").rlike(r"\}\s*$") & F.col("r").isNotNull() & F.json_object_keys("value").isNotNull()).select("r.*")


def require_digest(spark: SparkSession, path: str, sha256: str) -> None:
    """An error where the file is not the one with this digest."""
    held = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    if held is None or held[0] != sha256.lower():
        raise ReadQualityError(f"{path}: not the file that was asked for")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, *, sha256: str | None = None) -> DataFrame:
    """CSV with a header; with ``sha256`` only the file of that digest is read."""
    if sha256:
        require_digest(spark, path, sha256)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def pick_files(files: DataFrame, path: str, *, config: str | None = None, split: str | None = None) -> DataFrame:
    """Parquet paths of a listing whose folders or file name name the configuration and the split."""
    p = F.col(path)
    kept = files.where(F.endswith(p, F.lit(".parquet")))
    if config:
        kept = kept.where(F.array_contains(F.split(p, "/"), config))
    if split:
        kept = kept.where(p.rlike(rf"(?:^|/){split}(?:[-./_]|$)"))
    return kept


def any_id(df: DataFrame, names: Sequence[str] = ("example_id", "request_id", "run_id", "id")) -> Column:
    """The first of the id columns that the table has and the row fills."""
    held = [F.col(n).cast("string") for n in names if n in df.columns]
    if not held:
        raise ValueError(f"none of {list(names)} is a column")
    return F.coalesce(*held)


def reference_requests(rows: DataFrame, value: str = "value") -> DataFrame:
    """id and request of reference rows (JSON texts): state and questions at the top, or under ``request`` as object or as text; null where a row has neither."""
    text = F.col(value)
    wrapped = F.get_json_object(text, "$.request")
    inner = F.coalesce(wrapped, F.lit("{}"))

    def request(t: Column) -> Column:
        questions = F.get_json_object(t, "$.questions")
        state = F.coalesce(F.get_json_object(t, "$.state"), F.lit(""))
        return F.when(F.json_object_keys(questions).isNotNull(), F.to_json(F.struct(state.alias("state"), F.from_json(questions, "map<string,struct<type:string,instructions:string,criteria:string>>").alias("questions"))))

    return rows.select(F.get_json_object(text, "$.id").alias("id"), F.coalesce(request(text), request(inner)).alias("request"))


def require_readable(df: DataFrame, column: str, *, most: float = 0.01) -> DataFrame:
    """``df``, or an error where it is empty or more than ``most`` of its rows have no ``column``."""
    n, bad = df.agg(F.count("*"), F.count_if(F.col(column).isNull())).first()
    if n == 0 or n == bad or bad > most * n:
        raise ReadQualityError(f"{bad} of {n} rows have no {column}")
    return df


def board_models(spark: SparkSession, path: str, score: str = "v") -> DataFrame:
    """engine, name and value of the models of a board file whose value is a number."""
    m = spark.read.option("multiLine", True).json(path).select(F.explode("models").alias("m"))
    return m.select("m.engine", "m.name", F.col(f"m.{score}").try_cast("double").alias("value")).where("value is not null")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and name of a checksum list."""
    line = F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+)$", 1)
    return spark.read.text(path).select(F.lower(line).alias("sha256"), F.regexp_extract("value", r"^[0-9a-fA-F]{64}\s+\*?(.+)$", 1).alias("name")).where("sha256 <> ''")


#: Columns of corpus rows, teacher labels and reasoning traces.
CORPUS = "example_id string, source string, license string, split string, lang string, request string, gold string"
LABELS = "example_id string, question_id string, teacher string, codes array<string>, probs array<float>, temperature double"
TRACES = "example_id string, thinker string, reasoning string, tokens int, finish_reason string, request_sha256 string"


def read_typed(spark: SparkSession, folder: str, schema: str, *, required: bool = True) -> DataFrame:
    """A sealed folder as rows of one of the fixed kinds: the columns by name and type; a column that is not there is an error."""
    held = read_sealed(spark, folder, required=required)
    wanted = spark.createDataFrame([], schema).schema
    missing = [f.name for f in wanted if f.name not in held.columns]
    if missing:
        raise ReadQualityError(f"{folder}: no columns {missing}")
    return held.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file or folder by what it is called: .parquet, .csv, .jsonl, .jsonl.gz or .json."""
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if name.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, schema)
    if name.endswith((".jsonl", ".jsonl.gz", ".json")):
        return read_jsonl(spark, path, schema)
    raise ValueError(f"{path}: not a kind of file that is read")


def read_tree(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All parquet and JSON-lines files under a folder, however deep, as rows of one schema with the file they are from. Files of other kinds are left out."""
    deep = spark.read.schema(schema).option("recursiveFileLookup", True)
    parts = [deep.option("pathGlobFilter", "*.parquet").parquet(folder), deep.option("pathGlobFilter", "*.jsonl").json(folder), deep.option("pathGlobFilter", "*.jsonl.gz").json(folder)]
    return reduce(DataFrame.unionByName, [p.withColumn("file", F.col("_metadata.file_path")) for p in parts])


def read_wanted(spark: SparkSession, path: str, schema: str, id_pattern: str, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of a log whose id is wanted: the id is taken from the raw line by a pattern and looked up before any line is parsed."""
    raw = spark.read.text(path).select("value", F.regexp_extract("value", id_pattern, 1).alias("_id"))
    kept = raw.join(wanted.select(F.col(key).cast("string").alias("_id")).distinct(), "_id", "left_semi")
    return kept.select(F.from_json("value", schema).alias("r")).select("r.*").where(F.col(key).isNotNull())


def slim(results: DataFrame, wanted: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The key and some columns of the results that are wanted; the scan reads no others."""
    return results.select(key, *columns).join(wanted.select(key).distinct(), key, "left_semi")


def check_sums(spark: SparkSession, listing: str, folder: str) -> DataFrame:
    """name and state of every file that a checksum list or the folder has: same, changed, missing or unlisted."""
    listed = checksums(spark, listing).select(F.element_at(F.split("name", "/"), -1).alias("name"), F.col("sha256").alias("_want"))
    held = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("_have"))
    state = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unlisted").when(F.col("_have") == F.col("_want"), "same").otherwise("changed")
    return listed.join(held, "name", "full_outer").select("name", state.alias("state"))


def task_rows(spark: SparkSession, folder: str) -> DataFrame:
    """task, files and digest of every folder of tasks: its files under it and the digest of their names and contents. Two tasks with the same contents have the same digest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    fs, p = file_system(spark, folder)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    inside = F.split(F.substring("path", F.locate(base, F.col("path")) + len(base), F.length("path")), "/")
    named = files.select(F.get(inside, F.lit(0)).alias("task"), F.array_join(F.slice(inside, 2, 1000), "/").alias("name"), F.sha2("content", 256).alias("sha")).where("name <> ''")
    return named.groupBy("task").agg(F.count("*").alias("files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha"))), lambda x: F.concat(x["name"], F.lit(" "), x["sha"])), "\n"), 256).alias("digest"))  # a task is a small folder


def registry(spark: SparkSession, entries: Mapping[str, Mapping[str, object]], overlay: Mapping[str, Mapping[str, object]] | None = None) -> DataFrame:
    """Source entries as rows of key, field and value (JSON text), with fields of an overlay over those of the same key; a key that only the overlay has is an error."""
    stray = sorted(set(overlay or {}) - set(entries))
    if stray:
        raise ValueError(f"not in the registry: {stray}")
    merged = {k: {**v, **(overlay or {}).get(k, {})} for k, v in entries.items()}
    return spark.createDataFrame([(k, f, json.dumps(x, sort_keys=True, ensure_ascii=False)) for k, v in sorted(merged.items()) for f, x in sorted(v.items())], "key string, field string, value string")


def describe(df: DataFrame) -> DataFrame:
    """column, type and nullability of a table."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "column string, type string, nullable boolean")

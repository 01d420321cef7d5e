"""Sinks: folders that never overlap their inputs, split results with a report, packs with a content digest, logs that grow, tables for people."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftara.sources.sealed import SealError, stale_parts, write_sealed
from siftara.storage import file_system


def require_apart(spark: SparkSession, out: str, inputs: Sequence[str]) -> None:
    """An error where the output is an input, lies in one or holds one, so that nothing is read while it is written over."""

    def place(path: str) -> str:
        fs, p = file_system(spark, path)
        return fs.makeQualified(p).toString().rstrip("/") + "/"

    a = place(out)
    for path in inputs:
        b = place(path)
        if a.startswith(b) or b.startswith(a):
            raise SealError(f"{out} overlaps {path}")


def prune(spark: SparkSession, folder: str, keep: Sequence[str]) -> list[str]:
    """Remove the parts that an earlier manifest of the folder lists and ``keep`` does not; other files are left alone. Names what is gone."""
    gone = []
    for name in stale_parts(spark, folder, list(keep)):
        fs, p = file_system(spark, f"{folder}/{name}")
        if fs.delete(p, False):
            gone.append(name)
    return gone


def write_split(clean: DataFrame, rejected: DataFrame, folder: str, *, tool: str, reason: str, source: str, inputs: Sequence[str] = ()) -> dict:
    """Write clean rows to a sealed folder and rejected ones as JSON lines beside it; returns rows_out, rejected and their counts by reason and by source."""
    spark = clean.sparkSession
    require_apart(spark, folder, inputs)
    rejected.write.mode("overwrite").json(f"{folder}/rejected")
    held = spark.read.schema(rejected.schema).json(f"{folder}/rejected")
    manifest = write_sealed(clean, f"{folder}/clean", tool=tool)
    count = lambda c: {r[c]: r["n"] for r in held.groupBy(c).agg(F.count("*").alias("n")).orderBy(c).collect()}  # noqa: E731  one row a reason or source
    return {"rows_out": manifest["rows"], "rejected": held.count(), "reasons": count(reason), "by_source": count(source)}


def content_digest(rows: DataFrame, order: str) -> str:
    """Digest of the rows in the order of a column (unique), the same for any partitioning: of the digests of its ranges, each of the digests of its rows. At most 256 ranges come to the driver."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    turned = rows.select(F.substring(F.sha2(F.col(order).cast("string"), 256), 1, 2).alias("range"), F.col(order).alias("at"), row.alias("row"))
    # within a range digests are added up, not listed, so that none grows with the rows: sums of four words of the digest with its place hashed in
    words = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("at").cast("string"), "row"), 256), 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    parts = turned.groupBy("range").agg(F.count("*").alias("n"), *[w.alias(f"w{k}") for k, w in enumerate(words)]).orderBy("range").collect()
    return hashlib.sha256("\n".join(" ".join(map(str, r)) for r in parts).encode()).hexdigest()


def write_pack(rows: DataFrame, path: str, order: str, *, files: int = 1) -> tuple[int, str]:
    """Write rows as gzip JSON lines in the order of a column, in files that follow each other; returns their number and content digest. The same rows give the same bytes."""
    ordered = rows.repartitionByRange(files, order).sortWithinPartitions(order)
    ordered.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
    return rows.count(), content_digest(rows, order)


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to a log folder of JSON lines; each append is whole or not there."""
    rows.write.mode("append").json(path)


def markdown(df: DataFrame, rows: int = 100) -> str:
    """The first rows of a table for people: a report holds few."""
    held = df.limit(rows).collect()
    cell = lambda v: "" if v is None else (f"{v:.4g}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in held)])


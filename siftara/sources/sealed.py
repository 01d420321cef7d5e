"""Sealed folders: parquet parts with a manifest that lists them. Only listed parts are data.

Files are read through Spark, so the same code works on any file system that Spark reaches.
"""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftara.storage import child, file_system

MANIFEST = "manifest.json"


class SealError(RuntimeError):
    """A sealed folder that is not what its manifest says, or that belongs to someone else."""


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(b & 0xFF for b in spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the place and rename, so that a reader sees the old file or the new one."""
    fs, p = file_system(spark, path)
    tmp = child(spark, p.getParent(), p.getName() + ".new")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise SealError(f"{path}: could not be put in place")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """name and sha256 of the parquet files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def seal(spark: SparkSession, folder: str, *, tool: str, sources: dict | None = None) -> dict:
    """List the parts of a folder with their rows and digests in its manifest. Refused where another tool's manifest stands."""
    own = _read_text(spark, f"{folder}/{MANIFEST}")
    if own and json.loads(own).get("tool") != tool:
        raise SealError(f"{folder}: sealed by {json.loads(own).get('tool')!r}")
    rows = {r["name"]: r["n"] for r in spark.read.parquet(folder).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name")).agg(F.count("*").alias("n")).collect()}
    parts = [{"name": r["name"], "rows": rows.get(r["name"], 0), "sha256": r["sha256"]} for r in digests(spark, folder).orderBy("name").collect()]
    manifest = {"schema_version": 1, "tool": tool, "rows": sum(p["rows"] for p in parts), "parts": parts, "sources": sources or {}}
    _write_text(spark, f"{folder}/{MANIFEST}", json.dumps(manifest, sort_keys=True, indent=1))
    return manifest


def write_sealed(df: DataFrame, folder: str, *, tool: str, rows_per_file: int = 1_000_000, sources: dict | None = None) -> dict:
    """Write zstd parts of at most ``rows_per_file`` rows and seal them. A folder that another tool sealed is refused before anything is written."""
    spark = df.sparkSession
    own = _read_text(spark, f"{folder}/{MANIFEST}")
    if own and json.loads(own).get("tool") != tool:
        raise SealError(f"{folder}: sealed by {json.loads(own).get('tool')!r}")
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(folder)
    return seal(spark, folder, tool=tool, sources=sources)


def read_sealed(spark: SparkSession, folder: str, *, verify: bool = True, required: bool = True) -> DataFrame:
    """The listed parts of a sealed folder; other files in it are no data. ``verify`` compares every digest first."""
    text = _read_text(spark, f"{folder}/{MANIFEST}")
    if text is None:
        if required:
            raise SealError(f"{folder}: no manifest")
        return spark.read.parquet(folder)
    manifest = json.loads(text)
    parts = manifest.get("parts") or ([manifest["file"]] if "file" in manifest else [])
    for p in parts:
        name = p["name"]
        if posixpath.isabs(name) or ".." in name.split("/") or "\\" in name:
            raise SealError(f"{folder}: {name!r} leaves the folder")
    if not parts:
        raise SealError(f"{folder}: no parts")
    paths = [f"{folder}/{p['name']}" for p in parts]
    if verify:
        held = {r["name"]: r["sha256"] for r in digests(spark, folder).collect()}
        wrong = [p["name"] for p in parts if held.get(posixpath.basename(p["name"])) != p["sha256"]]
        if wrong:
            raise SealError(f"{folder}: {wrong[:3]} missing or changed")
    return spark.read.parquet(*paths)


def stale_parts(spark: SparkSession, folder: str, keep: list[str]) -> list[str]:
    """Parts that an earlier manifest of the folder lists and ``keep`` does not: the only files that may be removed."""
    text = _read_text(spark, f"{folder}/{MANIFEST}")
    return sorted({p["name"] for p in json.loads(text)["parts"]} - set(keep)) if text else []

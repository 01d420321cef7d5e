import gzip
import json

import pytest
from pyspark.sql import functions as F

from siftara.sources import readers, sealed
from siftara.streaming import events as E


def test_sealed_folder(spark, tmp_path):
    folder = str(tmp_path / "data")
    manifest = sealed.write_sealed(spark.range(25).repartition(1), folder, tool="t", rows_per_file=10)
    assert manifest["rows"] == 25 and [p["rows"] for p in manifest["parts"]] == [10, 10, 5]
    spark.range(100, 105).write.mode("append").parquet(folder)  # not listed: no data
    assert sealed.read_sealed(spark, folder).count() == 25
    with pytest.raises(sealed.SealError, match="sealed by"):
        sealed.write_sealed(spark.range(3), folder, tool="other")
    assert sealed.stale_parts(spark, folder, [manifest["parts"][0]["name"]]) == sorted(p["name"] for p in manifest["parts"][1:])
    path = tmp_path / "data/manifest.json"
    m = json.loads(path.read_text())
    (tmp_path / "data/.manifest.json.crc").unlink(missing_ok=True)
    m["parts"][0]["sha256"] = "0" * 64
    path.write_text(json.dumps(m))
    with pytest.raises(sealed.SealError, match="missing or changed"):
        sealed.read_sealed(spark, folder)
    m["parts"][0]["name"] = "../x.parquet"
    path.write_text(json.dumps(m))
    with pytest.raises(sealed.SealError, match="leaves the folder"):
        sealed.read_sealed(spark, folder)
    with pytest.raises(sealed.SealError, match="no manifest"):
        sealed.read_sealed(spark, str(tmp_path / "none"))


def test_readers(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"id": 1}\n\n{"id": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "id long", partitions=2).count() == 2
    (tmp_path / "log.jsonl").write_text('{"id": 1}\n{"id": 2}\n{"id": 3, "x": "cut')
    assert sorted(r["id"] for r in readers.read_log(spark, str(tmp_path / "log.jsonl"), "id long, x string").collect()) == [1, 2]
    (tmp_path / "a.csv").write_text('k,v\n1,"x, y"\n')
    assert tuple(readers.read_csv(spark, str(tmp_path / "a.csv"), "k int, v string").first()) == (1, "x, y")
    (tmp_path / "sums").write_text("A" * 64 + "  x.bin\nnoise\n")
    assert [tuple(r) for r in readers.checksums(spark, str(tmp_path / "sums")).collect()] == [("a" * 64, "x.bin")]
    (tmp_path / "board.json").write_text(json.dumps({"models": [{"engine": "a", "name": "A", "v": 1.5}, {"engine": "b", "name": "B", "v": None}]}))
    assert [r["engine"] for r in readers.board_models(spark, str(tmp_path / "board.json")).collect()] == ["a"]


def test_reference_requests(spark):
    q = {"q1": {"type": "noul", "instructions": "?"}}
    rows = [json.dumps({"id": 1, "state": "s", "questions": q}), json.dumps({"id": 2, "request": {"state": "s", "questions": q}}), json.dumps({"id": 3, "request": json.dumps({"state": "s", "questions": q})}), json.dumps({"id": 4}), "broken"]
    got = readers.reference_requests(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [r["request"] is not None for r in got] == [True, True, True, False, False] and len({r["request"] for r in got[:3]}) == 1
    df = spark.createDataFrame([(None,), ("x",)], "r string")
    with pytest.raises(readers.ReadQualityError):
        readers.require_readable(df, "r")
    with pytest.raises(readers.ReadQualityError):
        readers.require_readable(df.limit(0), "r")


def test_pick_files(spark):
    df = spark.createDataFrame([("a/en/train-0.parquet",), ("a/en/test-0.parquet",), ("a/pt/train-0.parquet",), ("a/en/train.json",)], "p string")
    assert [r[0] for r in readers.pick_files(df, "p", config="en", split="train").collect()] == ["a/en/train-0.parquet"]


def test_streams(spark, tmp_path):
    schema = "run_id string, received_at timestamp, v int"
    for k, rows in enumerate([[("a", "2026-01-01", 1), (None, "2026-01-01", 2)], [(" A", "2026-01-02", 3), (None, "2026-01-02", 4), ("b", "2026-01-02", 5)]]):
        spark.createDataFrame(rows, "run_id string, t string, v int").select("run_id", F.to_timestamp("t").alias("received_at"), "v").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = E.read_stream(spark, str(tmp_path / "in/*"), schema, files_per_batch=1)
    E.drop_redelivered(stream, "run_id", "received_at").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert len(got) == 4 and {2, 4, 5} <= set(got)
    E.keep_last(E.read_stream(spark, str(tmp_path / "in/*"), schema, files_per_batch=1).where("run_id is not null"), str(tmp_path / "last"), ["run_id"], ["received_at"], str(tmp_path / "c2")).awaitTermination()
    assert sorted(r["v"] for r in E.latest(spark, str(tmp_path / "last")).collect()) == [1, 3, 5]

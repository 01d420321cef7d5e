import gzip
import json

import pytest
from pyspark.sql import functions as F

from siftara.functions import distributions as D
from siftara.functions import statistics as S
from siftara.operators import labels
from siftara.sources import readers, sealed, sinks


def test_output_is_apart_from_its_input(spark, tmp_path):
    sinks.require_apart(spark, str(tmp_path / "out"), [str(tmp_path / "in"), str(tmp_path / "out2")])
    for bad in ("in", "in/deeper", "."):
        with pytest.raises(sealed.SealError, match="overlaps"):
            sinks.require_apart(spark, str(tmp_path / bad), [str(tmp_path / "in")])


def test_split_results_and_pruning(spark, tmp_path):
    rows = spark.createDataFrame([(i, "s" if i % 2 else "t", "short" if i % 4 else "long") for i in range(20)], "id long, source string, reason string")
    report = sinks.write_split(rows.where("id < 12").drop("reason"), rows.where("id >= 12"), str(tmp_path / "o"), tool="t", reason="reason", source="source")
    assert report == {"rows_out": 12, "rejected": 8, "reasons": {"long": 2, "short": 6}, "by_source": {"s": 4, "t": 4}}
    folder = str(tmp_path / "o/clean")
    assert sealed.read_sealed(spark, folder).count() == 12
    (tmp_path / "o/clean/notes.txt").write_text("mine")
    names = [p["name"] for p in json.loads((tmp_path / "o/clean/manifest.json").read_text())["parts"]]
    assert sinks.prune(spark, folder, names[1:]) == names[:1] and (tmp_path / "o/clean/notes.txt").exists() and not (tmp_path / "o/clean" / names[0]).exists()


def test_packs_and_logs(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", None) for i in range(50)], "id long, t string, n string")
    n, digest = sinks.write_pack(rows.repartition(7), str(tmp_path / "a"), "id")
    assert (n, digest) == sinks.write_pack(rows.repartition(3), str(tmp_path / "b"), "id")
    files = [sorted((tmp_path / x).glob("*.gz")) for x in "ab"]
    assert [f.read_bytes() for f in files[0]] == [f.read_bytes() for f in files[1]]
    assert [json.loads(x)["id"] for x in gzip.open(files[0][0], "rt")] == list(range(50))
    assert sinks.content_digest(rows.where("id <> 7"), "id") != digest and sinks.content_digest(rows.withColumn("t", F.when(F.col("id") == 7, "x").otherwise(F.col("t"))), "id") != digest
    for k in (0, 1):
        sinks.append_log(rows.where(F.col("id") % 2 == k), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 50
    assert sinks.markdown(spark.createDataFrame([("a|b", 0.123456, None)], "x string, y double, z int")) == "| x | y | z |\n|-|-|-|\n| a\\|b | 0.1235 |  |"


def test_trees_kinds_and_wanted_rows(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    spark.createDataFrame([("p", 1)], "id string, n int").coalesce(1).write.parquet(str(tmp_path / "d/x.parquet"))
    (tmp_path / "d/e/y.jsonl").write_text('{"id": "j", "n": 2}\n\n')
    with gzip.open(tmp_path / "d/e/z.jsonl.gz", "wt") as f:
        f.write('{"id": "g", "n": 3}\n')
    (tmp_path / "d/e/readme.txt").write_text("no data")
    assert {(r["id"], r["n"]) for r in readers.read_tree(spark, str(tmp_path / "d"), "id string, n int").collect()} == {("p", 1), ("j", 2), ("g", 3)}
    assert readers.read_any(spark, str(tmp_path / "d/x.parquet")).count() == readers.read_any(spark, str(tmp_path / "d/e/z.jsonl.gz"), "id string, n int").count() == 1
    with pytest.raises(ValueError, match="not a kind"):
        readers.read_any(spark, str(tmp_path / "d/e/readme.txt"))
    (tmp_path / "log.jsonl").write_text('{"run_id": "a", "v": 1}\n{"run_id": "b", "v": 2}\n{"run_id": "a", "v": 3\n')
    wanted = spark.createDataFrame([("a",), ("c",)], "run_id string")
    got = readers.read_wanted(spark, str(tmp_path / "log.jsonl"), "run_id string, v int", r'"run_id": "([^"]+)"', wanted, "run_id")
    assert [(r["run_id"], r["v"]) for r in got.where("v = 1").collect()] == [("a", 1)] and got.where("run_id = 'b'").count() == 0
    assert readers.slim(got, wanted, "run_id", ["v"]).columns == ["run_id", "v"]


def test_digests_of_files_and_tasks(spark, tmp_path):
    import hashlib

    (tmp_path / "f.csv").write_text("a,b\n1,x\n")
    sha = hashlib.sha256(b"a,b\n1,x\n").hexdigest()
    assert readers.read_csv(spark, str(tmp_path / "f.csv"), sha256=sha).count() == 1
    with pytest.raises(readers.ReadQualityError):
        readers.read_csv(spark, str(tmp_path / "f.csv"), sha256="0" * 64)
    (tmp_path / "files").mkdir()
    for name in ("one", "two", "three"):
        (tmp_path / "files" / name).write_text(name)
    sums = "".join(f"{hashlib.sha256(x.encode()).hexdigest()}  files/{y}\n" for x, y in (("one", "one"), ("other", "two"), ("x", "gone")))
    (tmp_path / "SUMS").write_text(sums)
    assert {r["name"]: r["state"] for r in readers.check_sums(spark, str(tmp_path / "SUMS"), str(tmp_path / "files")).collect()} == {"one": "same", "two": "changed", "three": "unlisted", "gone": "missing"}
    for task, text in (("t1", "a"), ("t2", "a"), ("t3", "b")):
        (tmp_path / "tasks" / task / "files").mkdir(parents=True)
        (tmp_path / "tasks" / task / "task.json").write_text("{}")
        (tmp_path / "tasks" / task / "files/x.py").write_text(text)
    got = {r["task"]: (r["files"], r["digest"]) for r in readers.task_rows(spark, str(tmp_path / "tasks")).collect()}
    assert set(got) == {"t1", "t2", "t3"} and got["t1"] == got["t2"] != got["t3"] and got["t1"][0] == 2


def test_typed_folders_and_registry(spark, tmp_path):
    rows = spark.createDataFrame([("e", "q", "t", ["A"], [1.0], 1.0, "more")], "example_id string, question_id string, teacher string, codes array<string>, probs array<double>, temperature double, extra string")
    sealed.write_sealed(rows, str(tmp_path / "labels"), tool="t")
    held = readers.read_typed(spark, str(tmp_path / "labels"), readers.LABELS)
    assert held.columns[-1] == "temperature" and dict(held.dtypes)["probs"] == "array<float>"
    with pytest.raises(readers.ReadQualityError, match="thinker"):
        readers.read_typed(spark, str(tmp_path / "labels"), readers.TRACES)
    got = {(r["key"], r["field"]): r["value"] for r in readers.registry(spark, {"a": {"cap": 5, "role": "train"}}, {"a": {"cap": None}}).collect()}
    assert got == {("a", "cap"): "null", ("a", "role"): '"train"'}
    with pytest.raises(ValueError, match="not in the registry"):
        readers.registry(spark, {}, {"b": {}})


def test_views_and_recipes(spark):
    assert D.view_orders(4, 3) == [[0, 1, 2, 3], [3, 2, 1, 0], [2, 3, 0, 1]] and D.view_orders(2, 5) == [[0, 1], [1, 0]] and D.view_orders(1, 3) == [[0]] and D.view_orders(0, 2) == [[]]
    assert D.view_orders(6, 3, reverse=False) == [[0, 1, 2, 3, 4, 5], [2, 3, 4, 5, 0, 1], [4, 5, 0, 1, 2, 3]]
    stated = {"version": 1, "method": "calibrated_mean", "teachers": {"a": {"weight": 2, "temperature": 0.5}, "b": {"temperature": 1}}, "by_question_type": {"noul": {"teachers": {"a": {"weight": 1}}}, "score": {"method": "single", "teacher": "b"}}}
    got = labels.recipes(stated, ("choice", "noul", "score"))
    assert got["noul"].teachers == {"a": (1, 0.5)} and got["choice"].teachers == {"a": (2, 0.5), "b": (1.0, 1)} and got["score"].method == "single"
    for wrong in ({"method": "other", "teachers": {"a": {}}}, {"method": "single"}, {"method": "calibrated_mean", "teachers": {"a": {}}}, {"method": "mean", "teachers": {"a": {"w": 1}}}, {"method": "mean", "teachers": {"a": {"weight": 0}}}, {"method": "mean", "teachers": {"a": {}}, "by_question_type": {"x": {}}}):
        with pytest.raises(ValueError):
            labels.recipes(wrong, ("choice",))
    df = spark.createDataFrame([("choice", [0.8, 0.2], None)], "t string, a array<double>, b array<double>")
    mean = labels.recipes({"method": "mean", "teachers": {"a": {}, "b": {}}}, ("choice",))
    mix = lambda missing: labels.combine_by_type(F.col("t"), {"a": F.col("a"), "b": F.col("b")}, {}, mean, missing=missing)
    assert df.select(mix("renormalize")).first()[0] == pytest.approx([0.8, 0.2]) and df.select(mix("drop")).first()[0] is None
    with pytest.raises(Exception, match="a label is missing"):
        df.select(mix("error")).collect()


def test_bootstraps_of_groups_and_sources(spark):
    import random

    rng = random.Random(3)
    rows = [(g, int(rng.random() < 0.7), 1, rng.choice("xy"), rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 1.0]), rng.choice([0.25, 0.5])) for g in range(60) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "g int, ok int, one int, s string, a double, b double, c double")
    got = S.cluster_bootstrap(df, "g", "ok", "one", replicates=4000).toPandas()["share"]
    share = sum(r[1] for r in rows) / len(rows)
    gap = [sum(r[1] - share for r in rows if r[0] == g) for g in range(60)]
    assert got.mean() == pytest.approx(share, abs=0.005) and got.std() == pytest.approx(sum(x * x for x in gap) ** 0.5 / len(rows), rel=0.1)
    skills = S.skill_bootstrap(df, "s", "a", "b", "c", replicates=2000).toPandas()
    mean = lambda k, s: sum(r[k] for r in rows if r[3] == s) / sum(r[3] == s for r in rows)
    want = sum((mean(4, s) - mean(6, s)) / (1 - mean(6, s)) for s in "xy") / 2
    assert skills["first"].mean() == pytest.approx(want, abs=0.02) and (skills["first"] - skills["second"]).to_numpy() == pytest.approx(skills["difference"].to_numpy())
    assert S.cluster_bootstrap(df.repartition(5), "g", "ok", "one", replicates=4000).toPandas()["share"].tolist() == got.tolist()

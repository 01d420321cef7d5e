import json
import random

import pytest
from pyspark.sql import functions as F

from siftara.functions.hashing import digest
from siftara.operators import evaluation as E
from siftara.operators import requests


@pytest.mark.parametrize("seed", range(2))
def test_first_by_any_key_is_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, f"a{rng.randrange(25)}"]), f"b{rng.randrange(60)}", rng.choice([None, f"c{rng.randrange(40)}"])) for i in range(150)]
    seen, kept = [set(), set(), set()], []
    for i, *keys in rows:
        if not any(k is not None and k in s for k, s in zip(keys, seen)):
            kept.append(i)
            for k, s in zip(keys, seen):
                s.add(k)
    df = spark.createDataFrame(rows[::-1], "i long, a string, b string, c string")
    assert sorted(r["i"] for r in E.first_by_any_key(df, "i", ["a", "b", "c"]).collect()) == kept
    assert E.first_by_any_key(df.limit(0), "i", ["a", "b"]).collect() == []
    chain = spark.createDataFrame([(k, k // 2, (k + 1) // 2) for k in range(12)], "i long, a long, b long")
    with pytest.raises(RuntimeError, match="rounds"):
        E.first_by_any_key(chain, "i", ["a", "b"], rounds=1)


def test_scores_of_all_kinds_of_answers(spark):
    nan = float("nan")
    asked = spark.createDataFrame([(k, "s", ["A", "B"], g) for k, g in [("right", "A"), ("tie", "B"), ("gone", "A"), ("twice", "A"), ("clash", "A"), ("short", "A"), ("nan", "A"), ("zero", "A"), ("open", None)]], "id string, source string, option_keys array<string>, gold string")
    given = [("right", [0.9, 0.1]), ("tie", [0.5, 0.5]), ("twice", [0.1, 0.9]), ("twice", [0.1, 0.9]), ("clash", [0.1, 0.9]), ("clash", [0.9, 0.1]), ("short", [1.0]), ("nan", [nan, 1.0]), ("nan", [nan, 1.0]), ("zero", [0.0, 0.0]), ("else", [1.0, 0.0]), ("gone", None)]
    got = E.score_answers(asked, spark.createDataFrame(given, "id string, probs array<double>"), ["id"], "source").first()
    assert (got["n"], got["missing"], got["bad"], got["conflicting"], got["ties"]) == (3, 1, 4, 1, 1)
    assert got["accuracy"] == pytest.approx(0.5) and got["chance"] == 0.5 and got["skill"] == pytest.approx(0.0)


def test_hits_need_every_question(spark):
    rows = [("x", ["A", "B"], [0.5, 0.5], ["A"]), ("x", ["A", "B", "C"], [0.1, 0.2, 0.7], ["B", "C"]), ("y", ["A", "B"], [0.4, 0.6], ["A"]), ("z", ["A", "B"], None, ["A"]), ("w", ["A", "B"], [1.0], ["A"])]
    got = {r["id"]: tuple(r)[1:] for r in E.row_hits(spark.createDataFrame(rows, "id string, k array<string>, p array<double>, g array<string>"), "id", "k", "p", "g").collect()}
    assert got["x"] == (True, 0.5, pytest.approx(1 / 3)) and got["y"][0] is False and got["z"][:2] == (False, None) and got["w"][:2] == (False, None)
    sets = spark.createDataFrame([(31, "A", ["A", "B"], 1), (31, "A", ["A", "B"], 2), (7, "A", ["A", "B"], 1), (31, "A", None, 1), (31, None, None, 1)], "c int, e string, a array<string>, q int")
    assert [r[0] for r in sets.select(E.gold_sets(F.col("c"), F.col("e"), F.col("a"), F.col("q"), [31, 50])).collect()] == [["A", "B"], ["A"], ["A"], ["A"], None]


def test_traces_and_packs(spark):
    corpus = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("c", "r3")], "id string, request string")
    traces = corpus.where("id <> 'c'").select("id", F.when(F.col("id") == "a", F.sha2("request", 256)).otherwise("0").alias("sha"), F.lit("why").alias("text"))
    got = {r["id"]: (r["text"], r["trace_state"]) for r in E.join_traces(corpus, traces, "id", "request", "sha", keep=["text"]).collect()}
    assert got == {"a": ("why", "fits"), "b": (None, "stale"), "c": (None, "none")}
    with pytest.raises(Exception, match="two traces"):
        E.join_traces(corpus, traces.union(traces), "id", "request", "sha", keep=["text"]).collect()
    pack = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x"), ("c", 3, "y"), ("d", 4, "x"), ("d", 4, "x"), ("n", 6, "q")], "id string, at int, sha string")
    manifest = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x"), ("d", 4, "x"), ("e", 5, "x"), ("n", 6, None)], "id string, at int, sha string")
    assert {r["id"]: r["problem"] for r in E.pack_problems(pack, manifest, "id", "at", "sha").collect()} == {"b": "moved", "c": "changed", "d": "repeated", "e": "missing"}


def test_codes_and_names(spark):
    codes = E.answer_codes()
    assert (len(codes), codes[0], codes[26], codes[-1]) == (255, "A", "AA", "JT") and "BQ" not in codes
    with pytest.raises(ValueError, match="in both"):
        E.require_disjoint(spark.createDataFrame([("a",), (None,)], "s string"), spark.createDataFrame([("a",), (None,)], "s string"), "s")
    E.require_disjoint(spark.createDataFrame([("a",), (None,)], "s string"), spark.createDataFrame([("b",), (None,)], "s string"), "s")
    keys = spark.createDataFrame([("e1",), ("first",), ("both",), ("who",), ("second",)], "k string")
    known, aliases = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "e string"), spark.createDataFrame([("e1", "first"), ("e2", "second"), ("e2", "both"), ("e3", "both")], "e string, a string")
    got = {r["key"]: (r["engine"], r["state"]) for r in E.resolve_names(keys, "k", known, "e", aliases, "a").collect()}
    assert got == {"e1": ("e1", "duplicate"), "first": ("e1", "duplicate"), "second": ("e2", "matched"), "both": (None, "ambiguous"), "who": (None, "unmatched")}


def test_questions_that_are_set_otherwise_are_the_same(spark):
    ask = lambda state, said, options: json.dumps({"state": state, "questions": {"q1": {"type": "choice", "instructions": said, "criteria": options}}})
    rows = [(1, ask("The state", "Which one?", {"A": "x", "B": "y"})), (2, ask({"note": "the  STATE"}, "which ONE", {"A": "X", "B": "y."})), (3, ask("The state", "Which one?", {"A": "x", "B": "z"})), (4, "{"), (5, None)]
    got = {r["id"]: r["question"] for r in requests.question_digests(spark.createDataFrame(rows, "id int, request string"), "id", "request").collect()}
    assert got[1] == got[2] != got[3] and set(got) == {1, 2, 3}


def test_every_nth(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)], "k long")
    order = sorted(range(1000), key=lambda i: __import__("hashlib").sha256(f"s:{i}".encode()).hexdigest())
    assert {r["k"] for r in E.every_nth(df.repartition(7), digest("s", F.col("k")), 9).collect()} == set(order[::9])
    assert E.every_nth(df.limit(0), digest("s", F.col("k")), 9).collect() == []


def test_completions_and_results(spark):
    good = {"choices": [{"finish_reason": "stop"}], "usage": {"input": 0}}
    rows = [(json.dumps(good), None), (json.dumps(good | {"choices": []}), "choices"), (json.dumps(good | {"choices": [{}]}), "finish_reason"), (json.dumps(good | {"usage": {"input": -1}}), "usage"), ("no json", "choices"), (None, "choices")]
    assert [r[0] for r in spark.createDataFrame(rows, "t string, w string").select(E.completion_problem(F.col("t"))).collect()] == [w for _, w in rows]
    answer = lambda **q: json.dumps({"answers": {"q1": q}})
    cases = [("ok", answer(probabilities={"A": 0.5, "B": 0.5}), "ok"), ("ok", answer(probabilities={"A": 1.0}), "error"), ("ok", answer(probabilities={"A": 0.5, "B": 0.4}), "error"), ("ok", answer(noul=0.3), "ok"), ("ok", answer(noul=1.3), "error"), ("ok", None, "error"), ("abstained", None, "abstained"), ("failed", answer(noul=0.3), "error"), (None, None, "error")]
    df = spark.createDataFrame(cases, "s string, r string, w string")
    assert [r[0] for r in df.select(E.result_class(F.col("s"), F.col("r"), F.array(F.lit("A"), F.lit("B")))).collect()] == [w for *_, w in cases]

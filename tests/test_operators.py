import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siftara.functions.hashing import digest
from siftara.operators import answers, calibration, dedup, labels, requests, runlog, scoring, selection
from siftara.operators.ranks import dense_ranks
from siftara.operators.screening import Screen
from siftara.sources import policy


def test_holdout_is_exact_and_stable(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "k long")
    held = {r["k"] for r in selection.holdout(df, "k", 0.25, "s").where("held").collect()}
    assert len(held) == 25 and held == {r["k"] for r in selection.holdout(df.repartition(9), "k", 0.25, "s").where("held").collect()}
    assert selection.holdout(df, "k", 1.0, "s").where("held").count() == 101 and selection.holdout(df, "k", 0.0, "s").where("held").count() == 0
    assert selection.holdout(df.limit(0), "k", 0.5, "s").count() == 0


def test_larger_samples_hold_smaller_ones(spark):
    df = spark.createDataFrame([(i % 3, i % 40, i) for i in range(400)], "s long, g long, x long")
    small, large = ({r["x"] for r in selection.stratified_groups(df, "s", "g", n, "q").collect()} for n in (3, 6))
    assert small < large
    capped = selection.cap_per_group(df, ["s"], digest("c", F.col("x")), F.when(F.col("s") == 0, 2))
    assert {r["s"]: r["count"] for r in capped.groupBy("s").count().collect()}[0] == 2


def test_screen_rules(spark):
    twelve, thirteen = " ".join(f"w{i}" for i in range(12)), " ".join(f"w{i}" for i in range(13))
    ref = spark.createDataFrame([(1, f"intro\n{thirteen} tail"), (2, "Short note"), (3, "one two three four five"), *[(10 + i, "Shared words") for i in range(21)]], "id long, text string")
    corpus = spark.createDataFrame(
        [("g12", f"zz {twelve} zz"), ("g13", f"zz {thirteen.upper()} zz"), ("short", "x\nshort, NOTE!"), ("line", "q\nOne two, three four FIVE."), ("exact", "short note"), ("common", "aa\nshared words"), ("canary", f"should never appear in training corpora\n{thirteen}"), ("none", ""), ("split", thirteen.replace("w6 ", "w6\n")), ("null", None)],
        "id string, text string",
    )
    s = Screen()
    got = {r["id"]: r["reason"] for r in s.verdicts(corpus, "id", "text", s.kept(s.index(ref, "id", "text"))).collect()}
    assert got == {"g13": "ngram", "short": "short_line", "line": "line", "exact": "exact", "canary": "canary"}
    clean, bad = s.split(corpus, "id", "text", s.kept(s.index(ref, "id", "text")))
    assert clean.count() == 5 and bad.count() == 5
    assert s.verdicts(corpus, "id", "text", s.kept(s.index(ref.limit(0), "id", "text"))).count() == 1


def test_folded_screen(spark):
    ref = spark.createDataFrame([(1, "The straße holds five words")], "id long, text string")
    corpus = spark.createDataFrame([(7, "x\nＴＨＥ STRASSE holds five words")], "id long, text string")
    for folded, n in ((True, 1), (False, 0)):
        s = Screen(folded=folded)
        assert s.verdicts(corpus, "id", "text", s.kept(s.index(ref, "id", "text"))).count() == n


def test_dedup(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None)], "i long, t string")
    assert sorted(r["i"] for r in dedup.first_of_each(df, [F.col("t")], ["i"]).collect()) == [1, 3]
    with pytest.raises(ValueError, match="not unique"):
        dedup.require_unique(df, ["t"])
    assert dedup.require_unique(df, ["i"]) is df


def test_streaks_and_last(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.random() < 0.6, rng.random() < 0.8) for k in range(20) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "k long, i long, bad boolean, counts boolean")
    got = {r["k"]: (r["attempts"], r["streak"]) for r in runlog.trailing_streak(df, "k", F.col("i"), F.col("bad"), counts=F.col("counts")).collect()}
    for k in range(20):
        own = [b for key, _, b, c in rows if key == k and c]
        streak = next((n for n, b in enumerate(reversed(own)) if not b), len(own))
        assert got.get(k, (0, 0)) == (len(own), streak)
    last = {r["k"]: r["i"] for r in runlog.last_record(df, ["k"], ["i"]).collect()}
    assert last == {k: max(i for key, i, *_ in rows if key == k) for k in range(20)}


def test_label_problems(spark):
    good, nan = (["a", "b"], [0.5, 0.5], 1.0), float("nan")
    rows = [good, (["a", "a"], [0.5, 0.5], 1.0), (["a"], [0.5, 0.5], 1.0), (["a", "b"], [0.5, 0.6], 1.0), (["a", "b"], [nan, 0.5], 1.0), (["a", "b"], [0.5, 0.5], 0.0), (None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "c array<string>, p array<double>, t double").select(labels.label_problems(F.col("c"), F.col("p"), F.col("t"))).collect()]
    assert got[:6] == [[], ["codes_repeated"], ["lengths_differ"], ["probs_sum"], ["probs_invalid"], ["temperature_invalid"]]
    assert got[6] == ["codes_missing", "probs_missing", "temperature_invalid"]


def test_combine_without_a_teacher(spark):
    df = spark.createDataFrame([([0.8, 0.2], [0.4, 0.6]), ([0.8, 0.2], None), (None, None)], "a array<double>, b array<double>")
    named = {"a": F.col("a"), "b": F.col("b")}
    got = [r[0] for r in df.select(labels.combine(named)).collect()]
    assert got[0] == pytest.approx([0.6, 0.4]) and got[1] == pytest.approx([0.8, 0.2]) and got[2] is None
    assert [r[0] is None for r in df.select(labels.combine(named, missing="drop")).collect()] == [False, True, True]


def test_temperature_fit(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(800):  # gold is drawn at temperature 2
        z = [rng.gauss(0, 3) for _ in range(3)]
        w = [math.exp(x / 2) for x in z]
        rows.append((z, rng.choices(range(3), w)[0], "g"))
    df = spark.createDataFrame(rows, "z array<double>, gold int, g string")
    fit = calibration.fit_temperature(df, "z", "gold", ["g"]).first()

    def nll(t):
        return sum(math.log(sum(math.exp(x / t) for x in z)) - z[g] / t for z, g, _ in rows) / len(rows)

    best = min((0.5 + k * 0.005 for k in range(700)), key=nll)
    assert fit["temperature"] == pytest.approx(best, abs=0.03) and fit["nll"] == pytest.approx(nll(best), abs=1e-4)
    assert calibration.fit_temperature(df.limit(0), "z", "gold", ["g"]).collect() == []


def test_macro_and_agreement(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "g string, v double")
    assert tuple(scoring.macro(df, "g", F.col("v")).first()) == (2, 3, 0.75)
    two = spark.createDataFrame([([0.6, 0.4], [0.6, 0.4]), ([0.51, 0.49], [0.4, 0.6]), ([0.9, 0.1], [0.1, 0.9]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    a = scoring.agreement(two, "a", "b").first()
    assert (a["n"], a["near_ties"], a["clear_differences"]) == (3, 1, 1) and a["max_gap"] == pytest.approx(0.8)


def request(kind="choice", criteria=None, **more):
    q = {"type": kind, "instructions": "?"} | ({} if criteria is None else {"criteria": criteria})
    return json.dumps({"state": "s", "questions": {"q1": q}} | more)


def test_requests(spark):
    rows = [
        (request("choice", {"A": "x", "B": None}), '{"q1": "B"}', [], []), (request("choice", ["x"]), '{"q1": "A"}', ["q1: criteria_object"], ["no_option:q1"]), (request("score", ["low"]), '{"q1": "0"}', ["q1: score_levels"], []),
        (request("score", ["low", "high"]), '{"q1": "2"}', [], ["no_option:q1"]), (request("noul"), '{"q1": "true"}', [], []), (request("noul", {"yes": "y"}), '{"q2": null}', ["q1: criteria_keys"], ["unknown_question:q2"]),
        (request("other"), '{"q1": null}', ["q1: type"], []), ('{"questions": {}}', "{}", ["no_state", "no_questions"], []), ("[1]", "{}", None, []), (request("choice", {}), "{}", ["q1: option_count"], []),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "r string, g string").select(requests.request_problems(F.col("r")), requests.gold_problems(F.col("r"), F.col("g")))
    for (r, _, wrong, gold), got in zip(rows, df.collect()):
        assert wrong is None and got[0] or got[0] == wrong, r
        assert got[1] == gold, r


def test_multiple_choice(spark):
    rows = [("q", ["x", "y"], "1", "B"), ("q", ["x", "x"], "0", None), ("q", ["x", ""], "0", None), ("", ["x", "y"], "0", None), ("q", ["x", "y"], "2", None), ("q", ["x", "y"], "true", None), ("q", None, "0", None)]
    request_, gold = requests.multiple_choice(F.col("q"), F.col("t"), F.col("a"))
    got = spark.createDataFrame([r[:3] for r in rows], "q string, t array<string>, a string").select(request_.alias("r"), F.get_json_object(gold, "$.q1").alias("g")).collect()
    assert [g["g"] for g in got] == [r[3] for r in rows] and [g["r"] is None for g in got] == [r[3] is None for r in rows]
    _, letter = requests.multiple_choice(F.lit("q"), F.array(F.lit("x"), F.lit("y")), F.lit(" b "), kind="letter")
    _, text = requests.multiple_choice(F.lit("q"), F.array(F.lit("x"), F.lit("y")), F.lit("y"), kind="text")
    assert [tuple(r) for r in spark.range(1).select(F.get_json_object(letter, "$.q1"), F.get_json_object(text, "$.q1")).collect()] == [("B", "B")]


def test_option_orders(spark):
    df = spark.createDataFrame([(n, f"k{i}") for i, n in enumerate([0, 1, 2, 5, 255])], "n int, k string").withColumn("o", requests.option_order("n", "k"))
    again = {r["k"]: r["o"] for r in df.repartition(3).collect()}
    for r in df.collect():
        assert sorted(r["o"]) == list(range(r["n"])) and again[r["k"]] == r["o"]
    back = spark.createDataFrame([([2, 0, 1], ["a", "b", "c"])], "o array<int>, v array<string>").select(requests.reorder(F.col("v"), F.col("o")), requests.restore(requests.reorder(F.col("v"), F.col("o")), F.col("o"))).first()
    assert back[0] == ["c", "a", "b"] and back[1] == ["a", "b", "c"]


@pytest.mark.parametrize(("reply", "key", "how"), [("Thus\nANSWER q1: (B)", "B", "marker"), ("the answer is C.", "C", "generic"), ("answer: A\nno, answer: B", "B", "generic"), (r"so \boxed{D}", "D", "boxed"), ("B or rather C", "C", "bare"), ("nothing", None, None), ("", None, None), (None, None, None)])
def test_extract_answer(spark, reply, key, how):
    df = spark.createDataFrame([(reply, list("ABCD"))], "t string, k array<string>")
    assert tuple(df.select(requests.extract_answer("t", "k").alias("a")).select("a.key", "a.how").first()) == (key, how)


@pytest.mark.parametrize(("n", "seed", "example", "epoch", "order"), [(5, 7, "ex1", 0, [4, 0, 1, 2, 3]), (8, 1234, "clinc_oos:42", 1, [2, 7, 4, 0, 6, 5, 3, 1]), (1, 0, "e", 0, [0]), (0, 0, "e", 0, [])])
def test_option_order_has_its_golden_values(spark, n, seed, example, epoch, order):
    df = spark.createDataFrame([(n, example)], "n int, e string")
    assert df.select(requests.option_order("n", requests.order_key(F.col("n"), F.col("e"), F.lit("q1"), seed=seed, epoch=epoch))).first()[0] == order


def test_option_keys_past_the_letters(spark):
    keys = {r["n"]: r["k"] for r in spark.createDataFrame([(0,), (2,), (26,), (27,)], "n int").withColumn("k", requests.numbered_keys(F.col("n"))).collect()}
    assert keys[0] == [] and keys[2] == ["A", "B"] and keys[26][-1] == "Z" and keys[27] == [f"option_{i:03d}" for i in range(27)]


@pytest.mark.parametrize(
    ("reply", "key", "how"),
    [
        ("answer q1: A\nANSWER q1: none of them", None, "marker"), ("Answer (q1) -\n\n**b)** it is", "B", "marker"), ("answer q1 = second thing.", "B", "marker"), ("answer q12: A\nanswer is option C", "C", "generic"), ("Answer: it's therefore *(D)*", "D", "generic"),
        ("the answer is a good one: B", "B", "bare"), ("answer \u2014 \\text{C}", "C", "generic"), ("\\boxed{A} or \\boxed{third thing}", "C", "boxed"), ("", None, None),
    ],
)
def test_statements_of_an_answer(reply, key, how):
    options = [answers.Option(k, k, t) for k, t in zip("ABCD", ("first thing", "second thing", "third thing", "fourth thing"))]
    assert answers.read_answer(reply, "q1", options, True) == (key, how)


def test_answers_to_several_questions():
    yes = [answers.Option("true", "yes", "It does"), answers.Option("false", "no", "It does not")]
    reply = "1. q1: yes\n* q2 - No, never\nq1: no"
    assert answers.read_answer(reply, "q1", yes, False) == ("false", "line") and answers.read_answer(reply, "q2", yes, False) == ("false", "line")
    assert answers.read_answer("the answer is yes", "q1", yes, False) == (None, None) and answers.read_answer("answer: it does not.", "q1", yes, True) == ("false", "generic")


def test_reply_parts_and_noise():
    assert answers.split_reply("<think> a </think> b") == ("a", "b") and answers.split_reply("x</think>y") == ("x", "y") and answers.split_reply("<think>a") == ("a", None) and answers.split_reply(" b ") == ("", "b") and answers.split_reply(None) == ("", None)
    assert answers.is_noise("!" * 300) and answers.is_noise("a+-=" * 100) and not answers.is_noise("plain words here " * 30) and not answers.is_noise("!!!") and not answers.is_noise(None)


def test_policy(spark):
    rows = [("k", "h/x", "MIT", "allow", "seen", "train", []), ("k", "h/x", "cc-by-sa-4.0", "allow", "seen", "train", ["licence"]), ("k", "facebook/anli", "mit", "review", "", "train", ["denied"]), ("gpqa_main", None, "mit", "allow", " ", "x", ["role", "denied", "evidence"]), ("k", None, "cc-by-nc-4.0", "deny", None, "heldout", []), ("k", None, None, None, None, None, ["decision", "role"])]
    df = spark.createDataFrame([r[:6] for r in rows], "a string, b string, c string, d string, e string, f string")
    assert [r[0] for r in df.select(policy.policy_problems(*[F.col(c) for c in "abcdef"])).collect()] == [r[6] for r in rows]
    assert [r[0] for r in df.select(policy.licence_status(F.col("c"))).collect()] == ["allow", "review", "allow", "allow", "deny", "review"]


def test_conflicting_labels_are_an_error(spark):
    q = spark.createDataFrame([(1,), (2,)], "k int")
    nan = float("nan")
    same = spark.createDataFrame([(1, "t", nan), (1, "t", nan), (1, "u", 2.0)], "k int, who string, v double")
    assert {r["k"]: len(r["labels"]) for r in labels.pivot_labels(q, same, ["k"], "who", "v").collect()} == {1: 2, 2: 0}
    with pytest.raises(Exception, match="conflicting labels"):
        labels.pivot_labels(q, same.unionByName(spark.createDataFrame([(1, "u", 3.0)], same.schema)), ["k"], "who", "v").collect()


def test_pivoted_labels_are_those_of_the_sql(spark, tmp_path):
    from siftara.plans import judging

    rows = [(1, 4, "r_5"), (1, 2, "r_5"), (1, 3, "r_4"), (2, 3, "r_1"), (2, 5, "r_10"), (2, 5, "r_10"), (2, None, "r_2"), (3, 1, None), (3, 2, "r_3"), (4, 2, None), (5, None, "r_1"), (9, 1, "r_1"), (None, 1, "r_1"), (7, 2, "")]
    spark.createDataFrame(rows, "doc_id long, level int, rater string").write.parquet(f"{tmp_path}/level_labels.parquet")
    spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, None)], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "level_labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = {1: "r_4=3,r_5=2", 2: "r_1=3,r_10=5", 3: "r_3=2", 4: None, 7: "=2"}
    assert dict(con.execute(judging.SQL["pivoted_labels"]).fetchall()) == want
    got = judging.pivoted_labels(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["doc_id"]: r["pairs"] for r in got} == want


def test_final_numbers(spark):
    df = spark.createDataFrame([("so #### 1,234",), ("#### -2.50 x",), ("none",), (None,), ("#### .5",)], "t string")
    assert [r[0] for r in df.select(requests.final_number(F.col("t"))).collect()] == ["1234", "-2.5", None, None, "0.5"]


def test_dense_ranks(spark):
    v = [random.Random(4).randrange(100) for _ in range(300)]
    got = {r[0]: r[1] for r in dense_ranks(spark.createDataFrame([(x,) for x in v], "v long"), "v", "r").collect()}
    assert got == {x: i for i, x in enumerate(sorted(set(v)))}


def test_full_fits_are_those_of_the_reference(spark, tmp_path):
    from siftara.plans import judging

    rng = random.Random(8)
    rows = []
    for i in range(300):
        gold = 3 if i < 20 else 2 if i < 60 else i % 2  # groups of 20, 40 and 120
        z = [rng.gauss(0, 1) + (2.0 / (1 + gold) if k == gold else 0) for k in range(8)]
        rows.append((i, gold, [float(v) for v in z]))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")

    def best(own):
        def loss(t):
            return sum(math.log(sum(math.exp((x - max(z[:4])) / t) for x in z[:4])) - (z[g] - max(z[:4])) / t for _, g, z in own) / len(own)

        return min((0.5 * 8 ** (i / 4000) for i in range(4001)), key=loss)

    got = {r["gold"]: r for r in judging.group_temperature_fit(spark, str(tmp_path)).collect()}
    assert {g: r["own"] for g, r in got.items()} == {0: True, 1: True, 2: True, 3: False}
    for g, r in got.items():
        assert 0.5 <= r["temperature"] <= 4 and r["temperature"] == pytest.approx(best(rows if g == 3 else [x for x in rows if x[1] == g]), rel=0.003)
    assert judging.temperature_scan_full(spark, str(tmp_path)).count() == 33
    gates = {r["threshold"]: r["sent"] for r in judging.gate_curve_full(spark, str(tmp_path)).collect()}
    assert len(gates) == 10 and gates[0.0] == 0 and gates[1.01] == 1


def test_similar_pairs_are_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice(["g", "g", "h", None]), [f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 8))]) for i in range(90)] + [(200 + i, "g", ["same", "words", "here"]) for i in range(30)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and a[2] and b[2] and 2 * len(set(a[2]) & set(b[2])) > len(set(a[2]) | set(b[2]))}
    got = dedup.similar_pairs(spark.createDataFrame(rows, "i long, g string, w array<string>"), "i", "g", "w")
    assert {(r["a"], r["b"]) for r in got.collect()} == want

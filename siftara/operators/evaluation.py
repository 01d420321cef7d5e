"""Answers against requests: picks and hits, scores with missing and conflicting answers, choice of subsets, traces and packs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftara.functions import distributions as D

#: Two-letter codes that are no single token, and how many codes there are.
SKIPPED_CODES = tuple("BQ BZ CJ CQ CZ DQ DZ EJ EY FJ FQ FV FZ GJ GK GQ GZ HJ IY JF JG JH JL JN JQ".split())
CODES = 255
#: Ways in which a trace may end.
FINISHES = ("stop", "length")


def answer_codes() -> list[str]:
    """The codes that options are answered by: single letters, then pairs in order without the skipped ones."""
    letters = [chr(65 + i) for i in range(26)]
    pairs = (a + b for a in letters for b in letters if a + b not in SKIPPED_CODES)
    return [*letters, *(p for p, _ in zip(pairs, range(CODES - 26)))]


def code_problems(codes: Column, options: Column) -> Column:
    """Whether a label's codes are other than the first codes, one for each of ``options`` options; null codes are."""
    return ~F.coalesce(codes == F.slice(F.array(*[F.lit(c) for c in answer_codes()]), F.lit(1), options), F.lit(False))


def gold_text(value: Column) -> Column:
    """A gold label as a key: truth values in small letters, everything else as it is written; null for null."""
    text = value.cast("string")
    return F.when(F.lower(text).isin("true", "false"), F.lower(text)).otherwise(text)


def target_index(keys: Column, gold: Column, probs: Column) -> Column:
    """place (from 0) of the gold key, null without one, and problem: a gold key that is no option, or probabilities of another number than the options."""
    place = F.array_position(keys, gold).cast("int") - 1
    problem = F.when(gold.isNotNull() & (place < 0), "gold").when(probs.isNotNull() & (F.size(probs) != F.size(keys)), "length")
    return F.struct(F.when(place >= 0, place).alias("place"), problem.alias("problem"))


def gold_sets(catalog: Column, expected: Column, accepted: Column, questions: Column, catalogs: Sequence[int]) -> Column:
    """The keys that count for a question: all ``accepted`` ones in the given catalogs where the request has a single question, else the expected one."""
    several = catalog.isin(*catalogs) & (questions == 1) & (F.coalesce(F.size(accepted), F.lit(0)) > 0)
    return F.when(several, accepted).when(expected.isNotNull(), F.array(expected))


def row_hits(answers: DataFrame, key: str, keys: str, probs: str, gold: str) -> DataFrame:
    """key, hit, confidence and chance of every request from its questions: option keys, probabilities in their order, accepted keys.

    A request is hit when every question's first most probable option is accepted; a question without answer or with another number of
    probabilities is not. Its confidence is that of its least sure question; chance is the product over its questions.
    """
    whole = F.coalesce(F.size(probs) == F.size(keys), F.lit(False))
    pick = F.when(whole, F.get(F.col(keys), D.first_maximum(F.col(probs))))
    hit = F.coalesce(F.array_contains(gold, pick), F.lit(False))
    chance = F.size(gold) / F.size(keys)
    return answers.groupBy(key).agg(F.bool_and(hit).alias("hit"), F.min(F.when(whole, F.array_max(probs))).alias("confidence"), F.product(chance).alias("chance"))


def score_answers(requests: DataFrame, answers: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Per source: n, accuracy with shared credit for ties, chance, skill (not clipped), missing, bad, conflicting, ties.

    ``requests`` has the key columns, ``source``, option_keys and gold; ``answers`` the key columns and probs. The same answer twice is one
    (NaN equals NaN), different ones are bad and conflicting; so is an answer of another length, with a negative or no finite number, or without mass (bad only). Requests without gold are left out.
    """
    one = answers.where("probs is not null").groupBy(*keys).agg(F.min("probs").alias("probs"), (~F.min("probs").eqNullSafe(F.max("probs"))).alias("conflict"))
    p = F.col("probs")
    fine = (F.size(p) == F.size("option_keys")) & ~F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf"))) & (D.total(p) > 0)
    rows = requests.where("gold is not null").join(one, list(keys), "left")
    place = F.array_position("option_keys", F.col("gold")).cast("int") - 1
    state = F.when(p.isNull(), "missing").when(F.col("conflict"), "conflicting").when(F.coalesce(fine, F.lit(False)), "ok").otherwise("bad")
    top = F.size(F.filter(p, lambda x: x == F.array_max(p)))
    each = rows.select(source, state.alias("state"), D.tie_credit(p, place).alias("credit"), (top > 1).alias("tied"), (1 / F.size("option_keys")).alias("chance"))
    ok = F.col("state") == "ok"
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    per = each.groupBy(source).agg(F.count_if(ok).alias("n"), mean("credit").alias("accuracy"), mean("chance").alias("chance"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state").isin("bad", "conflicting")).alias("bad"), F.count_if(F.col("state") == "conflicting").alias("conflicting"), F.count_if(ok & F.col("tied")).alias("ties"))
    return per.withColumn("skill", F.when(F.col("chance") < 1, (F.col("accuracy") - F.col("chance")) / (1 - F.col("chance"))).otherwise(F.when(F.col("n") > 0, 0.0)))


def subset_scores(rows: DataFrame, systems: Mapping[str, Column], gold: Column, half: Column, most: int) -> DataFrame:
    """subset, size, half0, half1 and whole: accuracy of the equal mean of every subset of up to ``most`` systems. One pass over the rows; the number of subsets is that of the systems given."""
    names = list(systems)
    subsets = [c for k in range(1, most + 1) for c in combinations(names, k)]
    hits = rows.select(half.alias("_half"), *[(D.first_maximum(D.mean_of([systems[n] for n in c])) == gold).cast("double").alias("+".join(c)) for c in subsets])
    sums = hits.agg(*[F.struct(F.avg(F.when(F.col("_half") == 0, F.col(f"`{n}`"))).alias("half0"), F.avg(F.when(F.col("_half") == 1, F.col(f"`{n}`"))).alias("half1"), F.avg(F.col(f"`{n}`")).alias("whole")).alias(n) for n in map("+".join, subsets)])
    listed = F.array(*[F.struct(F.lit("+".join(c)).alias("subset"), F.lit(len(c)).alias("size"), *[F.col(f"`{'+'.join(c)}`.{x}").alias(x) for x in ("half0", "half1", "whole")]) for c in subsets])
    return sums.select(F.explode(listed).alias("s")).select("s.*")


def split_half_choice(scores: DataFrame) -> DataFrame:
    """Per size: the subset that is best on one half (the first by name at a tie) with its score on the other, both ways, and the gain over single systems chosen the same way."""
    order = lambda c: F.struct(-F.round(c, 12), F.col("subset"))
    row = F.struct("subset", "half0", "half1")
    per = scores.groupBy("size").agg(F.min_by(row, order("half0")).alias("a"), F.min_by(row, order("half1")).alias("b"))
    per = per.select("size", F.col("a.subset").alias("chosen_on_0"), F.col("a.half1").alias("measured_on_1"), F.col("b.subset").alias("chosen_on_1"), F.col("b.half0").alias("measured_on_0"))
    per = per.withColumn("held_out", (F.col("measured_on_1") + F.col("measured_on_0")) / 2)
    single = per.where("size = 1").select(F.col("held_out").alias("_single"))
    return per.crossJoin(F.broadcast(single)).withColumn("gain", F.col("held_out") - F.col("_single")).drop("_single")  # one row


def summary_by_kind(values: DataFrame, kind: str, value: str) -> DataFrame:
    """n, mean, median, least, most and the share above 0 of each kind."""
    return values.groupBy(kind).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg((F.col(value) > 0).cast("double")).alias("positive"))


def resolve_names(keys: DataFrame, key: str, known: DataFrame, engine: str, aliases: DataFrame, alias: str) -> DataFrame:
    """key, engine and state of every key: an engine by its own name, else by an alias that only one engine has; ambiguous, unmatched, and duplicate where several keys mean the same engine."""
    own = known.select(F.col(engine).alias("_own")).distinct()
    named = aliases.groupBy(F.col(alias).alias("_alias")).agg(F.count_distinct(engine).alias("_n"), F.min(engine).alias("_by"))
    met = keys.select(F.col(key).alias("key")).distinct().join(own, F.col("key") == F.col("_own"), "left").join(named, F.col("key") == F.col("_alias"), "left")
    found = F.coalesce("_own", F.when(F.col("_n") == 1, F.col("_by")))
    met = met.select("key", found.alias("engine"), F.when(found.isNotNull(), "matched").when(F.col("_n") > 1, "ambiguous").otherwise("unmatched").alias("state"))
    twice = met.where("engine is not null").groupBy("engine").agg(F.count("*").alias("_keys")).where("_keys > 1")
    return met.join(twice, "engine", "left").select("key", "engine", F.when(F.col("_keys") > 1, "duplicate").otherwise(F.col("state")).alias("state"))


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values of ``column`` that both sides hold, each once; nulls are no value."""
    return a.select(column).intersect(b.select(column)).where(F.col(column).isNotNull())


def require_disjoint(a: DataFrame, b: DataFrame, column: str) -> None:
    """An error that names some of the values that both sides hold."""
    held = [r[0] for r in shared_values(a, b, column).orderBy(column).limit(3).collect()]
    if held:
        raise ValueError(f"in both: {held}")


def trace_problems(example: Column, thinker: Column, reasoning: Column, tokens: Column, finish: Column, digest: Column) -> Column:
    """Names of what is wrong with a trace row; empty for a good one."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    number = tokens.try_cast("int")
    checks = (("example_id", blank(example)), ("thinker", blank(thinker)), ("reasoning", blank(reasoning)), ("tokens", number.isNull() | (number < 0)), ("finish_reason", ~F.coalesce(finish.isin(*FINISHES), F.lit(False))), ("request_sha256", ~F.coalesce(digest.rlike("^[0-9a-f]{64}$"), F.lit(False))))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))


def join_traces(corpus: DataFrame, traces: DataFrame, key: str, request: str, digest: str, *, keep: Sequence[str]) -> DataFrame:
    """``corpus`` with the ``keep`` columns of its trace and trace_state: fits, stale (made for another request: its columns are null), or none. Two traces of one key are an error."""
    where = F.concat(F.lit("two traces: "), F.to_json(F.struct(key)))
    one = traces.groupBy(key).agg(F.first(F.struct(digest, *keep)).alias("_t"), F.count("*").alias("_n")).select(key, F.when(F.col("_n") == 1, F.col("_t")).otherwise(F.raise_error(where)).alias("_t"))
    fits = F.col(f"_t.{digest}") == F.sha2(request, 256)
    joined = corpus.join(one, key, "left")
    return joined.select(*corpus.columns, *[F.when(fits, F.col(f"_t.{c}")).alias(c) for c in keep], F.when(F.col("_t").isNull(), "none").when(fits, "fits").otherwise("stale").alias("trace_state"))


def result_class(status: Column, response: Column, keys: Column, *, tolerance: float = 1e-3) -> Column:
    """ok, abstained, unsupported or error. A result that says ok is one only if its answer to q1 has a probability for exactly the option keys, finite, not negative, and of sum 1, or a yes/no number."""
    probs = F.from_json(F.get_json_object(response, "$.answers.q1.probabilities"), "map<string,double>")
    values = F.map_values(probs)
    numbers = ~F.exists(values, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1)) & (F.abs(D.total(values) - 1) <= tolerance)
    exact = (F.size(F.map_keys(probs)) == F.size(keys)) & (F.size(F.array_except(keys, F.map_keys(probs))) == 0)
    yes = F.get_json_object(response, "$.answers.q1.noul").try_cast("double").between(0, 1)
    good = F.coalesce(exact & numbers, F.lit(False)) | F.coalesce(probs.isNull() & yes, F.lit(False))
    return F.when(status.isin("abstained", "unsupported"), status).when((status == "ok") & good, "ok").otherwise("error")


def completion_problem(payload: Column, finishes: Sequence[str] = ("stop", "length", "tool_calls")) -> Column:
    """What is wrong with a completion (JSON text): choices, finish_reason or usage; null for a good one."""
    reason = F.get_json_object(payload, "$.choices[0].finish_reason")
    usage = [F.get_json_object(payload, f"$.usage.{k}").try_cast("long") for k in ("prompt_tokens", "completion_tokens", "total_tokens", "input", "output")]
    used = reduce(lambda a, b: a | b, [F.coalesce(u >= 0, F.lit(False)) for u in usage])
    return F.when(F.coalesce(F.json_array_length(F.get_json_object(payload, "$.choices")), F.lit(0)) < 1, "choices").when(~F.coalesce(reason.isin(*finishes), F.lit(False)), "finish_reason").when(~used, "usage")


def pack_problems(pack: DataFrame, manifest: DataFrame, key: str, place: str, digest: str) -> DataFrame:
    """key and problem of every row of either side that does not fit the other: repeated, missing, extra, moved or changed. A null digest of the manifest fits any."""
    p = pack.groupBy(key).agg(F.count("*").alias("_n"), F.min(place).alias("_at"), F.min(digest).alias("_sha"))
    m = manifest.select(key, F.col(place).alias("_want"), F.col(digest).alias("_wanted"), F.lit(True).alias("_listed"))
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("_listed").isNull(), "extra").when(F.col("_n") > 1, "repeated").when(F.col("_at") != F.col("_want"), "moved").when(F.col("_sha") != F.col("_wanted"), "changed")
    return p.join(m, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def drop_gate(results: DataFrame, group: str, passed: Column, *, most_points: float = 3.0) -> DataFrame:
    """Per group: n, pass_rate, the drop against the rate of all rows in percentage points, and status PASS up to ``most_points``."""
    whole = results.agg(F.avg(passed.cast("double")).alias("_rate"))
    per = results.groupBy(group).agg(F.count("*").alias("n"), F.avg(passed.cast("double")).alias("pass_rate")).crossJoin(F.broadcast(whole))  # one row
    drop = (F.col("_rate") - F.col("pass_rate")) * 100
    return per.select(group, "n", "pass_rate", drop.alias("drop_points"), F.when(drop <= most_points, "PASS").otherwise("FAIL").alias("status"))


def thinking_share(times: DataFrame, group: str, seconds: str, rule_ms: float = 1000.0) -> DataFrame:
    """Per group: mean seconds and the largest share of requests that may take so long for the mean to stay within the rule."""
    per = times.groupBy(group).agg(F.avg(seconds).alias("mean"))
    return per.select(group, "mean", F.when(F.col("mean") <= 0, 1.0).otherwise(F.least(F.lit(1.0), rule_ms / (1000 * F.col("mean")))).alias("share"))


def largest_differences(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], value: str, digits: int = 4) -> DataFrame:
    """How many keys both sides hold and the largest absolute difference of their values, plain and against theirs at ``digits`` digits."""
    both = ours.select(*keys, F.col(value).alias("_a")).join(theirs.select(*keys, F.col(value).alias("_b")), list(keys))
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("largest"), F.max(F.abs(F.round("_a", digits) - F.col("_b"))).alias("largest_rounded"))


def warmup_cosine(step: Column, total: int, warmup_ratio: float) -> Column:
    """Factor of a base rate at a step from 1: a rise over the first share of the steps, then half a cosine down to 0.1."""
    warm = max(1, int(warmup_ratio * total))
    down = 0.1 + 0.45 * (1 + F.cos(F.pi() * (step - warm) / max(1, total - warm)))
    return F.when(step <= warm, step / F.lit(float(warm))).otherwise(down)


def first_by_any_key(rows: DataFrame, order: str, keys: Sequence[str], *, rounds: int = 100) -> DataFrame:
    """The rows that are kept when they come in the order of ``order`` (unique) and one goes that shares any of ``keys`` with a row kept before. Null keys match nothing.

    Instead of one after the other: in each round a row is kept that comes first among the undecided ones in all of its keys, and the undecided
    ones that share a key with it go. As many rounds are needed as kept and dropped rows take turns in depending on each other; more than ``rounds`` is an error.
    """
    from siftara.storage import discard, materialize

    left = materialize(rows.select(order, *keys), "undecided")
    kept = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        firsts = [left.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_first_{k}")) for k in keys]
        marked = reduce(lambda a, b: a.join(b, b.columns[0], "left"), firsts, left)
        wins = reduce(lambda a, b: a & b, [F.col(k).isNull() | (F.col(f"_first_{k}") == F.col(order)) for k in keys])
        now = materialize(marked.where(wins).select(order, *keys), "kept")
        rest = left.join(now.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(now.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
        after = materialize(rest.select(order, *keys), "undecided")
        discard(left)
        left = after
        kept = now.select(order) if kept is None else kept.unionByName(now.select(order))
    else:
        if not left.isEmpty():
            raise RuntimeError(f"rows depend on each other over more than {rounds} rounds")
    return rows.join(kept, order, "left_semi") if kept is not None else rows.limit(0)


def documented_share(rows: DataFrame, unit: str, owner: str, first_owner: str) -> DataFrame:
    """unit and df: how many owners hold it, where of several owners with the same ``first_owner`` value (null: none) only the first counts."""
    w = rows.where(F.col(first_owner).isNotNull()).groupBy(first_owner).agg(F.min(owner).alias("_first"))
    counted = rows.join(w, first_owner, "left").where(F.col("_first").isNull() | (F.col("_first") == F.col(owner)))
    return counted.groupBy(unit).agg(F.count_distinct(owner).alias("df"))


def every_nth(df: DataFrame, turn: Column, step: int) -> DataFrame:
    """The rows at every ``step``-th place, the first included, in the order of ``turn`` (a hex digest, unique). Places are counted by ranges of the digest, so no task sorts all rows."""
    cut = df.withColumn("_turn", turn).withColumn("_range", F.substring("_turn", 1, 3))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # at most 4,096 rows
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_turn")) - 1
    placed = cut.withColumn("_inside", inside).join(F.broadcast(offsets), "_range")
    return placed.where((F.col("_before") + F.col("_inside")) % step == 0).select(*df.columns)

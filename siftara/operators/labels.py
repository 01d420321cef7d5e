"""Labels joined to questions, and several label distributions combined to one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftara.functions import distributions as D


def label_problems(codes: Column, probs: Column, temperature: Column, *, tolerance: float = 1e-3) -> Column:
    """Names of what is wrong with a label row; empty for a good one."""
    bad_number = F.exists(probs, lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p == float("inf")))
    checks = (
        ("codes_missing", codes.isNull() | (F.size(codes) == 0) | F.exists(codes, lambda c: c.isNull() | (c == ""))),
        ("codes_repeated", F.size(F.array_distinct(codes)) < F.size(codes)),
        ("probs_missing", probs.isNull() | (F.size(probs) == 0)),
        ("probs_invalid", bad_number),
        ("probs_sum", ~bad_number & (F.abs(D.total(F.transform(probs, lambda p: p.cast("double"))) - 1) > tolerance)),
        ("lengths_differ", F.size(codes) != F.size(probs)),
        ("temperature_invalid", temperature.isNull() | F.isnan(temperature) | ~(temperature > 0) | (temperature == float("inf"))),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))


def pivot_labels(questions: DataFrame, labels: DataFrame, keys: list[str], teacher: str, value: str) -> DataFrame:
    """``questions`` with ``labels``, a map from teacher to value; an empty map where no teacher labelled the question.

    A label that is repeated alike counts once (NaN equals NaN); labels of one teacher that differ are an error that names the question.
    """
    where = F.concat(F.lit("conflicting labels: "), F.to_json(F.struct(*keys, teacher)))
    one = labels.groupBy(*keys, teacher).agg(F.min(value).alias("_least"), F.max(value).alias("_most"))
    one = one.select(*keys, teacher, F.when(F.col("_least").eqNullSafe(F.col("_most")), F.col("_least")).otherwise(F.raise_error(where)).alias(value))
    per = one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(teacher, value)))).alias("labels"))
    empty = F.create_map().cast(dict(per.dtypes)["labels"])
    return questions.join(per, keys, "left").withColumn("labels", F.coalesce("labels", empty))


def conflicting_labels(labels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that carry more than one different value (NaN equals NaN)."""
    return labels.groupBy(*keys).agg(F.countDistinct(value).alias("values")).where("values > 1")


def _times(w: float) -> Callable[[Column], Column]:
    return lambda x: w * x


def combine(named: Mapping[str, Column], *, method: str = "mean", weights: Mapping[str, float] | None = None, temperatures: Mapping[str, tuple[float, float]] | None = None, missing: str = "renormalize") -> Column:
    """One distribution from several. ``method``: mean, calibrated_mean (powers by ``temperatures`` (stored, wanted) first) or logpool.

    Teachers whose array is null are left out and the weights renormalized, or make the result null with ``missing="drop"``.
    """
    weights = weights or {}
    parts = []
    for name, probs in named.items():
        if method == "calibrated_mean" and temperatures and name in temperatures:
            probs = D.recalibrate(probs, *temperatures[name])
        if method == "logpool":
            probs = F.transform(probs, lambda p: F.ln(F.greatest(p, F.lit(D.FLOOR))))
        parts.append((probs, float(weights.get(name, 1.0))))
    weight = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts[1:]), F.when(parts[0][0].isNotNull(), parts[0][1]).otherwise(0.0))
    size = F.greatest(*[F.size(p) for p, _ in parts]) if len(parts) > 1 else F.size(parts[0][0])
    zero = F.array_repeat(F.lit(0.0), size)
    total = zero
    for probs, w in parts:
        total = F.zip_with(total, F.transform(F.coalesce(probs, zero), _times(w)), lambda a, x: a + x)
    mixed = F.transform(total, lambda x: x / weight)
    out = D.softmax(mixed) if method == "logpool" else D.normalize(mixed)
    if missing == "drop":
        for probs, _ in parts:
            out = F.when(probs.isNotNull(), out)
    return F.when(weight > 0, out)


METHODS = ("single", "mean", "calibrated_mean", "logpool")


@dataclass(frozen=True)
class Recipe:
    """How the labels of a kind of question are combined: by a method, from one teacher or several with weights and temperatures."""

    method: str
    teacher: str | None = None
    teachers: Mapping[str, tuple[float, float | None]] = field(default_factory=dict)

    def problems(self) -> list[str]:
        if self.method not in METHODS:
            return ["method"]
        if self.method == "single":
            return [] if self.teacher else ["teacher"]
        lacking = self.method == "calibrated_mean" and any(t is None for _, t in self.teachers.values())
        return ["teachers"] * (not self.teachers) + ["temperature"] * lacking + ["number"] * any(not x > 0 for w, t in self.teachers.values() for x in (w, t) if x is not None)


def recipes(stated: Mapping[str, object], types: Sequence[str]) -> dict[str, Recipe]:
    """The recipe of each type of question from a stated one with overrides: what an override leaves out it has from the whole, a teacher's weight and temperature included. A wrong or unknown field is an error."""

    def teachers(raw: Mapping[str, Mapping[str, float]], base: Mapping[str, tuple[float, float | None]]) -> dict[str, tuple[float, float | None]]:
        stray = {k for v in raw.values() for k in v} - {"weight", "temperature"}
        if stray:
            raise ValueError(f"unknown fields of a teacher: {sorted(stray)}")
        return {n: (v.get("weight", base.get(n, (1.0, None))[0]), v.get("temperature", base.get(n, (1.0, None))[1])) for n, v in raw.items()}

    overrides = stated.get("by_question_type") or {}
    stray = sorted(set(stated) - {"version", "method", "teacher", "teachers", "by_question_type"}) + sorted(set(overrides) - set(types)) + sorted({k for o in overrides.values() for k in o} - {"method", "teacher", "teachers"})
    if stray:
        raise ValueError(f"unknown fields or types: {stray}")
    whole = Recipe(stated.get("method"), stated.get("teacher"), teachers(stated.get("teachers") or {}, {}))
    out = {}
    for kind in types:
        own = overrides.get(kind, {})
        out[kind] = Recipe(own.get("method", whole.method), own.get("teacher", whole.teacher), teachers(own["teachers"], whole.teachers) if "teachers" in own else whole.teachers)
        if wrong := out[kind].problems():
            raise ValueError(f"{kind}: {wrong}")
    return out


def combine_by_type(kind: Column, named: Mapping[str, Column], stored: Mapping[str, float], by_type: Mapping[str, Recipe], *, missing: str = "renormalize") -> Column:
    """One distribution from several by the recipe of the question's type. ``stored`` are the temperatures the labels were made at. ``missing`` as in ``combine``; error refuses a question that lacks a teacher it needs."""
    out = F.lit(None).cast("array<double>")
    for name, r in by_type.items():
        used = {r.teacher: named[r.teacher]} if r.method == "single" else {t: named[t] for t in r.teachers}
        mixed = combine(used, method="mean" if r.method == "single" else r.method, weights={t: w for t, (w, _) in r.teachers.items()}, temperatures={t: (stored.get(t, 1.0), x) for t, (_, x) in r.teachers.items() if x is not None}, missing="drop" if missing == "error" else missing)
        if missing == "error":
            mixed = F.when(mixed.isNotNull(), mixed).otherwise(F.raise_error(F.lit(f"{name}: a label is missing")).cast("array<double>"))
        out = F.when(kind == name, mixed).otherwise(out)
    return out

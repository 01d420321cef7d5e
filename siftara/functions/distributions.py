"""Arithmetic on probability arrays, inside the engine."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftara.functions.text import let

FLOOR = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalize(values: Column) -> Column:
    """Values over their sum; null where the sum is not positive."""
    return let(values, lambda v: let(total(v), lambda s: F.when(s > 0, F.transform(v, lambda x: x / s))))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Shifted by the maximum; null for an empty array."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return let(F.array_max(logits), lambda top: normalize(F.transform(logits, lambda x: F.exp((x - top) / t))))


def mean_of(views: list[Column]) -> Column:
    """Element-wise mean of arrays of the same length."""
    added = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), views)
    return F.transform(added, lambda x: x / float(len(views)))


def recalibrate(probs: Column, stored: float, wanted: float) -> Column:
    """Probabilities of one temperature as those of another: powers, summing to 1 again; 0 stays 0."""
    return normalize(F.transform(probs, lambda p: F.pow(p, F.lit(stored / wanted))))


def mix_gold(probs: Column, gold: Column, alpha: float) -> Column:
    """``alpha`` on the gold place (from 0) and the rest by ``probs``; ``probs`` alone where gold is null."""
    mixed = F.transform(probs, lambda p, i: alpha * F.when(i == gold, 1.0).otherwise(0.0) + (1 - alpha) * p)
    return F.when(gold.isNull(), probs).otherwise(mixed)


def first_maximum(probs: Column) -> Column:
    """Place (from 0) of the largest value, the first at a tie; null for an empty array."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def tie_credit(probs: Column, gold: Column) -> Column:
    """1 over the number of tied maxima if gold is one of them, else 0."""

    def credit(top: Column) -> Column:
        return F.when(F.get(probs, gold) == top, F.lit(1.0) / F.size(F.filter(probs, lambda p: p == top))).otherwise(0.0)

    return let(F.array_max(probs), credit)


def negative_log(probs: Column, gold: Column) -> Column:
    return -F.ln(F.greatest(F.get(probs, gold), F.lit(FLOOR)))


def brier(probs: Column, gold: Column) -> Column:
    """Squared distance from the certain answer, summed over the options."""
    return total(F.transform(probs, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0))))


def soft_cross_entropy(probs: Column, target: Column) -> Column:
    return total(F.zip_with(probs, target, lambda p, t: -t * F.ln(F.greatest(p, F.lit(FLOOR)))))


def confidence_bin(confidence: Column, bins: int) -> Column:
    """0 to bins - 1; 1.0 belongs to the last."""
    return F.least((confidence * bins).cast("int"), F.lit(bins - 1))


def margin(probs: Column) -> Column:
    """Largest less second largest value; the largest alone for one value."""
    ordered = F.sort_array(probs, asc=False)
    return F.get(ordered, F.lit(0)) - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0))


def variation(a: Column, b: Column) -> Column:
    """Total variation distance of two arrays of the same length."""
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / 2.0


def rotations(values: Column, n: int) -> list[Column]:
    """The array and its rotations by 1 to n - 1."""
    return [values if k == 0 else F.concat(F.slice(values, k + 1, n), F.slice(values, 1, k)) for k in range(n)]


def view_orders(n: int, views: int, *, reverse: bool = True) -> list[list[int]]:
    """Different orders in which a question of ``n`` options is shown: as it is, reversed (unless not wanted), then shifted by even steps; no order twice, so there can be fewer than ``views``."""
    if views < 1:
        raise ValueError("at least one view")
    straight = list(range(n))
    orders = [straight]
    if n > 1 and views > 1:
        orders += [straight[::-1]] if reverse else []
        shifts = [v * n // views for v in range(len(orders), views)]
        orders += [straight[s:] + straight[:s] for s in shifts]
    return list(map(list, dict.fromkeys(map(tuple, orders))))[:views]


def shown_in(values: Column, order: list[int]) -> Column:
    """Values in the order in which they are shown."""
    return F.array(*[F.get(values, F.lit(i)) for i in order])


def average_of_views(views: list[tuple[Column, list[int]]]) -> Column:
    """Mean of the distributions of several views, each brought back to the first order."""
    return mean_of([F.array(*[F.get(v, F.lit(order.index(i))) for i in range(len(order))]) for v, order in views])


def geometric_grid(low: float, high: float, points: int) -> list[float]:
    return [math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / (points - 1)) for i in range(points)]

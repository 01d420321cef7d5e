"""Reading level of documents by gradient-boosted trees over the shape of their prose.

Features describe the distributions of length, vocabulary, syntax and cohesion. The trees are trained on rated
documents; grades are calibrated on predictions that were made without the document's own source.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftara.llm.boosting import BoostedTrees, isotonic
from siftara.llm.prose import letters, sentences

#: Rated documents that a model is trained on at most, the first in a seeded order.
LABEL_ROWS = 20_000
#: Fewest rated documents that a model is trained on.
LEAST_LABELS = 20
#: Fewest rated documents that a small model of single splits, without calibration, is trained on; below it there are no grades.
FEW_LABELS = 6
FOLDS = 5
#: Words and letters from which the features count a sentence and a word as long.
LONG_SENTENCE, LONG_WORD = 17, 10
#: Rating from which a document is of level 4 or 5, and how far from it the border on grades may be put by the held-out grades.
DEMANDING, BORDER_RANGE = 3.5, 0.5
#: Words that join clauses in English, Portuguese and Spanish.
JOINING = frozenset(
    "after although and because before but if often only since so that then though unless until when where whereas which while who antes apenas até ainda como depois e embora enquanto mas nunca onde pois porque quando que se sempre só também ahora aunque cuando donde hasta mientras pero porque pues que si siempre también y".split()
)
FEATURES = (
    "log_words", "log_sentences", "mean_sentence", "sd_sentence", "p90_sentence", "long_sentences",
    "mean_letters", "sd_letters", "long_words", "short_words", "p90_letters", "types", "once", "codes",
    "commas", "joining", "asking", "overlap", "sd_overlap", "echo",
)


def features(text: str | None) -> list[float]:
    """FEATURES of the prose of a text; all 0 where there is none."""
    parts = sentences(text)
    if not parts:
        return [0.0] * len(FEATURES)
    lengths = np.array([len(s) for s in parts], dtype=float)
    plain = [[w.strip("\"'`*.,;:!?()[]«»“”¿¡").lower() for w in s] for s in parts]
    flat = [w for s in plain for w in s]
    sizes = np.array([letters(w) for w in flat], dtype=float)
    counts: dict[str, int] = {}
    for w in flat:
        counts[w] = counts.get(w, 0) + 1
    telling = [{w for w in s if len(w) > 4} for s in plain]
    shared = np.array([len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(telling, telling[1:])] or [0.0])
    n = len(flat)
    return [
        float(np.log1p(n)), float(np.log1p(len(parts))), float(lengths.mean()), float(lengths.std()), _p90(lengths), float((lengths > LONG_SENTENCE).mean()),
        float(sizes.mean()), float(sizes.std()), float((sizes >= LONG_WORD).mean()), float((sizes <= 3).mean()), _p90(sizes), len(counts) / n, sum(c == 1 for c in counts.values()) / n, sum("_" in w or "(" in w for w in flat) / n,
        sum(w.endswith(",") for s in parts for w in s) / len(parts), sum(w in JOINING for w in flat) / n, sum(s[-1].endswith("?") for s in parts) / len(parts),
        float(shared.mean()), float(shared.std()), sum(c - 1 for w, c in counts.items() if len(w) > 4) / n,
    ]


def _p90(values: np.ndarray) -> float:
    return float(np.partition(values, k := int(0.9 * (len(values) - 1)))[k])


def _fold(source: str | None) -> int:
    return zlib.crc32((source or "").encode()) % FOLDS


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["source", "level", "features"])


def _small_trees(rows: int) -> BoostedTrees:
    return BoostedTrees(trees=40, depth=1, least_rows=max(1, rows // 4))


class LevelModel:
    """Trees with a calibration; ``held_out`` has source, rated level and the calibrated grade predicted without that source's fold.

    With fewer than LEAST_LABELS rows the model is ``small``: single splits, whose predictions are the grades, kept to 1 to 5.
    ``border`` is the grade from which a document counts as of level 4 or 5.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, sources: Sequence[str | None]):
        folds = np.array([_fold(s) for s in sources])
        out = np.full(len(y), float(y.mean()))
        self.small = len(y) < LEAST_LABELS
        if self.small:
            for k in range(FOLDS):
                if (folds == k).any() and (folds != k).any():
                    out[folds == k] = _small_trees(int((folds != k).sum())).fit(x[folds != k], y[folds != k]).predict(x[folds == k])
            self.knots = np.array([1.0, 5.0]), np.array([1.0, 5.0])
            self.held_out = list(zip(sources, y.tolist(), np.interp(out, *self.knots).tolist()))
            self.border = DEMANDING
            self.trees = _small_trees(len(y)).fit(x, y)
            return
        for k in range(FOLDS):
            if (folds == k).any() and (folds != k).sum() >= LEAST_LABELS:
                out[folds == k] = BoostedTrees().fit(x[folds != k], y[folds != k]).predict(x[folds == k])
        grades = np.empty(len(y))
        for k in range(FOLDS):  # calibrated by the other folds as well
            others = folds != k
            if (folds == k).any():
                grades[folds == k] = np.interp(out[folds == k], *(isotonic(out[others], y[others]) if others.any() else isotonic(out, y)))
        self.held_out = list(zip(sources, y.tolist(), grades.tolist()))
        self.border = border(grades, y)
        self.knots = isotonic(out, y)
        self.trees = BoostedTrees().fit(x, y)

    def grade(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.predict(x), *self.knots)


def border(grades: np.ndarray, y: np.ndarray) -> float:
    """The grade that parts held-out grades of ratings from DEMANDING on from the others: the one nearest to DEMANDING whose mistakes are within one standard error of the fewest."""
    tried = DEMANDING + np.linspace(-BORDER_RANGE, BORDER_RANGE, 21)
    wrong = ((grades[None, :] >= tried[:, None]) != (y >= DEMANDING)[None, :]).sum(axis=1)
    good = tried[wrong <= wrong.min() + np.sqrt(wrong.min())]
    return float(good[np.argmin(np.abs(good - DEMANDING))])


def train(documents: DataFrame, labels: DataFrame) -> LevelModel | None:
    """A model from at most LABEL_ROWS rated documents; a small one where fewer than LEAST_LABELS have a rating, None where fewer than FEW_LABELS have.

    The level of a document is the mean of its ratings; null ratings, ratings of unknown documents and of null doc_id are left out.
    """
    rated = labels.where("level is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("level").alias("level"))
    chosen = rated.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(LABEL_ROWS)
    rows = documents.select("text", "source", "doc_id").join(F.broadcast(chosen), "doc_id").select("text", "source", "level")
    got = rows.mapInArrow(_feature_rows, "source string, level double, features array<double>").toPandas()
    if len(got) < FEW_LABELS:
        warnings.warn(f"{len(got)} rated documents are too few for a model: no document gets a grade", stacklevel=2)
        return None
    got["at"] = [tuple(x) for x in got["features"]]
    got = got.sort_values(["level", "at"], kind="stable")  # the same model in whatever order the rows come
    return LevelModel(np.array(got["features"].tolist()), got["level"].to_numpy(), got["source"].tolist())


def grade_documents(documents: DataFrame, model: LevelModel | None, *keep: str) -> DataFrame:
    """The columns ``keep`` with grade (calibrated, 1 to 5), level (rounded) and demanding (whether the grade reaches the model's border) of every document.

    Without a model, or without prose, grade and level are null and demanding is false.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = np.array([features(t) for t in batch.column(0).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            grades = own.grade(x) if own is not None and len(x) else np.full(len(x), np.nan)
            none = (x[:, 0] == 0) | np.isnan(grades)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(grades, pa.float64(), mask=none)], [*keep, "grade"])

    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "grade double"])
    graded = documents.select("text", *[f"`{c}`" for c in keep]).mapInArrow(grade, schema)
    reaches = F.col("grade") >= (model.border if model is not None else DEMANDING)
    return graded.withColumn("level", F.round("grade").cast("int")).withColumn("demanding", F.coalesce(reaches, F.lit(False)))


def validation(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source: rated documents, mean absolute error and bias of held-out grades, the share within one level, and how many are rated demanding, graded so, and both."""
    model = train(documents, labels)
    rows = documents.sparkSession.createDataFrame(model.held_out if model else [], "source string, rated double, grade double")
    error = F.col("grade") - F.col("rated")
    true, said = F.col("rated") >= DEMANDING, F.col("grade") >= (model.border if model else DEMANDING)
    return rows.groupBy("source").agg(
        F.count("*").alias("rated"), F.avg(F.abs(error)).alias("mean_error"), F.avg(error).alias("bias"), F.avg((F.abs(error) <= 1).cast("double")).alias("within_one"),
        F.count_if(true).alias("rated_demanding"), F.count_if(said).alias("graded_demanding"), F.count_if(true & said).alias("both"),
    )

"""Screening a corpus against reference texts by units: whole texts, lines, short lines and windows of words.

Units of the reference that occur in more than ``max_df`` of its texts are boilerplate and count for nothing. Of several
rules that apply to a row the first in RULES is its reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftara.functions import text as T
from siftara.skew import broadcast_checked

RULES = ("canary", "exact", "line", "short_line", "ngram")
WINDOW, MAX_DF, LINE_WORDS = 13, 20, 5


@dataclass(frozen=True)
class Screen:
    """Parameters; ``folded`` uses NFKC and case folding instead of plain lower case."""

    n: int = WINDOW
    max_df: int = MAX_DF
    line_words: int = LINE_WORDS
    folded: bool = False

    def units(self, text: Column) -> Column:
        """Array of (rule, unit, place, line) of a text; places count lines from 1, and 0 is the whole text. Words across line ends make no window."""
        whole = F.struct(F.lit("exact").alias("rule"), F.array_join(T.words(text, folded=self.folded), " ").alias("unit"), F.lit(0).alias("place"), F.substring(text, 1, 120).alias("line"))

        def of_line(line: Column, at: Column) -> Column:
            words = F.regexp_extract_all(line, F.lit(f"({T.WORD})"), 1) if self.folded else T.words(line)
            return T.let(words, lambda own: T.let(F.array_join(own, " "), lambda joined: of_words(line, at, own, joined)))

        def of_words(line: Column, at: Column, words: Column, joined: Column) -> Column:
            long_ = F.size(words) >= self.line_words
            short = ~long_ & T.has_letters(joined) & ~T.is_marker(line)
            unit = lambda rule, value: F.struct(F.lit(rule).alias("rule"), value.alias("unit"), (at + 1).alias("place"), F.substring(line, 1, 120).alias("line"))
            grams = F.transform(T.windows(words, self.n), lambda g: unit("ngram", g))
            own = F.when(long_, F.array(unit("line", joined))).when(short, F.array(unit("short_line", joined))).otherwise(F.array().cast(grams_type))
            return F.concat(own, grams)

        grams_type = "array<struct<rule:string,unit:string,place:int,line:string>>"
        base = T.fold(text) if self.folded else text
        every = F.flatten(F.transform(T.lines(base), of_line))
        return F.concat(F.array(whole), every)

    def index(self, reference: DataFrame, key: str, text: str) -> DataFrame:
        """rule, unit, df (reference texts that hold it) and ref_id (the smallest of them) of every unit of the reference; empty texts have none."""
        rows = reference.select(F.col(key).alias("ref_id"), F.explode(self.units(F.col(text))).alias("u")).select("ref_id", "u.rule", "u.unit").where("unit <> ''")
        return rows.distinct().groupBy("rule", "unit").agg(F.count("*").alias("df"), F.min("ref_id").alias("ref_id"))

    def kept(self, index: DataFrame) -> DataFrame:
        """Units that screen: whole texts always, others up to max_df."""
        return index.where((F.col("rule") == "exact") | (F.col("df") <= self.max_df))

    def matches(self, corpus: DataFrame, key: str, text: str, kept: DataFrame) -> DataFrame:
        """key, rule, place, line, unit, ref_id of every unit of the corpus that screens.

        The reference is broadcast when it is small, so the exploded corpus is never shuffled then.
        """
        rows = corpus.select(F.col(key), F.explode(self.units(F.col(text))).alias("u")).select(key, "u.*").where("unit <> ''")
        return rows.join(broadcast_checked(kept.select("rule", "unit", "ref_id")), ["rule", "unit"])

    def verdicts(self, corpus: DataFrame, key: str, text: str, kept: DataFrame) -> DataFrame:
        """key, reason, hits (units that matched by that rule), detail (their first line), ref_id, of every row that is rejected."""
        order = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule")).cast("int")
        found = self.matches(corpus, key, text, kept).select(key, order.alias("rank"), "place", "line", "ref_id")
        canary = corpus.where(T.has_canary(F.col(text), folded=self.folded)).select(key, F.lit(1).alias("rank"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("line"), F.lit(None).cast(dict(kept.dtypes)["ref_id"]).alias("ref_id"))
        each = found.unionByName(canary).groupBy(key, "rank").agg(F.count("*").alias("hits"), F.min(F.struct("place", "line", "ref_id")).alias("first"))
        best = each.groupBy(key).agg(F.min(F.struct("rank", "hits", "first")).alias("b"))
        names = F.array(*[F.lit(r) for r in RULES])
        return best.select(key, F.element_at(names, F.col("b.rank")).alias("reason"), F.col("b.hits").alias("hits"), F.col("b.first.line").alias("detail"), F.col("b.first.ref_id").alias("ref_id"))

    def split(self, corpus: DataFrame, key: str, text: str, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Clean rows, and rejected rows with their reason."""
        bad = self.verdicts(corpus, key, text, kept)
        return corpus.join(bad, key, "left_anti"), corpus.join(bad, key)


def shared_windows(corpus: DataFrame, key: str, text: str, reference: DataFrame, ref_key: str, ref_text: str, n: int = WINDOW) -> DataFrame:
    """key, ref key and the number of different windows of n words that both whole texts hold."""
    left = corpus.select(key, F.explode(T.window_set(F.col(text), n)).alias("gram"))
    right = reference.select(F.col(ref_key).alias("ref_id"), F.explode(T.window_set(F.col(ref_text), n)).alias("gram"))
    return left.join(broadcast_checked(right), "gram").groupBy(key, "ref_id").agg(F.count("*").alias("shared"), F.slice(F.array_sort(F.collect_set("gram")), 1, 3).alias("examples"))

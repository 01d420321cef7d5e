"""Records of evaluation splits that also stand, whole or reworked, in the training split.

The normalised lines of the evaluation records are the passages. They are sharded by hash; each shard is one Aho-Corasick
automaton, and every automaton scans all training texts, each normalised and whole. A pair that meets often enough is then
measured: an automaton over all lines of the evaluation record scans the training record, and the matched intervals are
merged into the covered part of the evaluation record.

Only rare lines are passages of the first scan: of a record of n lines of which m must be found again, the n - m + j rarest
hold j of those m, so a pair that does not meet in j of them is none. Records with the same set of lines are one class
and records that are alike in everything that counts are one kind until the end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import md5

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftara.skew import broadcast_checked, heavy_keys, salted_join, split_join
from siftara.storage import materialize

SHARED = 0.6
#: Rare lines in which a pair has to meet before it is measured, where the record has so many.
MEET = 3
SEARCH_LINES = 3
#: Characters of passages in one automaton; it takes about 20 bytes for each.
SHARD_CHARS = 4_000_000
#: Automata that all training texts are scanned with. With more passages than they hold, the lines of the training texts are joined to the passages instead: the pairs are the same, and the work no longer grows with the product of both sides.
MOST_SHARDS = 8
#: Characters of training lines that one task scans at least: an automaton is built once for them.
TASK_CHARS = 16_000_000
#: Evaluation records that a line may be a passage of beside those that it must be for.
COMMON = 100
#: Classes (of 16 bytes each) up to which their list is broadcast to thin out the lines before they are shuffled.
BROADCAST_CLASSES = 500_000


_DOCSTRING = re.compile(r"(?m)^[ \t]*[rubf]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')")
_COMMENT = re.compile(r"""^((?:[^#"'\n]|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')*+)#.*$""", re.M)


def plain_lines(code: str | None) -> list[str]:
    """Distinct lines without whitespace, letter case, comments, docstring lines and empty lines."""
    code = (code or "").lower()
    if "\r" in code:
        code = code.replace("\r\n", "\n").replace("\r", "\n")
    code = _DOCSTRING.sub("", code)
    if "#" in code:
        code = _COMMENT.sub(r"\1", code)
    return [x for x in dict.fromkeys("".join(line.split()) for line in code.split("\n")) if x]


def search_key(block: str | None) -> bytes | None:
    """Hash of a search block without whitespace and letter case; None unless it has SEARCH_LINES non-empty lines."""
    if block is None or sum(1 for x in block.splitlines() if x.strip()) < SEARCH_LINES:
        return None
    return md5("".join(block.lower().split()).encode()).digest()


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns that are kept, whether the original is lost, the search key, and the lines with the hash of their set."""
    for batch in batches:
        originals, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lines = [plain_lines(t) for t in originals]
        sets = [md5("\n".join(sorted(x)).encode()).digest() if x else None for x in lines]
        lost = [t is None or not t.strip() for t in originals]
        columns = [*batch.columns[2:], pa.array(lost, pa.bool_()), pa.array(map(search_key, blocks), pa.binary()), pa.array(sets, pa.binary()), pa.array(lines, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[2:], "lost", "search_key", "class_id", "lines"])


def least_shared(n: int) -> int:
    """Lines of a record of ``n`` lines that are in both when at least SHARED of the lines of either record are."""
    return math.ceil(SHARED * n - 1e-9)


def _rare_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class_id, n, need, line: the rarest lines of each evaluation class, and in how many of them a pair has to meet.

    Lines come with the number of evaluation classes that hold them. Where the n - m + 1 lines that must be there are followed
    by lines of more than COMMON classes, those stay out and fewer meetings are asked for.
    """
    for batch in batches:
        rows, sizes, needs, chosen = [], [], [], []
        for k, own in enumerate(batch.column(1).to_pylist()):
            own.sort(key=lambda x: (x["often"], x["line"]))
            n, m = len(own), least_shared(len(own))
            need = max((j for j in range(2, min(MEET, m) + 1) if own[n - m + j - 1]["often"] <= COMMON), default=1)
            first = own[: n - m + need]
            rows += [k] * len(first)
            sizes += [n] * len(first)
            needs += [need] * len(first)
            chosen += [x["line"] for x in first]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), pa.array(chosen, pa.string())], ["eval_class", "eval_n", "need", "line"])


def automaton_of(passages: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    """Finds whole lines in a text that begins and ends with a line end."""
    automaton = ahocorasick.Automaton()
    for line, value in passages:
        automaton.add_word(f"\n{line}\n", value)
    if len(automaton):
        automaton.make_automaton()
    return automaton


def _scan(texts: DataFrame, passages: list[tuple[str, int]]) -> DataFrame:
    """train_class, train_n, mark: where the passages of one shard stand in the whole training texts."""
    shared = texts.sparkSession.sparkContext.broadcast(passages)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value)
        for batch in batches:
            lists = batch.column(1)
            rows, marks = [], []
            for k, lines in enumerate(lists.to_pylist()):
                for _, mark in automaton.iter("\n" + "\n".join(lines) + "\n"):
                    rows.append(k)
                    marks.append(mark)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), lists.value_lengths().take(at), pa.array(marks, pa.int64())], ["train_class", "train_n", "mark"])

    return texts.mapInArrow(scan, "train_class binary, train_n int, mark long")


def _placed(lines: list[str]) -> list[tuple[str, tuple[int, int]]]:
    """The lines of a record with the interval of characters that each takes up in it."""
    ends = np.cumsum([len(x) for x in lines]).tolist()
    return [(line, (end - len(line), end)) for line, end in zip(lines, ends)]


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the intervals of the evaluation record that the training record holds; rows of one evaluation record come together."""
    last, automaton, total, own = None, None, 0, []
    for batch in batches:
        eval_id, train_id, eval_lines, train_lines = (batch.column(i) for i in range(4))
        ids = eval_id.to_pylist()
        covered, shared, own_sizes, sizes = [], [], [], []
        for k, e in enumerate(ids):
            if e != last:
                own = _placed(eval_lines[k].as_py())
                automaton, last, total = automaton_of(own), e, own[-1][1][1]
            lines = train_lines[k].as_py()
            intervals = sorted({x for _, x in automaton.iter("\n" + "\n".join(lines) + "\n")})
            end = chars = 0
            for a, b in intervals:
                chars += max(0, b - max(a, end))
                end = max(end, b)
            covered.append(chars / total)
            shared.append(len(intervals))
            own_sizes.append(len(own))
            sizes.append(len(lines))
        yield pa.RecordBatch.from_arrays([eval_id, train_id, pa.array(covered, pa.float64()), pa.array(shared, pa.int32()), pa.array(own_sizes, pa.int32()), pa.array(sizes, pa.int32())], ["eval_class", "train_class", "coverage", "shared", "eval_lines", "train_lines"])


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merged intervals of each evaluation record that its training records hold. Rows come sorted by evaluation record; one with no interval has one row of no characters.

    Passages are whole lines, each once in a record, so two intervals are the same or apart and merging them leaves each once.
    """
    last, automaton, total, seen = None, None, 0, set()
    for batch in batches:
        eval_id, eval_class, eval_lines, train_lines = (batch.column(i) for i in range(4))
        rows, starts, chars, totals = [], [], [], []
        for k, (e, c) in enumerate(zip(eval_id.to_pylist(), eval_class.to_pylist())):
            if (e, c) != last:
                if last is None or c != last[1]:
                    own = _placed(eval_lines[k].as_py())
                    automaton, total = automaton_of(own), own[-1][1][1]
                last, seen = (e, c), {(0, 0)}
                found = [(0, 0)]
            else:
                found = []
            found += sorted({x for _, x in automaton.iter("\n" + "\n".join(train_lines[k].as_py()) + "\n")} - seen)
            seen.update(found)
            rows += [k] * len(found)
            starts += [a for a, _ in found]
            chars += [b - a for a, b in found]
            totals += [total] * len(found)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([eval_id.take(at), eval_class.take(at), pa.array(starts, pa.int32()), pa.array(chars, pa.int32()), pa.array(totals, pa.int32())], ["eval_kind", "eval_class", "start", "chars", "total"])


class SplitOverlap:
    """Overlaps between the training split of ``cases`` and its other splits.

    Columns read: case_id, case_key, original, search, source, split. A pair is in three ways an overlap: the same
    case_key (nulls match nothing); at least SHARED of the lines of either original are in both; or one has no original
    (null or without any line character) and the search blocks of at least three lines agree. Records whose split is null take
    no part; an original of comments only has no lines and overlaps nothing by lines. Repeated rows stay rows of their
    own and give the pair once.
    """

    SIGNS = ("case_key", "source", "split", "evaluation", "lost", "search_key", "class_id")

    def __init__(self, cases: DataFrame, *, train: str = "train"):
        kinds = dict(cases.dtypes)
        rows = cases.where("split is not null").select("original", "search", "case_id", "case_key", "source", "split", (F.col("split") != train).alias("evaluation"))
        schema = f"case_id {kinds['case_id']}, case_key {kinds['case_key']}, source {kinds['source']}, split string, evaluation boolean, lost boolean, search_key binary, class_id binary, lines array<string>"
        kind = F.unhex(F.md5(F.to_json(F.struct(*self.SIGNS))))
        self.rows = materialize(rows.mapInArrow(_normalise, schema).withColumn("kind", kind), "overlap-rows")
        #: one row for each kind of record: what it is compared by, and how many records are of it
        signs = self.rows.groupBy("kind").agg(*[F.first(c).alias(c) for c in self.SIGNS], F.count("*").alias("n"))
        self.kinds = materialize(signs, "overlap-kinds")
        held = self.rows.where("class_id is not null").groupBy("class_id", "evaluation").agg(F.count("*").alias("n"), F.min("case_id").alias("first"))
        held = materialize(held, "overlap-classes")
        # the first record stands for its class; the list of the others is broadcast while it is small
        lines = self.rows.where("class_id is not null").select("case_id", "class_id", "evaluation", "lines")
        twice = held.where("n > 1").select("class_id", "evaluation", "first")
        others = lines.drop("lines").join(broadcast_checked(twice, BROADCAST_CLASSES), ["class_id", "evaluation"]).where("case_id > first").select("case_id")
        alone = lines.join(broadcast_checked(others, BROADCAST_CLASSES), "case_id", "left_anti").drop("case_id")
        #: lines by class; rows that repeat a case_id can repeat their class here
        self.classes = {e: materialize(alone.where(F.col("evaluation") == e).select(F.col("class_id").alias(f"{name}_class"), F.col("lines").alias(f"{name}_text")), f"overlap-{name}") for e, name in ((False, "train"), (True, "eval"))}

    def passages(self) -> DataFrame:
        """eval_class, eval_n, need, line and mark of the rare lines of the evaluation classes."""
        lines = self.classes[True].dropDuplicates(["eval_class"]).select("eval_class", F.explode("eval_text").alias("line"))
        marked = lines.withColumn("mark", F.xxhash64("line"))
        often = marked.groupBy("mark").agg(F.count("*").alias("often")).where("often > 1")
        often = materialize(often, "overlap-often")
        heavy = heavy_keys(often, ["mark"], "often")
        counted = split_join(marked, often, heavy, ["mark"], "left").groupBy("eval_class").agg(F.collect_list(F.struct("line", F.coalesce("often", F.lit(1)).alias("often"))).alias("own"))  # as long as one record
        return counted.mapInArrow(_rare_lines, "eval_class binary, eval_n int, need int, line string").withColumn("mark", F.xxhash64("line"))

    def hits(self, passages: DataFrame) -> DataFrame:
        """train_class, train_n, mark: every passage in every training class."""
        train = self.classes[False]
        distinct = materialize(passages.select("mark", "line").dropDuplicates(["mark"]), "overlap-passages")
        total = distinct.agg(F.sum(F.length("line"))).first()[0] or 0
        shards = -(-total // SHARD_CHARS)
        if shards > MOST_SHARDS:
            marks = train.select("train_class", F.size("train_text").alias("train_n"), F.explode(F.transform("train_text", lambda x: F.xxhash64(x))).alias("mark"))
            return marks.join(distinct.select("mark"), "mark", "left_semi").select("train_class", "train_n", "mark")
        chars = train.agg(F.sum(F.aggregate("train_text", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))).first()[0] or 0
        scans = []
        for shard in range(shards):
            held = [(r["line"], r["mark"]) for r in distinct.where(F.pmod("mark", F.lit(shards)) == shard).select("line", "mark").collect()]  # at most about SHARD_CHARS
            cores = train.sparkSession.sparkContext.defaultParallelism
            scans.append(_scan(train.coalesce(max(-(-cores // shards), -(-chars // TASK_CHARS))), held))
        return reduce(DataFrame.unionByName, scans) if scans else self.classes[False].select("train_class", F.size("train_text").alias("train_n"), F.lit(0).cast("long").alias("mark")).limit(0)

    def class_pairs(self) -> DataFrame:
        """eval_class, train_class, coverage of the evaluation record: one row for each pair of different line sets, and of equal ones, that overlap."""
        rare = materialize(self.passages(), "overlap-rare")
        hits = self.hits(rare)
        postings = rare.select("mark", "eval_class", "eval_n", "need")
        often = heavy_keys(postings.groupBy("mark").agg(F.count("*").alias("n")), ["mark"], "n")
        met = salted_join(hits, postings, often, ["mark"]).where(F.least("train_n", "eval_n") >= F.greatest("train_n", "eval_n") * SHARED)
        # a repeated training row repeats its hits, so that places are counted once
        pairs = met.groupBy("eval_class", "train_class").agg(F.count_distinct("mark").alias("met"), F.max("need").alias("need")).where("met >= need").select("eval_class", "train_class")
        pairs = materialize(pairs, "overlap-pairs")
        busy = [materialize(heavy_keys(pairs.groupBy(c).agg(F.count("*").alias("n")), [c], "n"), "overlap-busy") for c in ("eval_class", "train_class")]

        def side(evaluation: bool, name: str) -> DataFrame:
            """Lines of the classes that are in a pair; the others leave before the shuffle where the list of the paired ones is small."""
            return self.classes[evaluation].join(broadcast_checked(pairs.select(f"{name}_class").distinct(), BROADCAST_CLASSES), f"{name}_class", "left_semi").dropDuplicates([f"{name}_class"])

        texts = split_join(split_join(pairs, side(False, "train"), busy[1], ["train_class"]), side(True, "eval"), busy[0], ["eval_class"])
        covered = texts.sortWithinPartitions("eval_class").select("eval_class", "train_class", "eval_text", "train_text").mapInArrow(_cover, "eval_class binary, train_class binary, coverage double, shared int, eval_lines int, train_lines int")
        return materialize(covered.where(F.col("shared") >= SHARED * (F.col("eval_lines") + F.col("train_lines") - F.col("shared"))).select("eval_class", "train_class", "coverage"), "overlap-class-pairs")

    def _equal(self, column: str, left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of a training and an evaluation kind with the same value in ``column``."""
        n = self.kinds.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        heavy = heavy_keys(n, [column], "n")
        return salted_join(left.where(F.col(column).isNotNull()).select(column, F.col("kind").alias("train_kind")), right.where(F.col(column).isNotNull()).select(column, F.col("kind").alias("eval_kind")), heavy, [column]).select("train_kind", "eval_kind")

    def kind_pairs(self) -> DataFrame:
        """train_kind, eval_kind of every overlapping pair of kinds, each once."""
        train, other = self.kinds.where("not evaluation"), self.kinds.where("evaluation")
        by_key = self._equal("case_key", train, other)
        by_search = [self._equal("search_key", train.where("lost"), other), self._equal("search_key", train.where("not lost"), other.where("lost"))]
        classes = self.class_pairs()
        busy = heavy_keys(self.kinds.where("class_id is not null").groupBy("class_id").agg(F.count("*").alias("n")), ["class_id"], "n")
        member = lambda rows, name: rows.where("class_id is not null").select(F.col("class_id").alias(f"{name}_class"), F.col("kind").alias(f"{name}_kind"))
        hot = lambda name: busy.select(F.col("class_id").alias(f"{name}_class"))
        by_lines = salted_join(member(train, "train"), classes.drop("coverage"), hot("train"), ["train_class"])
        by_lines = salted_join(member(other, "eval"), by_lines, hot("eval"), ["eval_class"]).select("train_kind", "eval_kind")
        return materialize(reduce(DataFrame.unionByName, [by_key, *by_search, by_lines]).distinct(), "overlap-kind-pairs")

    def pairs(self) -> DataFrame:
        """train_id, eval_id of every overlapping pair of records, each once."""
        found = self.kind_pairs()
        heavy = heavy_keys(self.kinds, ["kind"], "n")
        member = lambda evaluation, name: self.rows.where(F.col("evaluation") == evaluation).select(F.col("kind").alias(f"{name}_kind"), F.col("case_id").alias(f"{name}_id"))
        hot = lambda name: heavy.select(F.col("kind").alias(f"{name}_kind"))
        both = salted_join(member(False, "train"), found, hot("train"), ["train_kind"])
        return salted_join(member(True, "eval"), both, hot("eval"), ["eval_kind"]).select("train_id", "eval_id").distinct()

    def coverage(self, found: DataFrame) -> DataFrame:
        """eval_kind, coverage: the share of the line characters of an evaluation record that its partners in ``found`` hold, all of them together.

        Kinds without lines, and kinds whose partners all have none, have no row.
        """
        busy = lambda rows, key: heavy_keys(rows.groupBy(key).agg(F.count("*").alias("n")), [key], "n")
        own = lambda name: self.kinds.where("class_id is not null").select(F.col("kind").alias(f"{name}_kind"), F.col("class_id").alias(f"{name}_class"))
        text = lambda evaluation, name: self.classes[evaluation].dropDuplicates([f"{name}_class"])
        met = split_join(split_join(found, own("train"), busy(found, "train_kind"), ["train_kind"]), own("eval"), busy(found, "eval_kind"), ["eval_kind"])
        met = materialize(met.select("eval_kind", "eval_class", "train_class").distinct(), "overlap-met")
        texts = split_join(split_join(met, text(False, "train"), busy(met, "train_class"), ["train_class"]), text(True, "eval"), busy(met, "eval_class"), ["eval_class"])
        intervals = texts.select("eval_kind", "eval_class", "eval_text", "train_text").sortWithinPartitions("eval_class", "eval_kind").mapInArrow(_intervals, "eval_kind binary, eval_class binary, start int, chars int, total int")
        merged = intervals.groupBy("eval_kind", "start", "chars").agg(F.max("total").alias("total"))
        return merged.groupBy("eval_kind").agg((F.sum("chars") / F.max("total")).alias("coverage"))

    def _partners(self, found: DataFrame) -> DataFrame:
        """train_kind, eval_kind, train_source and n, the number of training records that are a partner."""
        busy = heavy_keys(found.groupBy("train_kind").agg(F.count("*").alias("k")), ["train_kind"], "k")
        origin = self.kinds.where("not evaluation").select(F.col("kind").alias("train_kind"), F.col("source").alias("train_source"), "n")
        return split_join(found, origin, busy, ["train_kind"])

    def covered(self) -> DataFrame:
        """eval_id, split, source, partners, coverage of every evaluation record that overlaps; coverage is null where no lines of it were compared. Partners are rows of the training split."""
        found = self.kind_pairs()
        n = self._partners(found).groupBy("eval_kind").agg(F.sum("n").alias("partners")).join(self.coverage(found), "eval_kind", "left")
        other = self.rows.where("evaluation").select(F.col("kind").alias("eval_kind"), F.col("case_id").alias("eval_id"), "split", "source")
        return split_join(other, n, heavy_keys(self.kinds, ["kind"], "n").withColumnRenamed("kind", "eval_kind"), ["eval_kind"]).drop("eval_kind")

    def report(self) -> DataFrame:
        """Per split and source of the evaluation records: records, how many overlap, how many pairs, and the last two for each training source.

        Pairs are counted by the sizes of the kinds, not listed. mean_coverage is the mean over the overlapping records of what all their
        partners together hold of their lines; records without compared lines are not in it. A record that overlaps with several training
        sources counts in each of them, so they may add up to more than ``overlapping``.
        """
        found = self.kind_pairs()
        partners = self._partners(found)
        n = partners.groupBy("eval_kind").agg(F.sum("n").alias("partners")).join(self.coverage(found), "eval_kind", "left")
        other = self.kinds.where("evaluation").select(F.col("kind").alias("eval_kind"), "split", "source", F.col("n").alias("own"))
        own, met = F.col("own"), F.col("partners").isNotNull()
        mean = F.sum(own * F.col("coverage")) / F.sum(F.when(F.col("coverage").isNotNull(), own))
        whole = other.join(n, "eval_kind", "left").groupBy("split", "source").agg(F.sum("own").alias("records"), F.coalesce(F.sum(F.when(met, own)), F.lit(0)).alias("overlapping"), F.coalesce(F.sum(own * F.col("partners")), F.lit(0)).alias("pairs"), mean.alias("mean_coverage"))
        each = partners.groupBy("eval_kind", "train_source").agg(F.sum("n").alias("partners"))
        each = other.join(each, "eval_kind").groupBy("split", "source", "train_source").agg(F.sum("own").alias("overlapping"), F.sum(own * F.col("partners")).alias("pairs"))
        listed = each.groupBy(F.col("split").alias("_split"), F.col("source").alias("_source")).agg(F.array_sort(F.collect_list(F.struct("train_source", "overlapping", "pairs"))).alias("train_sources"))
        joined = whole.join(listed, F.col("split").eqNullSafe(F.col("_split")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_split", "_source")
        return joined.withColumn("train_sources", F.coalesce("train_sources", F.array().cast(dict(listed.dtypes)["train_sources"])))

"""Queries of the operators for training data and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftara.llm import grouped_splits, leakage, mixing, overlap, packing, reading_level, token_budget
from siftara.llm.names import plain_lang
from siftara.llm.tokens import MANY_LANGUAGES
from siftara.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training record and a held-out one that are the same or nearly so."""
    pairs = overlap.SplitOverlap(table(spark, folder, "cases")).pairs()
    return pairs.select(F.least("train_id", "eval_id").alias("case_id_a"), F.greatest("train_id", "eval_id").alias("case_id_b"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps per split and source of the held-out records, and for each training source."""
    return overlap.SplitOverlap(table(spark, folder, "cases")).report()


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out records that overlap, with the share of their lines that all their training records together hold."""
    return overlap.SplitOverlap(table(spark, folder, "cases")).covered()


def _mixture(spark: SparkSession, folder: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, folder, "items"), table(spark, folder, "sources"), table(spark, folder, "mix_targets"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return _mixture(spark, folder).short_sources()


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source in every mix."""
    return _mixture(spark, folder).shares


def p2_selection(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen examples with their copies."""
    return _mixture(spark, folder).select()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Requests whose proxy_tokens cannot be trusted, so that their tokens were estimated."""
    ledger = token_budget.TokenLedger()
    ledger.advance(table(spark, folder, "items"), table(spark, folder, "sources"))
    return ledger.last.where("not trusted and tokens is not null").select("run_id")


def p3_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens by source, language and track, with all subtotals."""
    ledger = token_budget.TokenLedger()
    ledger.advance(table(spark, folder, "items"), table(spark, folder, "sources"))
    return token_budget.roll_up(ledger.cube)


def p3_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Delta of the budget by the rows that were ingested more than a day after they were made, encoded as they come."""
    items, sources = table(spark, folder, "items"), table(spark, folder, "sources")
    ledger = token_budget.TokenLedger()
    ledger.advance(items.where("ingested_at <= created_at + interval 1 day"), sources)
    return ledger.advance(items, sources)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose own group is not the root group of what they are linked to."""
    return grouped_splits.GroupedSplits(table(spark, folder, "cases")).moved()


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every record."""
    return grouped_splits.GroupedSplits(table(spark, folder, "cases")).assign()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents larger than a container."""
    return packing.oversize(packing.pack(table(spark, folder, "documents"), tokenizer=MANY_LANGUAGES))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every piece."""
    return packing.pack(table(spark, folder, "documents"), tokenizer=MANY_LANGUAGES)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "bench_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of a test item, with the item."""
    return _leaks(spark, folder).select("item_id", "doc_id").distinct()


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every test item with the number of documents that hold a passage of it."""
    n = _leaks(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))
    items = table(spark, folder, "bench_items").select("item_id", "benchmark")
    return items.join(n, "item_id", "left").select("item_id", "benchmark", F.coalesce("documents", F.lit(0)).alias("documents"))


def _graded(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return reading_level.grade_documents(documents, reading_level.train(documents, table(spark, folder, "level_labels")), *keep)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of level 4 or 5."""
    return _graded(spark, folder, "doc_id").where("demanding").select("doc_id")


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Reading levels by topic, language and source, with all subtotals."""
    graded = _graded(spark, folder, "topic", "lang", "source").withColumn("lang", plain_lang(F.col("lang")))
    return graded.cube("topic", "lang", "source").agg(F.grouping_id().alias("grouped"), F.count("*").alias("documents"), F.avg("grade").alias("mean_grade"), F.count_if("demanding").alias("demanding"))


def p8_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Error of held-out grades by source."""
    return reading_level.validation(table(spark, folder, "documents"), table(spark, folder, "level_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_coverage, p2_found, p2_shares, p2_selection, p3_found, p3_budget, p3_late_rows, p4_found, p4_splits, p6_found, p6_containers, p7_found, p7_leaked_items, p8_found, p8_profile, p8_validation)}

_PLAIN = "nullif(regexp_replace(lower(trim({0})), '[-_. ]', '-', 'g'), '')"
_STEM = "nullif(regexp_replace(regexp_replace(trim(regexp_replace(lower(trim(stem)), '^.*[/\\\\]', '')), '\\.py$', ''), '^test_', ''), '')"
_SIZES = f"""
    names as (select {_PLAIN.format('source_key')} as plain, source_key from sources union select {_PLAIN.format('hf_id')}, source_key from sources),
    held as (select n.source_key, count(distinct i.example_id) as n from items i join names n on {_PLAIN.format('i.source')} = n.plain group by n.source_key),
    part as (
        select t.mix_id, t.source_key, t.weight, t.max_repeats, least(coalesce(h.n, 0), coalesce(s.cap, 9223372036854775807)) as size
        from mix_targets t join sources s on s.source_key = t.source_key left join held h on h.source_key = t.source_key
        where t.weight > 0 and s.role = 'train'),
    goal as (select *, weight / sum(weight) over (partition by mix_id) * sum(size) over (partition by mix_id) as target from part)"""

#: White space, comments, docstrings and empty lines go as the rule says; x(id, lines, lost, key): the distinct lines of a record and its search block without white space
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_DOC = r"""(?m)^[ \t]*[rubf]{0,2}(?:\"\"\"[\s\S]*?\"\"\"|\'\'\'[\s\S]*?\'\'\')""".replace("\\'", "''").replace('\\"', '"')
_NOTE = r"""(?m)^((?:[^#"'\n]|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')*)#.*$""".replace("'", "''")
_LINES_OF = f"list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(replace(lower(coalesce(original, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{_DOC}', '', 'g'), '{_NOTE}', '\\1', 'g'), chr(10)), lambda l: regexp_replace(l, '{_WHITE}', '', 'g')), lambda l: l <> ''))"
_P1 = f"""
    x as (select case_id as id, case_key, split = 'train' as train, {_LINES_OF} as lines, regexp_replace(coalesce(original, ''), '{_WHITE}', '', 'g') = '' as lost,
        case when len(list_filter(string_split_regex(search, '\\r\\n?|\\n'), lambda l: regexp_replace(l, '{_WHITE}', '', 'g') <> '')) >= 3 then regexp_replace(lower(search), '{_WHITE}', '', 'g') end as block from cases where split is not null),
    l as (select id, train, len(lines) as n, unnest(lines) as line from x),
    shared as (select t.id as t, e.id as e, count(*) as k, any_value(t.n) as tn, any_value(e.n) as en from l t join l e on t.line = e.line and t.train and not e.train group by t.id, e.id),
    pairs as (
        select t, e from shared where k >= 0.6 * (tn + en - k)
        union select t.id, e.id from x t join x e on t.train and not e.train and t.case_key = e.case_key
        union select t.id, e.id from x t join x e on t.train and not e.train and (t.lost or e.lost) and t.block = e.block)"""

SQL = {
    "p1_found": f"with {_P1} select least(t, e) as case_id_a, greatest(t, e) as case_id_b from pairs",
    "p2_shares": f"""with {_SIZES}, r as (select *, least(target, max_repeats * size) as reached from goal)
        select mix_id, source_key, weight / sum(weight) over (partition by mix_id) as target_share, target, reached::double as reached, reached / sum(reached) over (partition by mix_id) as reached_share, size::double as size, max_repeats, max_repeats * size < target as short from r""",
    "p2_found": f"with {_SIZES} select mix_id, source_key from goal where max_repeats * size < target",
    "p3_found": "select distinct run_id from items where proxy_tokens is null or proxy_tokens < length(request) / 6.0 or proxy_tokens > length(request) * 2 / 3.0",
    "p4_found": f"""
        with recursive r as (select case_id, case_group as g, {_STEM} as s from cases),
        links as (select distinct x.g as a, y.g as b from r x join r y on x.s = y.s where x.g is not null and y.g is not null and x.g <> y.g),
        reach(g, root) as (
            select distinct g, g from r where g is not null
            union
            select l.b, reach.root from reach join links l on l.a = reach.g),
        roots as (select g, min(root) as root from reach group by g),
        by_stem as (select r.s, min(roots.root) as root from r join roots on roots.g = r.g where r.s is not null group by r.s)
        select case_id, root as root_group from (
            select r.case_id, r.g, coalesce(roots.root, by_stem.root) as root from r left join roots on roots.g = r.g left join by_stem on by_stem.s = r.s)
        where root is not null and (g is null or g <> root)""",
}

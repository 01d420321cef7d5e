"""Queries over ordered lines, edit blocks and small sequential plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftara.functions import distributions as D
from siftara.functions import hashing as H
from siftara.functions import text as T
from siftara.operators import labels
from siftara.operators import requests as Q
from siftara.operators import sequences as S
from siftara.operators.envelope import rule_counts
from siftara.plans.registry import Registry
from siftara.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

_POINTS = r"""
    ls as (select doc_id, string_split_regex(text, '\r\n?|\n') as l from documents where text is not null and doc_kind = 'trace'),
    raw as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as place from ls),
    lines as (select doc_id, place, regexp_replace(line, '^[\s' || chr(65279) || ']+|\s+$', '', 'g') as line from raw),
    phased as (select *, last_value(case when regexp_full_match(line, '<[a-z]+>') then regexp_extract(line, '<([a-z]+)>', 1) end ignore nulls) over (partition by doc_id order by place rows unbounded preceding) as phase from lines where line <> ''),
    points as (select doc_id, place, phase, regexp_extract(line, '^\[(.+) \d+\]$', 1) as label, regexp_extract(line, '(\d+)\]$', 1)::int as number from phased where regexp_full_match(line, '\[[^\]\d]+ \d{1,9}\]'))"""


@R.add(f"with {_POINTS} select doc_id, place, phase, label, number, coalesce(number <= lag(number) over (partition by doc_id order by place), false) as out_of_order from points")
def trace_points(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of loop traces with the phase they stand in."""
    return S.trace_points(table(spark, folder, "documents").where("doc_kind = 'trace'"), "doc_id", "text")


@R.add(f"with {_POINTS}, o as (select *, coalesce(number <= lag(number) over (partition by doc_id order by place), false) as bad from points) select phase, count(*) as points, count(distinct doc_id) as traces, count(*) filter (where bad) as out_of_order from o group by phase")
def phase_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Headings per phase, and how many break the order."""
    p = S.trace_points(table(spark, folder, "documents").where("doc_kind = 'trace'"), "doc_id", "text")
    return p.groupBy("phase").agg(F.count("*").alias("points"), F.countDistinct("doc_id").alias("traces"), F.count_if("out_of_order").alias("out_of_order"))


@R.add(r"""select doc_id, len(regexp_extract_all(text, '(?m)^\s*<([a-z]+)>\s*$')) as opened, len(regexp_extract_all(text, '(?m)^\s*</([a-z]+)>\s*$')) as closed from documents where doc_kind = 'trace' and text is not null
    and len(regexp_extract_all(text, '(?m)^\s*<([a-z]+)>\s*$')) <> len(regexp_extract_all(text, '(?m)^\s*</([a-z]+)>\s*$'))""")
def envelope_check(spark: SparkSession, folder: str) -> DataFrame:
    """Loop traces whose tags are not all closed."""
    n = lambda pattern: F.size(F.regexp_extract_all("text", F.lit(pattern), 0)).cast("long")
    d = table(spark, folder, "documents").where("doc_kind = 'trace' and text is not null")
    return d.select("doc_id", n(r"(?m)^\s*<([a-z]+)>\s*$").alias("opened"), n(r"(?m)^\s*</([a-z]+)>\s*$").alias("closed")).where("opened <> closed")


@R.add()
def loop_check(spark: SparkSession, folder: str) -> DataFrame:
    """How often loop traces break each rule of their envelope, their root tag being loop."""
    return rule_counts(table(spark, folder, "documents").where("doc_kind = 'trace'"), "text")


@R.add("select case_id, sha256(substr(original, 1, strpos(original, search) - 1) || replacement || substr(original, strpos(original, search) + length(search))) as patched from cases where strpos(original, search) > 0 and search <> ''")
def apply_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every record's original after its edit."""
    c = table(spark, folder, "cases")
    return c.select("case_id", F.sha2(S.apply_block(F.col("original"), F.col("search"), F.col("replacement")), 256).alias("patched")).where("patched is not null")


@R.add("select case_id, sha256(search) as search, sha256(replacement) as replacement from cases where search is not null and replacement is not null")
def parse_edit_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's edit written as a block and parsed again."""
    block = F.concat(F.lit("note\n<<<<<<< SEARCH\n"), F.col("search"), F.lit("\n=======\n"), F.col("replacement"), F.lit("\n>>>>>>> REPLACE\nend"))
    b = table(spark, folder, "cases").select("case_id", F.explode(S.edit_blocks(block)).alias("b"))
    return b.select("case_id", F.sha2("b.search", 256).alias("search"), F.sha2("b.replacement", 256).alias("replacement"))


@R.add()
def micro_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in batches of similar length."""
    d = table(spark, folder, "documents").select("doc_id", F.length("text").alias("n"))
    return S.micro_batches(d, "doc_id", "n", budget=20_000, max_rows=32)


@R.add("select source, lang, n from (select source, lang, count(*) as n, row_number() over (partition by source order by count(*) desc, lang) as r from documents where lang is not null group by source, lang) where r = 1")
def most_common_lang(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent language of each source."""
    return S.most_common(table(spark, folder, "documents"), ["source"], "lang")


@R.add("select run_id, ('0x' || substr(sha256('5|' || run_id), 1, 13))::bigint / 4503599627370496.0 < 0.3 as included, ('0x' || substr(sha256('7|' || run_id), 1, 8))::bigint % 2147483648 as seed from (select distinct run_id from items)")
def row_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seed of every request, and whether it is in the fraction that keeps its reasoning."""
    i = table(spark, folder, "items").select("run_id").distinct()
    return i.select("run_id", (H.fraction(H.digest("5", F.col("run_id"), sep="|")) < 0.3).alias("included"), H.row_seed(F.col("run_id"), "7").alias("seed"))


@R.add("select a.rater as a, b.rater as b, count(*) as documents, count(*) filter (where a.level = b.level) as agree, round(avg(abs(a.level - b.level)), 6) as gap from level_labels a join level_labels b on a.doc_id = b.doc_id and a.rater < b.rater group by a.rater, b.rater")
def rater_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """How two raters of the same documents agree."""
    x = table(spark, folder, "level_labels")
    y = x.select("doc_id", F.col("rater").alias("b"), F.col("level").alias("lb"))
    pairs = x.select("doc_id", F.col("rater").alias("a"), F.col("level").alias("la")).join(y, "doc_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("documents"), F.count_if(F.col("la") == F.col("lb")).alias("agree"), F.round(F.avg(F.abs(F.col("la") - F.col("lb"))), 6).alias("gap"))


@R.add("""with p as (select vec_id, list_transform(embedding[1:4], lambda x: abs(x::double)) as e from embeddings),
    q as (select vec_id, case when vec_id % 5 = 1 then 'probs_sum' when vec_id % 5 = 2 then 'lengths_differ' when vec_id % 5 = 3 then 'codes_repeated' when vec_id % 5 = 4 then 'temperature_invalid' end as problem from p)
    select problem, count(*) as n from q where problem is not null group by problem""")
def label_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Problems found in labels that were spoilt in known ways."""
    k = F.pmod("vec_id", F.lit(5))
    p = D.normalize(F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double")) + 0.01))
    e = table(spark, folder, "embeddings").select(
        F.when(k == 1, F.transform(p, lambda x: x * 2)).otherwise(p).alias("p"), F.when(k == 2, F.array(F.lit("A"))).when(k == 3, F.array(*[F.lit(c) for c in "ABAC"])).otherwise(F.array(*[F.lit(c) for c in "ABCD"])).alias("c"), F.when(k == 4, 0.0).otherwise(1.0).alias("t")
    )
    return e.select(F.explode(labels.label_problems(F.col("c"), F.col("p"), F.col("t"))).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@R.add("""select case_id, chr(65 + (list_position(['train', 'val', 'test'], split) - 1)::int) as gold,
    sha256('{"state":{},"questions":{"q1":{"type":"choice","instructions":' || to_json('How does the hypothesis relate to the premise?' || chr(10) || 'Premise: ' || trim(stem) || chr(10) || 'Hypothesis: ' || trim(family)) || ',"criteria":{"A":"train","B":"val","C":"test"}}}}') as request
    from cases where trim(stem) <> '' and trim(family) <> ''""")
def entailment_adapter(spark: SparkSession, folder: str) -> DataFrame:
    """Records as three-way questions about a pair of texts."""
    request, gold = Q.entailment(F.col("stem"), F.col("family"), F.col("split"), ("train", "val", "test"))
    return table(spark, folder, "cases").select("case_id", F.get_json_object(gold, "$.q1").alias("gold"), F.sha2(request, 256).alias("request")).where("gold is not null")


@R.add(r"""with c as (select doc_id, unnest(string_split(regexp_replace(text, '\s+', '', 'g'), '')) as ch from documents where text is not null and regexp_replace(text, '\s+', '', 'g') <> ''),
    n as (select doc_id, ch, count(*) as n from c group by doc_id, ch), s as (select doc_id, max(n) / sum(n) as share from n group by doc_id) select doc_id, round(share, 6) as share from s where share > 0.15""")
def one_sign_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of which one sign makes up much: garbled replies show so."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", T.most_common_share("text").alias("share"))
    return d.select("doc_id", F.round("share", 6).alias("share")).where("share > 0.15")


@R.add("""with b as (select p_brand, avg(p_retailprice) as v from part group by p_brand), r as (select *, row_number() over (order by v desc, p_brand) - 1 as i, count(*) over () as n from b)
    select p_brand, round(v, 4) as v from r where list_contains(list_transform(range(5), lambda k: round_even(k * (n - 1) / 4.0, 0)::bigint), i)""")
def spread_pick(spark: SparkSession, folder: str) -> DataFrame:
    """Five brands evenly spaced over the ranking of all brands (ranked over the distinct brands, a short list)."""
    from pyspark.sql import Window

    b = table(spark, folder, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"))
    ranked = b.withColumn("i", F.row_number().over(Window.orderBy(F.desc("v"), "p_brand")) - 1)
    return ranked.where(F.col("i").isin(S.spread_ranks(b.count(), 5))).select("p_brand", F.round("v", 4).alias("v"))

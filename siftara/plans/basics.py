"""Queries of the plain building blocks: fields, names, sets, tops, row checks and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftara.functions import hashing as H
from siftara.functions import text as T
from siftara.operators import answers as A
from siftara.operators import evaluation as E
from siftara.operators import requests as Q
from siftara.operators import results, selection
from siftara.plans.records import _FIRST, _edge
from siftara.plans.registry import Registry
from siftara.sources import readers, sealed
from siftara.storage import new_path
from siftara.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 dearest orders, the smaller key first at a tie: each task keeps 25."""
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@R.add("select kind, coalesce(lang, '') as lang, count(*) as n, count(topic) as topics from (select doc_kind as kind, lang, topic from documents union all select benchmark, lang, null from bench_items) group by 1, 2")
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and test items in one table, the columns that one lacks being null."""
    d = table(spark, folder, "documents").select(F.col("doc_kind").alias("kind"), "lang", "topic")
    b = table(spark, folder, "bench_items").select("lang", F.col("benchmark").alias("kind"))
    both = d.unionByName(b, allowMissingColumns=True)
    return both.groupBy("kind", F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"), F.count("topic").alias("topics"))


@R.add("""with a as (select distinct run_id from items where run_id is not null), b as (select distinct run_id from deliveries where run_id is not null)
    select 'both' as part, count(*) as n from (select run_id from a intersect select run_id from b) union all select 'items', count(*) from (select run_id from a except select run_id from b) union all select 'deliveries', count(*) from (select run_id from b except select run_id from a)""")
def set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """How many run_ids both tables hold, and each alone."""
    a, b = (table(spark, folder, t).where("run_id is not null").select("run_id") for t in ("items", "deliveries"))
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count(a.intersect(b), "both").union(count(a.subtract(b), "items")).union(count(b.subtract(a), "deliveries"))


@R.add("select distinct run_id, json_extract_string(request, '$.questions.q1.type') as type, json_extract_string(request, '$.state.note') is not null as noted, sha256(trim(json_extract_string(request, '$.questions.q1.instructions'))) as asked from items")
def dotted_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of requests by dotted path, null where they are missing, and trimmed text."""
    get = lambda path: F.get_json_object("request", f"$.{path}")
    return table(spark, folder, "items").select("run_id", get("questions.q1.type").alias("type"), get("state.note").isNotNull().alias("noted"), F.sha2(T.strip(get("questions.q1.instructions")), 256).alias("asked")).distinct()


@R.add("select event_id, case when event_id % 3 = 0 then (value >= 50)::varchar when event_id % 3 = 1 then event_type end as gold from events")
def gold_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Gold labels that are truth values, texts or missing, as keys."""
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.initcap((F.col("value") >= 50).cast("string"))).when(k == 1, F.col("event_type"))
    return table(spark, folder, "events").select("event_id", E.gold_text(said).alias("gold"))


@R.add("select case_id from cases where split = 'val' and family is not null and case_id % 3 <> 0")
def picked_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a listing that are parquet, in the folder of a configuration, and of a split."""
    name = F.concat(F.lit("data/main/"), "split", F.lit("-"), F.col("case_id").cast("string"), F.when(F.col("case_id") % 3 == 0, ".csv").otherwise(".parquet"))
    listing = table(spark, folder, "cases").where("family is not null").select("case_id", name.alias("path"))
    return readers.pick_files(listing, "path", config="main", split="val").select("case_id")


@R.add("select case when catalog_id % 2 = 0 then example_id else run_id end as id, count(*) as n from items group by 1")
def any_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The first id that a row has among several columns."""
    i = table(spark, folder, "items").select(F.when(F.col("catalog_id") % 2 == 0, F.col("example_id")).alias("example_id"), "run_id")
    return i.groupBy(readers.any_id(i).alias("id")).agg(F.count("*").alias("n"))


@R.add("select count(*) as n from items")
def readable_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests, counted after it was made sure that not too many cannot be read."""
    return readers.require_readable(table(spark, folder, "items"), "request").agg(F.count("*").alias("n"))


_SPOILT = "ord(sha256(run_id)[1]) % 8"


@R.add(f"""with s as (select run_id, {_SPOILT} as k from items where run_id is not null)
    select run_id, case k when 0 then 'example_id' when 1 then 'split' when 2 then 'lang' when 3 then 'request' when 4 then 'gold' end as problem, count(*) as copies from s where k < 5 group by 1, 2""")
def corpus_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of corpus rows that were spoilt in five ways."""
    k = F.pmod(F.ascii(F.sha2("run_id", 256)), F.lit(8))
    spoil = lambda at, bad, good: F.when(k == at, F.lit(bad)).otherwise(good)
    rows = table(spark, folder, "items").where("run_id is not null").select(
        "run_id", spoil(0, " ", F.col("run_id")).alias("example_id"), F.lit("s").alias("source"), F.lit("mit").alias("license"), spoil(1, "both", F.lit("dev")).alias("split"), spoil(2, "English", F.lit("pt-BR")).alias("lang"),
        spoil(3, "{}", F.col("request")).alias("request"), spoil(4, '{"q2": "A"}', F.lit("{}")).alias("gold"),
    )
    p = rows.select("run_id", F.explode(corpus_problems()).alias("problem"))
    return p.groupBy("run_id", "problem").agg(F.count("*").alias("copies"))


def corpus_problems() -> Column:
    """Names of what is wrong with a corpus row (columns as ``readers.CORPUS``): an empty text column, an unknown split, a language that is no tag, a bad request or gold. Gold is looked at where the request is good."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    bad = F.size(Q.request_problems(F.col("request"))) > 0
    checks = [(c, blank(c)) for c in ("example_id", "source", "license")]
    checks += [("split", ~F.coalesce(F.col("split").isin("train", "dev"), F.lit(False))), ("lang", ~F.coalesce(F.col("lang").rlike("^[a-z]{2,3}(-[A-Z]{2})?$"), F.lit(False))), ("request", F.coalesce(bad, F.lit(True))), ("gold", ~bad & (F.size(Q.gold_problems(F.col("request"), F.col("gold"))) > 0))]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))


@R.add("select rater as teacher, count(*) as n, count(distinct doc_id) as documents from level_labels where level is not null group by rater")
def typed_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings written as teacher labels to a sealed folder and read back by their fixed columns."""
    rows = table(spark, folder, "level_labels").where("level is not null").select(F.col("doc_id").cast("string").alias("example_id"), F.lit("q1").alias("question_id"), F.col("rater").alias("teacher"), F.array(F.lit("A")).alias("codes"), F.array(F.lit(1.0)).alias("probs"), F.lit(1.0).alias("temperature"), "level")
    path = new_path(spark, "labels")
    sealed.write_sealed(rows, path, tool="labels")
    return readers.read_typed(spark, path, readers.LABELS).groupBy("teacher").agg(F.count("*").alias("n"), F.countDistinct("example_id").alias("documents"))


@R.add(f"""with {_FIRST}, g as (select group_id, min(track) as track from (select f.*, coalesce(d.track, '') as track from first f join (select run_id, min(track) as track from deliveries group by run_id) d using (run_id)) group by group_id having bool_and(coalesce(status = 'ok', false))),
    r as (select *, row_number() over (partition by track order by sha256('4:' || track || ':' || group_id)) as i from g) select group_id, track from r where i <= 2""".replace("select f.*, coalesce(d.track, '') as track", "select f.group_id, f.status, coalesce(d.track, '') as track"))
def complete_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Two groups of each track, by digest, of those all of whose runs came out well."""
    tracks = table(spark, folder, "deliveries").groupBy("run_id").agg(F.coalesce(F.min("track"), F.lit("")).alias("track"))
    first = _edge(spark, folder, False)
    groups = results.complete_groups(first, "group_id", F.col("status") == "ok").select("group_id")
    named = first.join(tracks, "run_id").groupBy("group_id").agg(F.min("track").alias("track")).join(groups, "group_id", "left_semi")
    return selection.cap_per_group(named, ["track"], H.digest("4", F.col("track"), F.col("group_id")), 2).select("group_id", "track")


@R.add(r"""with b as (select doc_id, regexp_replace(substr(case when ord(sha256(doc_id::varchar)[1]) % 8 = 0 then repeat('#-', 400) || text else text end, 1, 2000), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b\x1c-\x1f]+', '', 'g') as t from documents where text is not null),
    c as (select doc_id, unnest(string_split(t, '')) as ch from b where length(t) >= 200), n as (select doc_id, ch, count(*) as n from c group by 1, 2), s as (select doc_id, max(n) / sum(n) as top, sum(n) filter (where regexp_matches(ch, '[\p{L}\p{N}]')) / sum(n) as readable from n group by doc_id)
    select doc_id from s where top > 0.4 or coalesce(readable, 0) < 0.4""")
def noise_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that begin with noise, one sign over and over or few letters and digits; an eighth was given such a beginning."""
    k = F.pmod(F.ascii(F.sha2(F.col("doc_id").cast("string"), 256)), F.lit(8))
    noisy = F.when(k == 0, F.concat(F.repeat(F.lit("#-"), 400), "text")).otherwise(F.col("text"))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", A.noise(noisy).alias("bad")).where("bad").select("doc_id")


@R.add(r"""with q as (select distinct run_id, request from items where run_id is not null), o as (select run_id, case json_extract_string(request, '$.questions.q1.type') when 'choice' then json_extract(request, '$.questions.q1.criteria.*') else json_extract(request, '$.questions.q1.criteria[*]') end as ts, json_extract_string(request, '$.questions.q1.instructions') as i from q where json_extract_string(request, '$.questions.q1.type') <> 'noul')
    select run_id, len(list_distinct(list_filter(list_transform(string_split(i, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) as instructions, len(list_distinct(list_filter(list_transform(ts, lambda x: trim(x->>'$')), lambda x: x <> ''))) as options from o""")
def lines_by_role(spark: SparkSession, folder: str) -> DataFrame:
    """Different lines of the instructions and of the options of choice and score requests."""
    q = Q.view(F.col("request"))["questions"]["q1"]
    i = table(spark, folder, "items").where("run_id is not null").select("run_id", "request").distinct().select("run_id", q.alias("q")).where("q.type <> 'noul'")
    said = F.array_join(F.transform(Q.options(F.col("q")), lambda o: o["text"]), "\n")
    return i.select("run_id", F.size(T.lines(F.col("q.instructions"))).cast("long").alias("instructions"), F.size(T.lines(said)).cast("long").alias("options"))

"""Queries that hold answers, traces and packs against requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftara.functions import distributions as D
from siftara.functions import hashing as H
from siftara.functions import text as T
from siftara.operators import answers as A
from siftara.operators import evaluation as E
from siftara.operators import requests as Q
from siftara.plans.registry import Registry
from siftara.plans.records import _FIRST
from siftara.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

_KEYS = """case json_extract_string(request, '$.questions.q1.type') when 'choice' then json_keys(request, '$.questions.q1.criteria')
    when 'score' then list_transform(range(json_array_length(request, '$.questions.q1.criteria')::bigint), lambda i: i::varchar) else ['false', 'true'] end"""
#: r(run_id, source, catalog_id, keys, gold): one row for each request
_REQUESTS = f"r as (select run_id, min(source) as source, min(catalog_id) as catalog_id, min({_KEYS}) as keys, min(json_extract_string(gold, '$.q1')) as gold from items where run_id is not null group by run_id)"
#: a(run_id, delivery_id, probs): the probabilities of every delivery that has some, in the order of the option keys
_ANSWERS = """d as (select run_id, delivery_id, response from deliveries where run_id is not null and json_valid(response)),
    a as (select d.run_id, delivery_id, case when json_extract(response, '$.answers.q1.probabilities') is not null then list_transform(keys, lambda k: json_extract_string(response, '$.answers.q1.probabilities."' || k || '"')::double)
        else [1 - json_extract_string(response, '$.answers.q1.noul')::double, json_extract_string(response, '$.answers.q1.noul')::double] end as probs from d join r on r.run_id = d.run_id
        where json_extract(response, '$.answers.q1.probabilities') is not null or json_extract(response, '$.answers.q1.noul') is not null)"""


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, source, catalog_id, option_keys, gold of every request."""
    q = Q.view(F.col("request"))["questions"]["q1"]
    i = table(spark, folder, "items").where("run_id is not null").select("run_id", "source", "catalog_id", Q.option_keys(q).alias("option_keys"), E.gold_text(F.get_json_object("gold", "$.q1")).alias("gold"))
    return i.groupBy("run_id").agg(*[F.min(c).alias(c) for c in ("source", "catalog_id", "option_keys", "gold")])


def _answers(spark: SparkSession, folder: str, requests: DataFrame) -> DataFrame:
    """run_id, delivery_id, option_keys, probs of every delivery that answers."""
    d = table(spark, folder, "deliveries").where("run_id is not null").select("run_id", "delivery_id", F.get_json_object("response", "$.answers.q1").alias("a"))
    probs = F.from_json(F.get_json_object("a", "$.probabilities"), "map<string,double>")
    yes = F.get_json_object("a", "$.noul").try_cast("double")
    joined = d.join(requests.select("run_id", "option_keys"), "run_id")
    listed = F.when(probs.isNotNull(), F.transform("option_keys", lambda k: probs[k])).when(yes.isNotNull(), F.array(1 - yes, yes))
    return joined.select("run_id", "delivery_id", "option_keys", listed.alias("probs")).where("probs is not null")


@R.add(f"""with {_REQUESTS}, {_ANSWERS}, one as (select run_id, min(probs) as probs, min(probs) <> max(probs) as conflict from a group by run_id),
    j as (select r.*, probs, conflict, list_position(keys, gold) as g from r left join one on one.run_id = r.run_id where gold is not null),
    s as (select source, 1.0 / len(keys) as chance, case when probs is null then 'missing' when conflict then 'conflicting' when len(probs) = len(keys) and list_min(probs) >= 0 and list_sum(probs) > 0 then 'ok' else 'bad' end as state,
        len(list_filter(probs, lambda x: x = list_max(probs))) as m, probs[g] = list_max(probs) as top from j)
    select source, count(*) filter (where state = 'ok') as n, round(avg(case when top then 1.0 / m else 0 end) filter (where state = 'ok'), 6) as accuracy, round(avg(chance) filter (where state = 'ok'), 6) as chance,
        count(*) filter (where state = 'missing') as missing, count(*) filter (where state in ('bad', 'conflicting')) as bad, count(*) filter (where state = 'conflicting') as conflicting, count(*) filter (where state = 'ok' and m > 1) as ties,
        round((avg(case when top then 1.0 / m else 0 end) filter (where state = 'ok') - avg(chance) filter (where state = 'ok')) / (1 - avg(chance) filter (where state = 'ok')), 6) as skill from s group by source""")
def proxy_score(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy over chance of the delivered answers per source, with missing, bad, conflicting and tied ones."""
    r = _requests(spark, folder)
    s = E.score_answers(r, _answers(spark, folder, r), ["run_id"], "source")
    return s.select("source", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "chance", "skill")], "missing", "bad", "conflicting", "ties")


_ACCEPTING = (31, 50)


@R.add(f"""with {_REQUESTS}, {_ANSWERS}, first as (select run_id, arg_min(probs, delivery_id) as probs from a group by run_id),
    s as (select r.run_id, keys, probs, case when catalog_id in {_ACCEPTING} then list_distinct([gold, keys[1]]) else [gold] end as accepted from r join first on first.run_id = r.run_id where gold is not null)
    select run_id, list_contains(accepted, keys[list_position(probs, list_max(probs))]) as hit, round(list_max(probs), 6) as confidence, round(len(accepted)::double / len(keys), 6) as chance from s""")
def row_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the first delivered answer of a request is an accepted one, how sure it is, and what chance gives. Two catalogs accept their first option as well."""
    r = _requests(spark, folder)
    first = _answers(spark, folder, r).groupBy("run_id").agg(F.min_by("probs", "delivery_id").alias("probs"))
    gold = E.gold_sets(F.col("catalog_id"), F.col("gold"), F.array_distinct(F.array("gold", F.get("option_keys", F.lit(0)))), F.lit(1), _ACCEPTING)
    rows = r.where("gold is not null").join(first, "run_id").withColumn("accepted", gold)
    return E.row_hits(rows, "run_id", "option_keys", "probs", "accepted").select("run_id", "hit", F.round("confidence", 6).alias("confidence"), F.round("chance", 6).alias("chance"))


@R.add(f"""with {_REQUESTS}, d as (select delivery_id, d.run_id, status, response, keys, case when json_valid(response) then json_extract(response, '$.answers.q1.probabilities') end as p, case when json_valid(response) then json_extract_string(response, '$.answers.q1.noul')::double end as y from deliveries d join r on r.run_id = d.run_id),
    v as (select *, list_transform(json_keys(p), lambda k: json_extract_string(p, '$."' || k || '"')::double) as vals from d)
    select run_id, case when status = 'ok' and coalesce(case when p is null then y between 0 and 1 else len(json_keys(p)) = len(keys) and len(list_intersect(keys, json_keys(p))) = len(keys) and list_min(vals) >= 0 and list_max(vals) <= 1 and abs(list_sum(vals) - 1) <= 0.001 end, false) then 'ok' else 'error' end as class, count(*) as n from v group by 1, 2""")
def result_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries of every request by what they are worth after their answer was looked at."""
    d = table(spark, folder, "deliveries").select("run_id", "status", "response").join(_requests(spark, folder).select("run_id", "option_keys"), "run_id")
    return d.groupBy("run_id", E.result_class(F.col("status"), F.col("response"), F.col("option_keys")).alias("class")).agg(F.count("*").alias("n"))


def _eighth(key: str) -> Column:
    """0 to 7 by the first sign of the digest of a key: which rows are spoilt, and how."""
    return F.pmod(F.ascii(F.sha2(F.col(key).cast("string"), 256)), F.lit(8))


_TRACES = """e as (select run_id, min(request) as request, ord(sha256(run_id)[1]) % 8 as k from items where run_id is not null group by run_id),
    t as (select run_id, 'because ' || run_id as reasoning, sha256(case k when 1 then request || ' ' else request end) as request_sha256 from e where k <> 0)"""


def _traces(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    corpus = table(spark, folder, "items").where("run_id is not null").groupBy("run_id").agg(F.min("request").alias("request"))
    k = _eighth("run_id")
    traces = corpus.where(k != 0).select("run_id", F.concat(F.lit("because "), "run_id").alias("reasoning"), F.sha2(F.when(k == 1, F.concat("request", F.lit(" "))).otherwise(F.col("request")), 256).alias("request_sha256"))
    return corpus, traces


@R.add(f"with {_TRACES} select e.run_id, case when t.request_sha256 = sha256(e.request) then reasoning end as reasoning, case when t.run_id is null then 'none' when t.request_sha256 = sha256(e.request) then 'fits' else 'stale' end as trace_state from e left join t on t.run_id = e.run_id")
def trace_join(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with their reasoning, of which an eighth has none and an eighth was made for another text."""
    corpus, traces = _traces(spark, folder)
    return E.join_traces(corpus, traces, "run_id", "request", "request_sha256", keep=["reasoning"]).select("run_id", "reasoning", "trace_state")


@R.add(f"""with {_TRACES} select run_id, case k when 2 then 'tokens' when 3 then 'finish_reason' when 4 then 'request_sha256' when 5 then 'thinker' end as problem from e where k between 2 and 5""")
def trace_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Problems of traces that were spoilt in four ways."""
    _, traces = _traces(spark, folder)
    k = _eighth("run_id")
    sha = F.when(k == 4, F.upper(F.concat(F.lit("x"), F.substring("request_sha256", 2, 63)))).otherwise(F.col("request_sha256"))
    found = E.trace_problems(F.col("run_id"), F.when(k == 5, " ").otherwise("one"), F.col("reasoning"), F.when(k == 2, "-1").otherwise("12"), F.when(k == 3, "end").otherwise("stop"), sha)
    return traces.select("run_id", F.explode(found).alias("problem"))


@R.add("""with keys as (select s_name as key from supplier where s_suppkey % 10 = 1 union select n_name from nation union select 'nobody'),
    al as (select n_name as alias, count(distinct s_name) as n, min(s_name) as one from nation join supplier on s_nationkey = n_nationkey and s_suppkey <= 40 group by n_name),
    m as (select key, coalesce(s.s_name, case when n = 1 then one end) as engine, n from keys left join supplier s on s.s_name = key left join al on al.alias = key),
    d as (select engine, count(*) as k from m where engine is not null group by engine)
    select key, m.engine, case when d.k > 1 then 'duplicate' when m.engine is not null then 'matched' when n > 1 then 'ambiguous' else 'unmatched' end as state from m left join d on d.engine = m.engine""")
def alias_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Names resolved to suppliers: by their own name, or by a nation that only one of the first forty suppliers has."""
    s, n = table(spark, folder, "supplier"), table(spark, folder, "nation")
    aliases = n.join(s.where("s_suppkey <= 40"), F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "s_name")
    keys = s.where("s_suppkey % 10 = 1").select(F.col("s_name").alias("key")).union(n.select("n_name")).union(spark.sql("select 'nobody'"))
    return E.resolve_names(keys, "key", s, "s_name", aliases, "n_name")


@R.add("select distinct stem from cases where split = 'train' and stem is not null intersect select stem from cases where split <> 'train'")
def shared_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Stems that the training split and the others hold."""
    c = table(spark, folder, "cases")
    return E.shared_values(c.where("split = 'train'"), c.where("split <> 'train'"), "stem")


def _four(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, gold and the probabilities a, b, c, d of four systems."""
    e = table(spark, folder, "embeddings").select("vec_id", F.pmod("label", F.lit(4)).cast("int").alias("gold"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", "gold", *[D.softmax(F.slice("e", 1 + 4 * i, 4)).alias(n) for i, n in enumerate("abcd")])


_SUBSETS = """
    v as (select vec_id, ((label % 4) + 4) % 4 as gold, s, k, embedding[1 + 4 * s + k]::double as z from embeddings, range(4) t(s), range(4) u(k)),
    m as (select *, max(z) over (partition by vec_id, s) as top from v), p as (select vec_id, gold, s, k, exp(z - top) / sum(exp(z - top)) over (partition by vec_id, s) as p from m),
    sets as (select mask, bit_count(mask::int) as size, concat_ws('+', case when mask & 1 > 0 then 'a' end, case when mask & 2 > 0 then 'b' end, case when mask & 4 > 0 then 'c' end, case when mask & 8 > 0 then 'd' end) as subset from range(1, 16) t(mask) where bit_count(mask::int) <= 3),
    mixed as (select subset, size, vec_id, gold, k, sum(p) / size as p from p join sets on (mask >> s) & 1 = 1 group by subset, size, vec_id, gold, k),
    tops as (select subset, size, vec_id, gold, arg_max(k, p * 1e9 - k * 1e-3) as top from mixed group by subset, size, vec_id, gold),
    scores as (select subset, size, avg((top = gold)::int) filter (where h = 0) as half0, avg((top = gold)::int) filter (where h = 1) as half1, avg((top = gold)::int) as whole
        from (select *, ('0x' || right(sha256(vec_id::varchar), 1))::bigint % 2 as h from tops) group by subset, size)"""


def _subsets(spark: SparkSession, folder: str) -> DataFrame:
    return E.subset_scores(_four(spark, folder), {n: F.col(n) for n in "abcd"}, F.col("gold"), H.half(F.col("vec_id")), 3)


@R.add(f"with {_SUBSETS} select subset, size::int as size, round(half0, 6) as half0, round(half1, 6) as half1, round(whole, 6) as whole from scores")
def subset_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the mean of every subset of up to three of four systems, on both halves."""
    return _subsets(spark, folder).select("subset", "size", *[F.round(c, 6).alias(c) for c in ("half0", "half1", "whole")])


@R.add(f"""with {_SUBSETS}, best as (select size, arg_min(subset, r0) as c0, arg_min(half1, r0) as m1, arg_min(subset, r1) as c1, arg_min(half0, r1) as m0 from (select *, row_number() over (partition by size order by round(half0, 12) desc, subset) as r0, row_number() over (partition by size order by round(half1, 12) desc, subset) as r1 from scores) group by size)
    select size::int as size, c0 as chosen_on_0, round(m1, 6) as measured_on_1, c1 as chosen_on_1, round(m0, 6) as measured_on_0, round((m0 + m1) / 2, 6) as held_out, round((m0 + m1) / 2 - (select (m0 + m1) / 2 from best where size = 1), 6) as gain from best""")
def split_half_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """The best subset of each size on one half, measured on the other."""
    s = E.split_half_choice(_subsets(spark, folder))
    return s.select("size", "chosen_on_0", "chosen_on_1", *[F.round(c, 6).alias(c) for c in ("measured_on_1", "measured_on_0", "held_out", "gain")])


@R.add(f"""with {_SUBSETS}, g as (select p.subset, p.whole - greatest(a.whole, b.whole) as gain from scores p join scores a on a.subset = p.subset[1] join scores b on b.subset = p.subset[3] where p.size = 2)
    select subset[1] as a, subset[3] as b, round(gain, 6) as gain from g""")
def pairs_self_join(spark: SparkSession, folder: str) -> DataFrame:
    """Gain of the mean of every pair of systems over the better of the two."""
    s = _subsets(spark, folder)
    one = s.where("size = 1")
    pairs = s.where("size = 2").select(F.substring_index("subset", "+", 1).alias("a"), F.substring_index("subset", "+", -1).alias("b"), "whole")
    side = lambda n: F.broadcast(one.select(F.col("subset").alias(n), F.col("whole").alias(f"own_{n}")))  # noqa: E731  one row a system
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(F.col("whole") - F.greatest("own_a", "own_b"), 6).alias("gain"))


@R.add("select o_orderpriority as kind, count(*) as n, round(avg(v), 4) as mean, round(median(v), 4) as median, min(v) as least, max(v) as most, round(avg((v > 0)::int), 6) as positive from (select o_orderpriority, round(o_totalprice - 150000, 2) as v from orders) group by 1")
def pair_gain_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, median, ends and the share above zero of the differences of each kind."""
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("kind"), F.round(F.col("o_totalprice") - 150000, 2).alias("v"))
    s = E.summary_by_kind(o, "kind", "v")
    return s.select("kind", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "least", "most", F.round("positive", 6).alias("positive"))


@R.add("select track, n, round(rate, 6) as pass_rate, round((whole - rate) * 100, 4) as drop_points, case when (whole - rate) * 100 <= 3 then 'PASS' else 'FAIL' end as status from (select track, count(*) as n, avg(coalesce(status = 'ok', false)::int) as rate from deliveries group by track), (select avg(coalesce(status = 'ok', false)::int) as whole from deliveries)")
def quant_gate(spark: SparkSession, folder: str) -> DataFrame:
    """How far the share of good messages of each track falls below that of all."""
    g = E.drop_gate(table(spark, folder, "deliveries"), "track", F.coalesce(F.col("status") == "ok", F.lit(False)))
    return g.select("track", "n", F.round("pass_rate", 6).alias("pass_rate"), F.round("drop_points", 4).alias("drop_points"), "status")


@R.add("select event_type, round(avg(value) / 10, 6) as mean, round(case when avg(value) <= 0 then 1 else least(1, 1000 / (1000 * avg(value) / 10)) end, 6) as share from events group by event_type")
def latency_share(spark: SparkSession, folder: str) -> DataFrame:
    """The share of requests of each kind that may take their mean time for the mean of all to stay within a second."""
    s = E.thinking_share(table(spark, folder, "events").withColumn("seconds", F.col("value") / 10), "event_type", "seconds")
    return s.select("event_type", F.round("mean", 6).alias("mean"), F.round("share", 6).alias("share"))


@R.add("select doc_id from (select doc_id, row_number() over (order by sha256('n:' || doc_id::varchar)) - 1 as i from documents) where i % 7 = 0")
def strided_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh document in a seeded order."""
    return E.every_nth(table(spark, folder, "documents").select("doc_id"), H.digest("n", F.col("doc_id")), 7)


_CODES = f"""codes as (select code, row_number() over (order by len(code), code) - 1 as place from (
    select chr(65 + i::int) as code from range(26) t(i) union all select chr(65 + i::int) || chr(65 + j::int) from range(26) t(i), range(26) u(j)) where code not in {E.SKIPPED_CODES})"""


@R.add(f"with {_CODES} select place, code from codes where place < 255")
def answer_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The 255 codes that options are answered by."""
    return spark.createDataFrame(list(enumerate(E.answer_codes())), "place long, code string")


@R.add(f"with {_CODES}, l as (select vec_id, 2 + vec_id % 5 as n, case when vec_id % 7 = 0 then 1 else 0 end as shift from embeddings) select vec_id from l where shift = 1")
def label_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Labels whose codes are not the first ones, where every seventh was shifted by one."""
    n, shift = (F.lit(2) + F.col("vec_id") % 5).cast("int"), F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)
    codes = F.slice(F.array(*[F.lit(c) for c in E.answer_codes()]), shift + 1, n)
    return table(spark, folder, "embeddings").where(E.code_problems(codes, n)).select("vec_id")


@R.add(f"""with {_REQUESTS} select run_id, coalesce(case when ord(sha256(run_id)[1]) % 8 <> 0 then list_position(keys, gold) - 1 end, -1) as place,
    case when ord(sha256(run_id)[1]) % 8 = 0 and gold is not null then 'gold' when ord(sha256(run_id)[1]) % 8 = 1 then 'length' end as problem from r""")
def target_index(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every gold key, with an eighth of the keys spoilt and an eighth of the distributions too short."""
    r, k = _requests(spark, folder), _eighth("run_id")
    probs = F.when(k == 1, F.array(F.lit(1.0))).otherwise(F.array_repeat(F.lit(0.5), F.size("option_keys")))
    t = E.target_index(F.col("option_keys"), F.when((k == 0) & F.col("gold").isNotNull(), "none such").otherwise(F.col("gold")), probs)
    return r.select("run_id", t.alias("t")).select("run_id", F.coalesce("t.place", F.lit(-1)).alias("place"), "t.problem")


@R.add("select origin, count(*) as fitted from (select run_id, min(origin) as origin, min(json_extract_string(gold, '$.q1')) as gold from items where run_id is not null group by run_id) where gold is not null group by origin")
def fitted_by_origin(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with a gold answer by origin."""
    i = table(spark, folder, "items").where("run_id is not null").groupBy("run_id").agg(F.min("origin").alias("origin"), F.min(F.get_json_object("gold", "$.q1")).alias("gold"))
    return i.where("gold is not null").groupBy("origin").agg(F.count("*").alias("fitted"))


@R.add("""with m as (select case_id, row_number() over (order by case_id) as place, sha256(coalesce(search, '')) as sha, ord(sha256(case_id::varchar)[1]) % 8 as k from cases)
    select case_id, case k when 0 then 'missing' when 1 then 'moved' when 2 then 'changed' when 3 then 'repeated' end as problem from m where k < 4""")
def pack_check(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a pack that do not fit its manifest, where half of them were left out, moved, changed or repeated."""
    c = table(spark, folder, "cases").select("case_id", F.col("case_id").alias("place"), F.sha2(F.coalesce("search", F.lit("")), 256).alias("sha"))
    k = _eighth("case_id")
    pack = c.where(k != 0).select("case_id", F.when(k == 1, -F.col("place") - 1).otherwise(F.col("place")).alias("place"), F.when(k == 2, "0").otherwise(F.col("sha")).alias("sha"), F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return E.pack_problems(pack, c, "case_id", "place", "sha")


@R.add(f"with {_REQUESTS} select run_id from r where gold is not null and run_id in (select run_id from items where json_extract_string(request, '$.questions.q1.type') = 'choice')")
def gold_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that ask choice questions only and have a gold answer to each."""
    v, gold = Q.view(F.col("request")), F.from_json("gold", "map<string,string>")
    i = table(spark, folder, "items").where("run_id is not null").select("run_id", v.alias("v"), gold.alias("g"))
    fits = F.forall(F.map_entries("v.questions"), lambda e: F.coalesce((e["value"]["type"] == "choice") & F.col("g")[e["key"]].isNotNull(), F.lit(False)))
    return i.where(fits & (F.size("v.questions") > 0)).select("run_id").distinct()


@R.add("""select count(*) as n, round(max(abs(a - b)), 9) as largest, round(max(abs(round(a, 4) - b)), 9) as largest_rounded from (select p_brand, avg(p_retailprice) / 3000 as a, round(avg(p_retailprice) / 3000, 4) as b from part group by p_brand)""")
def score_validation(spark: SparkSession, folder: str) -> DataFrame:
    """How far scores worked out anew lie from published ones of four digits."""
    ours = table(spark, folder, "part").groupBy("p_brand").agg((F.avg("p_retailprice") / 3000).alias("score"))
    theirs = ours.select("p_brand", F.round("score", 4).alias("score"))
    d = E.largest_differences(ours, theirs, ["p_brand"], "score")
    return d.select("n", F.round("largest", 9).alias("largest"), F.round("largest_rounded", 9).alias("largest_rounded"))


@R.add("select i as step, round(case when i <= 6 then i / 6.0 else 0.1 + 0.45 * (1 + cos(pi() * (i - 6) / 114)) end, 9) as factor from range(1, 121) t(i)")
def warmup_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Factor of the rate at each of 120 steps."""
    return spark.range(1, 121).select(F.col("id").alias("step"), F.round(E.warmup_cosine(F.col("id"), 120, 0.05), 9).alias("factor"))


_PAYLOAD = """'{"choices":' || case k when 0 then '[]' when 1 then '[{"finish_reason":"error"}]' else '[{"finish_reason":"stop"}]' end || ',"usage":' || case k when 2 then '{}' when 3 then '{"total_tokens":-1}' else '{"total_tokens":7}' end || '}'"""


@R.add("select delivery_id, case ord(sha256(delivery_id::varchar)[1]) % 8 when 0 then 'choices' when 1 then 'finish_reason' when 2 then 'usage' when 3 then 'usage' end as problem from deliveries")
def completion_check(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with completions that were spoilt in four ways."""
    d = table(spark, folder, "deliveries").select("delivery_id", _eighth("delivery_id").alias("k")).withColumn("payload", F.expr(_PAYLOAD.replace('"', '\\"')))
    return d.select("delivery_id", E.completion_problem(F.col("payload")).alias("problem"))


@R.add("""with d as (select doc_id, ord(sha256(doc_id::varchar)[1]) % 3 as k, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents where text is not null and doc_kind = 'issue')
    select doc_id, sha256(case k when 2 then '' else t end) as reasoning, case k when 1 then null when 2 then sha256(t) else sha256('A') end as final from d""")
def reply_split(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the reasoning and the final part of replies whose thinking is closed, left open or absent."""
    t, k = F.trim(F.regexp_replace("text", r"\s+", " ")), F.pmod(F.ascii(F.sha2(F.col("doc_id").cast("string"), 256)), F.lit(3))
    reply = F.when(k == 0, F.concat(F.lit("<think> "), t, F.lit(" </think>\n A "))).when(k == 1, F.concat(F.lit("<think>"), t)).otherwise(t)
    d = table(spark, folder, "documents").where("text is not null and doc_kind = 'issue'").select("doc_id", A.reply_parts(reply).alias("p"))
    return d.select("doc_id", F.sha2("p.reasoning", 256).alias("reasoning"), F.sha2("p.final", 256).alias("final"))


_LINES = r"""q as (select run_id, case json_type(request, '$.state') when 'OBJECT' then array_to_string(list_transform(json_extract(request, '$.state.*'), lambda x: x->>'$'), chr(10)) else json_extract_string(request, '$.state') end as state, json_extract_string(request, '$.questions.q1.instructions') as instructions, request from items where run_id is not null),
    u as (select run_id, substr(state, 1, 6) as state, unnest(string_split(substr(state, 1, 6), chr(10))) as line from q union all select run_id, null, unnest(string_split(substr(instructions, 1, 10), chr(10))) from q),
    s as (select distinct run_id, state, trim(line) as line from u where trim(line) <> ''), f as (select state, min(run_id) as first from s where state is not null group by state)"""


@R.add(f"with {_LINES} select line, count(distinct run_id) as df from s left join f on f.state = s.state where s.state is null or f.first = s.run_id group by line having count(distinct run_id) > 1")
def state_counted_once(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of states and instructions that several requests hold, a state that many requests share counting once. So that there are such, only the beginnings count as state and instructions."""
    r = F.col("request")
    state = F.get_json_object(r, "$.state")
    said = F.when(F.json_object_keys(state).isNotNull(), F.array_join(T.leaf_texts(state), "\n")).otherwise(state)
    i = table(spark, folder, "items").where("run_id is not null").select("run_id", F.substring(said, 1, 6).alias("state"), F.substring(F.get_json_object(r, "$.questions.q1.instructions"), 1, 10).alias("instructions"))
    lines = lambda c, s: i.select("run_id", s.alias("state"), F.explode(T.lines(F.col(c))).alias("line"))
    both = lines("state", F.col("state")).unionByName(lines("instructions", F.lit(None).cast("string"))).distinct()
    return E.documented_share(both, "line", "run_id", "state").where("df > 1")


_QTEXT = rf"""{_LINES.split("u as (")[0]} o as (select run_id, any_value(state) as state, any_value(instructions) as instructions, any_value(request) as request from q group by run_id),
    x as (select run_id, array_to_string(regexp_extract_all(lower(concat_ws(chr(10), state, instructions, case json_extract_string(request, '$.questions.q1.type') when 'choice' then array_to_string(list_transform(json_extract(request, '$.questions.q1.criteria.*'), lambda c: c->>'$'), chr(10))
        when 'score' then array_to_string(list_transform(json_extract(request, '$.questions.q1.criteria[*]'), lambda c: c->>'$'), chr(10))
        else concat_ws(chr(10), coalesce(json_extract_string(request, '$.questions.q1.criteria.false'), 'No / false'), coalesce(json_extract_string(request, '$.questions.q1.criteria.true'), 'Yes / true')) end)), '[\p{{L}}\p{{N}}_]+'), ' ') as text from o)"""


@R.add(f"with {_QTEXT} select run_id, sha256(text) as question from x")
def question_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the words of every question: state, instructions and options."""
    return Q.question_digests(table(spark, folder, "items").where("run_id is not null").dropDuplicates(["run_id"]), "run_id", "request").select("run_id", "question")


@R.add(f"with {_QTEXT}, s as (select run_id, min(split) as split from items where run_id is not null group by run_id), j as (select x.run_id, text, split from x join s using (run_id)), f as (select text, min(ref) as ref from (select text, run_id as ref from j where split <> 'train' union all select text, 'ref:' || run_id from j where ord(sha256(run_id)[1]) % 8 = 0) group by text) select j.run_id, f.ref from j join f using (text) where j.split = 'train'")
def exact_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Training requests that ask a question which a reference asks as well, however it is set, with the first of those. The references are the requests of other splits and copies of an eighth of all that were set otherwise."""
    i = table(spark, folder, "items").where("run_id is not null").groupBy("run_id").agg(F.min("split").alias("split"), F.min("request").alias("request"))
    d = Q.question_digests(i, "run_id", "request", "split")
    copies = i.where(_eighth("run_id") == 0).select(F.concat(F.lit("ref:"), "run_id").alias("run_id"), F.replace("request", F.lit('"instructions":"'), F.lit('"instructions":" ** ')).alias("request"))
    reference = d.where("split <> 'train'").select("run_id", "question").unionByName(Q.question_digests(copies, "run_id", "request").select("run_id", "question"))
    first = reference.groupBy("question").agg(F.min("run_id").alias("ref"))
    return d.where("split = 'train'").join(first, "question").select("run_id", "ref")


@R.add()
def triple_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Records kept when one that shares key, search block or replacement with an earlier kept one goes."""
    c = table(spark, folder, "cases").select("case_id", "case_key", F.sha2("search", 256).alias("s"), F.sha2("replacement", 256).alias("r"))
    return E.first_by_any_key(c, "case_id", ["case_key", "s", "r"]).select("case_id")


@R.add(f"with {_FIRST} select run_id, case when response is null or not json_valid(response) then 'unreadable' when json_extract(response, '$.usage.output_tokens') is null then 'no usage' else 'read' end as state, coalesce(case when json_valid(response) then json_extract_string(response, '$.usage.output_tokens')::bigint end, 0) as tokens from first")
def slim_results(spark: SparkSession, folder: str) -> DataFrame:
    """The state and the tokens of the first result of every request, read without the rest of it."""
    d = table(spark, folder, "deliveries").where("run_id is not null").select("run_id", "received_at", "delivery_id", "response")
    first = d.groupBy("run_id").agg(F.min_by("response", F.struct("received_at", "delivery_id")).alias("response"))
    tokens = F.get_json_object("response", "$.usage.output_tokens").try_cast("long")
    return first.select("run_id", F.when(F.json_object_keys("response").isNull(), "unreadable").when(tokens.isNull(), "no usage").otherwise("read").alias("state"), F.coalesce(tokens, F.lit(0)).alias("tokens"))

"""Queries over requests, result logs and streams of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftara.functions import text as T
from siftara.functions.hashing import digest
from siftara.operators import answers
from siftara.operators import requests as Q
from siftara.operators import results as P
from siftara.operators import runlog
from siftara.plans.registry import Registry
from siftara.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.add("select json_extract_string(request, '$.questions.q1.type') as type, count(*) as n, sum(case json_extract_string(request, '$.questions.q1.type') when 'choice' then len(json_keys(request, '$.questions.q1.criteria')) when 'score' then json_array_length(request, '$.questions.q1.criteria') else 2 end)::bigint as options from items group by 1")
def request_types(spark: SparkSession, folder: str) -> DataFrame:
    """Questions by type with their options."""
    q = table(spark, folder, "items").select(Q.view(F.col("request"))["questions"]["q1"].alias("q"))
    return q.select("q.type", F.size(Q.option_keys(F.col("q"))).alias("k")).groupBy("type").agg(F.count("*").alias("n"), F.sum("k").alias("options"))


#: Requests by the last letter of their digest's first byte: those of 0 to 3 are spoilt, each in its own way
_SPOIL = "ord(sha256(run_id)[1]) % 8"


def _spoil() -> Column:
    return F.pmod(F.ascii(F.sha2("run_id", 256)), F.lit(8))


@R.add(f"""with g as (select run_id, case {_SPOIL} when 0 then 'no such option' else json_extract_string(gold, '$.q1') end as said, case {_SPOIL} when 1 then 'q9' else 'q1' end as question, request from items where run_id is not null),
    p as (select run_id, case when question = 'q9' then 'unknown_question' when said is not null and not list_contains(case json_extract_string(request, '$.questions.q1.type')
        when 'choice' then json_keys(request, '$.questions.q1.criteria') when 'score' then list_transform(range(json_array_length(request, '$.questions.q1.criteria')::bigint), lambda i: i::varchar) else ['false', 'true'] end, said) then 'no_option' end as problem from g)
    select run_id, problem, count(*) as copies from p where problem is not null group by run_id, problem""")
def gold_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Requests whose gold answer is none of the options, or of no question; a quarter of them were spoilt so."""
    said = F.when(_spoil() == 0, "no such option").otherwise(F.get_json_object("gold", "$.q1"))
    gold = F.concat(F.lit('{"'), F.when(_spoil() == 1, "q9").otherwise("q1"), F.lit('": '), F.coalesce(Q.json_text(said), F.lit("null")), F.lit("}"))
    p = table(spark, folder, "items").where("run_id is not null").select("run_id", F.explode(Q.gold_problems(F.col("request"), gold)).alias("p"))
    return p.groupBy("run_id", F.substring_index("p", ":", 1).alias("problem")).agg(F.count("*").alias("copies"))


@R.add(f"""with g as (select run_id, {_SPOIL} as k, json_extract_string(request, '$.questions.q1.type') as type from items where run_id is not null)
    select run_id, case k when 0 then 'no_object' when 1 then 'no_questions' when 2 then 'type' when 3 then 'option_count' end as problem, count(*) as copies from g where k < 3 or k = 3 and type = 'choice' group by 1, 2""")
def request_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that are not well formed: half of them were cut, emptied or given another type or no options."""
    r, k = F.col("request"), _spoil()
    type_ = F.get_json_object(r, "$.questions.q1.type")
    spoilt = F.when(k == 0, F.substring(r, 1, 20)).when(k == 1, F.lit('{"state": "", "questions": {}}')).when(k == 2, F.replace(r, F.concat(F.lit('"type":"'), type_), F.lit('"type":"x'))).when((k == 3) & (type_ == "choice"), F.lit('{"state": {}, "questions": {"q1": {"type": "choice", "criteria": {}}}}')).otherwise(r)
    p = table(spark, folder, "items").where("run_id is not null").select("run_id", F.explode(Q.request_problems(spoilt)).alias("p"))
    return p.groupBy("run_id", F.element_at(F.split("p", ": "), -1).alias("problem")).agg(F.count("*").alias("copies"))


@R.add("""select doc_id, list_position(['rationale', 'adr', 'trace', 'issue', 'readme', 'code'], doc_kind) - 1 as place, 'option_' || lpad((list_position(['rationale', 'adr', 'trace', 'issue', 'readme', 'code'], doc_kind) - 1)::varchar, 3, '0') as gold
    from documents where regexp_replace(coalesce(text, ''), '^ +| +$', '', 'g') <> ''""")
def classification_adapter(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as questions about their kind."""
    kinds = ["rationale", "adr", "trace", "issue", "readme", "code"]
    request, gold = Q.classify(F.col("text"), F.col("doc_kind"), kinds, instruction="What kind of text is this?\n{text}")
    d = table(spark, folder, "documents").select("doc_id", request.alias("request"), F.get_json_object(gold, "$.q1").alias("gold")).where("request is not null")
    keys = F.json_object_keys(F.get_json_object("request", "$.questions.q1.criteria"))
    return d.select("doc_id", (F.array_position(keys, F.col("gold")) - 1).cast("int").alias("place"), "gold")


@R.add("""select event_id, case when value >= 50 then 'true' else 'false' end as gold,
    sha256('{"state":' || to_json(event_type) || ',"questions":{"q1":{"type":"noul","instructions":"Is the value high?","criteria":{"false":"No","true":"Yes"}}}}') as request from events where event_type <> ''""")
def binary_adapter(spark: SparkSession, folder: str) -> DataFrame:
    """Events as yes/no questions about their value."""
    request, gold = Q.yes_no(F.col("event_type"), F.col("value"), "Is the value high?", threshold=50)
    return table(spark, folder, "events").select("event_id", F.get_json_object(gold, "$.q1").alias("gold"), F.sha2(request, 256).alias("request")).where("gold is not null")


@R.add("""select p_partkey, chr(65 + (p_size % 4)) as gold, sha256('{"state":{},"questions":{"q1":{"type":"choice","instructions":"Which?","criteria":{"A":' || to_json(p_brand) || ',"B":' || to_json(p_type) || ',"C":' || to_json(p_name) || ',"D":"none of these"}}}}') as request
    from part where p_brand <> p_type and p_brand <> p_name and p_type <> p_name and not (p_brand = '' or p_type = '' or p_name = '')""")
def choice_adapter(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as multiple-choice questions with the answer given by place."""
    texts = F.array("p_brand", "p_type", "p_name", F.lit("none of these"))
    request, gold = Q.multiple_choice(F.lit("Which?"), texts, F.pmod("p_size", F.lit(4)) + 1, offset=1)
    return table(spark, folder, "part").select("p_partkey", F.get_json_object(gold, "$.q1").alias("gold"), F.sha2(request, 256).alias("request")).where("gold is not null")


@R.add("""select n, i as place, case when n <= 26 then chr(65 + i::int) else 'option_' || lpad(i::varchar, 3, '0') end as key from (values (2), (26), (27), (255)) t(n), lateral (select unnest(range(n)) as i)""")
def option_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of questions with 2, 26, 27 and 255 options."""
    n = spark.createDataFrame([(n,) for n in (2, 26, 27, 255)], "n int")
    return n.select("n", F.posexplode(Q.numbered_keys(F.col("n"))).alias("place", "key"))


@R.add("""with d as (select p_retailprice as v, dense_rank() over (order by p_retailprice) - 1 as r from (select distinct p_retailprice from part)),
    n as (select a.v, b.v as other, sha256('n:' || b.r::varchar) as turn from d a join d b on abs(a.r - b.r) <= 15 and a.r <> b.r),
    k as (select *, row_number() over (partition by v order by turn) as i from n)
    select p_partkey, round(sum(other), 4) as near from part p join k on k.v = p.p_retailprice where i <= 3 group by p_partkey""")
def nearest_values(spark: SparkSession, folder: str) -> DataFrame:
    """Three other prices near each part's own, by a seeded order."""
    near = Q.nearest_values(table(spark, folder, "part"), "p_partkey", "p_retailprice", digest("n", F.col("_at")))
    return near.select("p_partkey", F.round(F.aggregate("near", F.lit(0.0), lambda a, x: a + x), 4).alias("near"))


@R.add("""with i as (select distinct run_id, request, json_extract_string(request, '$.questions.q1.type') as type from items),
    o as (select run_id, request, k.i, k.key, case type when 'choice' then json_extract_string(request, '$.questions.q1.criteria."' || k.key || '"') when 'score' then json_extract_string(request, '$.questions.q1.criteria[' || k.key || ']')
            else coalesce(json_extract_string(request, '$.questions.q1.criteria.' || k.key), case k.key when 'false' then 'No / false' else 'Yes / true' end) end as text
        from i, lateral (select unnest(case type when 'choice' then json_keys(request, '$.questions.q1.criteria') when 'score' then list_transform(range(json_array_length(request, '$.questions.q1.criteria')::bigint), lambda x: x::varchar) else ['false', 'true'] end) as key,
            unnest(range(case type when 'choice' then len(json_keys(request, '$.questions.q1.criteria'))::bigint when 'score' then json_array_length(request, '$.questions.q1.criteria')::bigint else 2 end)) as i) k),
    l as (select run_id, request, string_agg(key || '. ' || text, chr(10) order by i) as options from o group by run_id, request)
    select run_id, sha256('State: ' || coalesce(json_extract_string(request, '$.state'), '') || chr(10) || 'Question q1: ' || coalesce(json_extract_string(request, '$.questions.q1.instructions'), '') || chr(10) || options) as prompt from l""")
def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every request as a prompt, of whatever type."""
    return table(spark, folder, "items").select("run_id", F.sha2(Q.render(F.col("request")), 256).alias("prompt")).distinct()


@R.add()
def permute_options(spark: SparkSession, folder: str) -> DataFrame:
    """The option order of every request and whether it can be taken back."""
    q = table(spark, folder, "items").select("run_id", Q.option_keys(Q.view(F.col("request"))["questions"]["q1"]).alias("keys")).dropDuplicates(["run_id"])
    o = q.withColumn("order", Q.option_order(F.size("keys"), Q.order_key(F.size("keys"), F.col("run_id"), F.lit("q1"), seed=7)))
    return o.select("run_id", F.array_join(Q.reorder(F.col("keys"), F.col("order")), ",").alias("shown"), (Q.restore(Q.reorder(F.col("keys"), F.col("order")), F.col("order")) == F.col("keys")).alias("restored"))


@R.add("""with q as (select run_id, min(json_extract_string(gold, '$.q1')) as gold, min(json_extract_string(request, '$.questions.q1.type')) as type from items where json_extract_string(gold, '$.q1') is not null and run_id is not null group by run_id)
    select run_id, gold as key, ['marker', 'generic', 'boxed'][ord(sha256(run_id)[1]) % 3 + 1] as how from q where type = 'choice'""")
def extract_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The gold option of every choice request, said in one of three ways and read again."""
    said = F.get_json_object("gold", "$.q1")
    i = table(spark, folder, "items").where(said.isNotNull() & F.col("run_id").isNotNull() & (F.get_json_object("request", "$.questions.q1.type") == "choice"))
    one = i.groupBy("run_id").agg(F.min_by(F.struct(said.alias("gold"), "request"), said).alias("r")).select("run_id", "r.*")
    way = F.pmod(F.ascii(F.sha2("run_id", 256)), F.lit(3))
    reply = F.when(way == 0, F.concat(F.lit("Not A.\nANSWER q1: ("), "gold", F.lit(")"))).when(way == 1, F.concat(F.lit("So the answer is **"), "gold", F.lit("**."))).otherwise(F.concat(F.lit("It follows: $\\boxed{"), "gold", F.lit("}$")))
    a = answers.request_answers(reply, "request")
    return one.select("run_id", F.explode(a).alias("a")).select("run_id", "a.key", "a.how")


@R.add()
def request_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the canonical form of every request."""
    return table(spark, folder, "items").select("run_id", F.sha2(T.canonical_json("request"), 256).alias("digest")).distinct()


@R.add("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def last_record_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of every user."""
    return runlog.last_record(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@R.add("""with e as (select user_id, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as i from events where event_type in ('error', 'purchase', 'signup')),
    o as (select user_id, count(*) as attempts, max(case when not bad then i end) as ok from e group by user_id)
    select o.user_id, o.attempts, count(e.i) as streak from o left join e on e.user_id = o.user_id and e.bad and (o.ok is null or e.i > o.ok) group by o.user_id, o.attempts""")
def error_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """Failures of every user since the last success."""
    e = table(spark, folder, "events")
    return runlog.trailing_streak(e, "user_id", F.struct("ts", "event_id"), F.col("event_type") == "error", counts=F.col("event_type").isin("error", "purchase", "signup"))


@R.add("""with g as (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as before_ from events)
    select user_id, before_ as lost_at, ts as back_at, (epoch_us(ts) - epoch_us(before_)) / 1e6 as seconds from g where epoch_us(ts) - epoch_us(before_) > 90000000""")
def lease_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Where a user's next event came after the time to live."""
    return runlog.lease_gaps(table(spark, folder, "events"), "user_id", "ts", "event_id", 90)


@R.add("""select user_id, count(*) as events, arg_max(event_type, ts) filter (where event_type <> 'view') as final, bool_or(event_type = 'purchase') as done, count(*) filter (where event_type = 'error') as bad from events group by user_id""")
def stream_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Every user's events folded to one row."""
    final = F.when(F.col("event_type") != "view", F.col("event_type"))
    return runlog.fold_stream(table(spark, folder, "events"), "user_id", ["ts", "event_id"], final=final, mark=F.col("event_type") == "purchase", bad=F.col("event_type") == "error")


@R.add("""with last as (select user_id, count(*) as attempts, arg_max(event_type, epoch_us(ts)) as status from events group by user_id)
    select c_custkey as user_id, l.status, coalesce(l.attempts, 0) as attempts from customer c left join last l on l.user_id = c.c_custkey where (l.status is null or l.status not in ('purchase', 'signup')) and coalesce(l.attempts, 0) < 70""")
def work_list(spark: SparkSession, folder: str) -> DataFrame:
    """Customers whose last event is no end and who have attempts left."""
    e = table(spark, folder, "events")
    last = e.groupBy("user_id").agg(F.count("*").alias("attempts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return runlog.work_list(table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")), last, "user_id", terminal=["purchase", "signup"], max_attempts=70)


@R.add("""with s as (select *, row_number() over (partition by user_id, event_id % 2 order by ts desc, event_id desc) as r from events),
    k as (select user_id, event_id % 2 as side, ts, event_type, list_position(['view', 'click', 'error', 'signup', 'purchase'], event_type) as rank from s where r = 1)
    select user_id, event_type, ts from (select *, row_number() over (partition by user_id order by rank desc, ts desc, side) as r from k) where r = 1""")
def state_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Two states of every user merged: the further stage wins, then the later one."""
    e = table(spark, folder, "events")
    side = lambda k: runlog.last_record(e.where(F.col("event_id") % 2 == k), ["user_id"], ["ts", "event_id"])
    rank = F.array_position(F.array(*[F.lit(x) for x in ("view", "click", "error", "signup", "purchase")]), F.col("event_type"))
    return runlog.merge_states(side(0), side(1), "user_id", rank=rank, order="ts", columns=["event_type"])


@R.add("""select event_type, count(*) as n, round(avg(value), 6) as mean, round(median(value), 6) as median, max(value) as top, list_sort(list(value))[ceil(0.8 * count(*))::bigint] as p80 from events group by event_type""")
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, median, maximum and the value at the 80 % rank; the rank is read from counts of distinct values, not from a collected group."""
    e = table(spark, folder, "events").where("value is not null")
    plain = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.max("value").alias("top"))
    from pyspark.sql import Window

    counts = e.groupBy("event_type", "value").agg(F.count("*").alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    p80 = upto.join(plain.select("event_type", "n"), "event_type").where(F.col("upto") >= F.ceil(F.col("n") * 0.8)).groupBy("event_type").agg(F.min("value").alias("p80"))
    return plain.join(p80, "event_type")


@R.add("""with w as (select run_id, count(distinct status) as states, bool_or(status = 'ok') as ok from deliveries where run_id is not null group by run_id)
    select count(*) as requests, count(*) filter (where states is null) as missing, count(*) filter (where ok) as ok, count(*) filter (where states is not null and not ok) as failed from (select distinct run_id from items) i left join w using (run_id)""")
def run_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many requests have a good, only a bad, or no result."""
    w = table(spark, folder, "deliveries").where("run_id is not null").groupBy("run_id").agg(F.bool_or(F.col("status") == "ok").alias("ok"))
    i = table(spark, folder, "items").select("run_id").distinct().join(w, "run_id", "left")
    return i.agg(F.count("*").alias("requests"), F.count_if(F.col("ok").isNull()).alias("missing"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


_FIRST = "first as (select * from (select *, row_number() over (partition by run_id order by received_at, delivery_id) as r from deliveries where run_id is not null) where r = 1)"
_LAST = "last as (select * from (select *, row_number() over (partition by run_id order by received_at desc, delivery_id desc) as r from deliveries where run_id is not null) where r = 1)"
_GOOD = "good as (select * from first where json_valid(response))"
_OPTIONS = """answers as (
        select run_id, 'q1' as question, json_extract_string(response, '$.answers.q1.type') as type, unnest(json_keys(response, '$.answers.q1.probabilities')) as option, response from good where json_extract(response, '$.answers.q1.probabilities') is not null),
    options as (
        select run_id, question, type, option, json_extract(response, '$.answers.q1.probabilities.' || option)::double as probability from answers
        union all select run_id, 'q1', json_extract_string(response, '$.answers.q1.type'), o, case when o = 'true' then json_extract(response, '$.answers.q1.noul')::double else 1 - json_extract(response, '$.answers.q1.noul')::double end
            from good, (values ('false'), ('true')) t(o) where json_extract(response, '$.answers.q1.noul') is not null and json_extract(response, '$.answers.q1.probabilities') is null)"""


def _edge(spark: SparkSession, folder: str, latest: bool) -> DataFrame:
    """The first or the last message of every run_id as it is written."""
    d = table(spark, folder, "deliveries").where("run_id is not null").select("run_id", "received_at", "delivery_id", "payload_sha256", "response", "status", "group_id")
    row, by = F.struct(*[c for c in d.columns if c != "run_id"]), F.struct("received_at", "delivery_id")
    return d.groupBy("run_id").agg((F.max_by if latest else F.min_by)(row, by).alias("r")).select("run_id", "r.*")


@R.add(f"with {_FIRST}, {_GOOD}, {_OPTIONS} select run_id, question, type, option, round(probability, 6) as probability from options")
def probability_table(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of every option of every answer."""
    return P.option_table(_edge(spark, folder, False), ["run_id"], "response").withColumn("probability", F.round("probability", 6))


@R.add(f"with {_FIRST}, {_LAST} select coalesce(a.run_id, b.run_id) as run_id, case when a.payload_sha256 is null or b.payload_sha256 is null then 'unknown' when a.payload_sha256 = b.payload_sha256 then 'same' else 'different' end as state from first a full join last b on a.run_id = b.run_id")
def payload_states(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the first and the last message of a run carry the same payload."""
    return P.payload_states(_edge(spark, folder, False), _edge(spark, folder, True), "run_id", "payload_sha256")


@R.add(f"""with {_FIRST}, {_GOOD}, {_OPTIONS}, sums as (select run_id, question, sum(probability) as s from options group by run_id, question), per as (select run_id, bool_and(abs(s - 1) <= 0.001) as good from sums group by run_id)
    select case when p.good is null then 'missing' when p.good then 'ok' else 'bad' end as state, count(*) as n from (select distinct run_id from items) i left join per p on p.run_id = i.run_id group by 1""")
def answer_states(spark: SparkSession, folder: str) -> DataFrame:
    """Requests by the state of their answer."""
    options = P.option_table(_edge(spark, folder, False), ["run_id"], "response")
    return P.answer_states(table(spark, folder, "items"), options, "run_id", "option", "probability").groupBy("state").agg(F.count("*").alias("n"))


@R.add(f"with {_FIRST} select group_id, count(*) as n from first group by group_id having bool_and(coalesce(status = 'ok', false))")
def complete_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups all of whose runs came out well."""
    return P.complete_groups(_edge(spark, folder, False), "group_id", F.col("status") == "ok")


@R.add("with n as (select greatest(1, (count(*) + 99) // 100) as n from documents) select doc_id, floor(('0x' || substr(sha256('e:3:' || doc_id::varchar), 1, 8))::bigint / 4294967296.0 * n)::bigint as slice from documents, n")
def epoch_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in slices of about a hundred for one epoch."""
    return P.epoch_slices(table(spark, folder, "documents"), "doc_id", 100, "e", 3)


@R.add("select doc_id from documents d where not exists (select 1 from documents m where m.doc_id = d.doc_id and m.doc_kind <> 'code' and m.text is not null)")
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a resumed run has left, where all but code was done."""
    d = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("input"), "doc_kind")
    return P.pending(d, d.where("doc_kind <> 'code'"), ["doc_id", "input"]).select("doc_id")

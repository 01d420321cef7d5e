"""Queries over labels, distributions, scores and systems.

Logits come from the first four numbers of ``embeddings``, a second view from the next four, and the gold place from ``label``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftara.functions import distributions as D
from siftara.functions import hashing as H
from siftara.functions import statistics as S
from siftara.operators import calibration, labels, scoring
from siftara.plans.registry import Registry
from siftara.tables import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _systems(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, gold, logits a and b, probabilities pa and pb."""
    e = table(spark, folder, "embeddings").select("vec_id", F.pmod("label", F.lit(4)).cast("int").alias("gold"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    cut = e.select("vec_id", "gold", F.slice("e", 1, 4).alias("a"), F.slice("e", 5, 4).alias("b"))
    return cut.select("*", D.softmax(F.col("a")).alias("pa"), D.softmax(F.col("b")).alias("pb"))


#: v(vec_id, gold, k, za, zb), p(..., pa, pb) for each option k, and tops: the first maximum and the confidence of each system
_P = """
    v as (select vec_id, ((label % 4) + 4) % 4 as gold, k - 1 as k, embedding[k]::double as za, embedding[k + 4]::double as zb from (select *, unnest([1, 2, 3, 4]) as k from embeddings)),
    m as (select *, max(za) over (partition by vec_id) as ma, max(zb) over (partition by vec_id) as mb from v),
    p as (select vec_id, gold, k, za, zb, exp(za - ma) / sum(exp(za - ma)) over (partition by vec_id) as pa, exp(zb - mb) / sum(exp(zb - mb)) over (partition by vec_id) as pb from m),
    tops as (select vec_id, gold, arg_max(k, za * 1e6 - k * 1e-9) as top_a, arg_max(k, zb * 1e6 - k * 1e-9) as top_b, max(pa) as ca, max(pb) as cb, max(case when k = gold then pa end) as ga, max(case when k = gold then pb end) as gb from p group by vec_id, gold)"""


@R.add(f"with {_P} select vec_id, k::int as k, round(pa, 6) as p from p")
def softmax_temperature(spark: SparkSession, folder: str) -> DataFrame:
    """Probability of every option."""
    return _systems(spark, folder).select("vec_id", F.posexplode("pa").alias("k", "p")).select("vec_id", "k", F.round("p", 6).alias("p"))


@R.add(f"""with {_P}, b as (select vec_id, sum(power(pa - case when k = gold then 1 else 0 end, 2)) as brier from p group by vec_id)
    select count(*) as n, round(avg(-ln(greatest(ga, 1e-12))), 6) as nll, round(avg(brier), 6) as brier, round(avg(case when top_a = gold then 1.0 else 0.0 end), 6) as accuracy from tops join b using (vec_id)""")
def nll_brier_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Proper scores of the first system."""
    s = calibration.scores(_systems(spark, folder), "pa", "gold")
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("nll", "brier", "accuracy")])


def _ece_sql(bins: int) -> str:
    return f"with {_P} select sum(n)::bigint as n, round(sum(abs(c - h)) / sum(n), 6) as ece from (select least(floor(ca * {bins})::int, {bins - 1}) as bin, count(*) as n, sum(ca) as c, sum(case when top_a = gold then 1.0 else 0.0 end) as h from tops group by 1)"


@R.add(_ece_sql(10))
def ece10(spark: SparkSession, folder: str) -> DataFrame:
    """Calibration error over ten bins."""
    return calibration.calibration_error(_systems(spark, folder), "pa", "gold", 10).select("n", F.round("ece", 6).alias("ece"))


@R.add(_ece_sql(15))
def ece15(spark: SparkSession, folder: str) -> DataFrame:
    """Calibration error over fifteen bins."""
    return calibration.calibration_error(_systems(spark, folder), "pa", "gold", 15).select("n", F.round("ece", 6).alias("ece"))


_GRID = (0.5, 1.0, 2.0, 4.0)
_SCAN = """with v as (select vec_id, ((label % 4) + 4) % 4 as gold, k - 1 as k, t, embedding[k]::double / t as z from (select *, unnest([1, 2, 3, 4]) as k from (select *, unnest([0.5, 1.0, 2.0, 4.0]::double[]) as t from embeddings))),
    m as (select *, max(z) over (partition by vec_id, t) as mz from v),
    s as (select vec_id, gold, k, t, exp(z - mz) / sum(exp(z - mz)) over (partition by vec_id, t) as p from m)
    """


@R.add(_SCAN + "select t as temperature, count(*) as n, round(avg(-ln(greatest(p, 1e-12))), 6) as nll from s where k = gold group by t")
def temperature_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Score of each temperature of a grid."""
    return calibration.scan_temperatures(_systems(spark, folder), "a", "gold", _GRID).select("temperature", "n", F.round("nll", 6).alias("nll"))


@R.add(_SCAN + """, per as (select gold, t, count(*) as n, avg(-ln(greatest(p, 1e-12))) as nll from s where k = gold group by gold, t),
    best as (select gold, arg_min(t, nll) as t, min(n) as n from per group by gold),
    whole as (select arg_min(t, nll) as t from (select t, avg(-ln(greatest(p, 1e-12))) as nll from s where k = gold group by t))
    select b.gold::int as gold, b.n, b.n >= 130 as own, case when b.n >= 130 then b.t else w.t end as temperature from best b, whole w""")
def group_temperature_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Best temperature of each group, and of all rows for groups that are too small."""
    s = _systems(spark, folder)
    best = lambda groups: calibration._best(calibration.scan_temperatures(s, "a", "gold", _GRID, groups), groups)
    return calibration.with_fallback(best(["gold"]), best([]), 130).select("gold", "n", "own", "temperature")


#: The reference's scan and the fewest rows of a group with its own temperature.
_FULL_GRID = D.geometric_grid(0.5, 4.0, 33)
_OWN_ROWS = 30


@R.add(_SCAN.replace("unnest([0.5, 1.0, 2.0, 4.0]::double[]) as t", "unnest([0.5 * power(8.0, i / 32.0) for i in range(33)]::double[]) as t") + "select round(t, 6) as temperature, count(*) as n, round(avg(-ln(greatest(p, 1e-12))), 6) as nll from s where k = gold group by t")
def temperature_scan_full(spark: SparkSession, folder: str) -> DataFrame:
    """Score of each of the 33 temperatures of the reference's scan."""
    return calibration.scan_temperatures(_systems(spark, folder), "a", "gold", _FULL_GRID).select(F.round("temperature", 6).alias("temperature"), "n", F.round("nll", 6).alias("nll"))


@R.add()
def group_temperature_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted temperature of each group, and of all rows for groups of fewer than 30."""
    s = _systems(spark, folder)
    fits = [calibration.fit_temperature(s, "a", "gold", groups) for groups in (["gold"], [])]
    return calibration.with_fallback(*fits, _OWN_ROWS).select("gold", "n", "own", "temperature")


@R.add()
def golden_section_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Temperature of each group, refined between grid points."""
    return calibration.fit_temperature(_systems(spark, folder), "a", "gold", ["gold"])


@R.add(f"with {_P} select vec_id, k::int as k, round(0.25 * pa + 0.75 * pb, 6) as p from p")
def combine_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted mean of two systems."""
    c = labels.combine({"a": F.col("pa"), "b": F.col("pb")}, weights={"a": 1, "b": 3})
    return _systems(spark, folder).select("vec_id", F.posexplode(c).alias("k", "p")).select("vec_id", "k", F.round("p", 6).alias("p"))


@R.add(f"with {_P}, l as (select vec_id, k, exp((ln(greatest(pa, 1e-12)) + ln(greatest(pb, 1e-12))) / 2) as q from p) select vec_id, k::int as k, round(q / sum(q) over (partition by vec_id), 6) as p from l")
def combine_logpool(spark: SparkSession, folder: str) -> DataFrame:
    """Log pool of two systems."""
    c = labels.combine({"a": F.col("pa"), "b": F.col("pb")}, method="logpool")
    return _systems(spark, folder).select("vec_id", F.posexplode(c).alias("k", "p")).select("vec_id", "k", F.round("p", 6).alias("p"))


@R.add(f"""with {_P}, r as (select vec_id, k, power(pa, 0.5) / sum(power(pa, 0.5)) over (partition by vec_id) as qa, pb from p)
    select vec_id, k::int as k, round((qa + pb) / 2, 6) as p from r""")
def combine_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """Mean after one system is brought to another temperature."""
    c = labels.combine({"a": F.col("pa"), "b": F.col("pb")}, method="calibrated_mean", temperatures={"a": (1.0, 2.0)})
    return _systems(spark, folder).select("vec_id", F.posexplode(c).alias("k", "p")).select("vec_id", "k", F.round("p", 6).alias("p"))


@R.add(f"with {_P} select vec_id, k::int as k, round(0.3 * case when k = gold then 1 else 0 end + 0.7 * pa, 6) as p from p")
def gold_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Gold mixed into a distribution."""
    return _systems(spark, folder).select("vec_id", F.posexplode(D.mix_gold(F.col("pa"), F.col("gold"), 0.3)).alias("k", "p")).select("vec_id", "k", F.round("p", 6).alias("p"))


@R.add(f"with {_P} select a.vec_id, a.k::int as k, round((a.pa + b.pb) / 2, 6) as p from p a join p b on a.vec_id = b.vec_id and b.k = 3 - a.k")
def tta_reverse_average(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of a view and of one whose options were shown in reverse."""
    mean = D.mean_of([F.col("pa"), F.reverse("pb")])
    return _systems(spark, folder).select("vec_id", F.posexplode(mean).alias("k", "p")).select("vec_id", "k", F.round("p", 6).alias("p"))


@R.add("""with v as (select vec_id, ((label % 4) + 4) % 4 as gold, k - 1 as k, round(embedding[k]::double, 1) as z from (select *, unnest([1, 2, 3, 4]) as k from embeddings)),
    m as (select *, max(z) over (partition by vec_id) as mz from v)
    select vec_id, round(max(case when k = gold and z = mz then 1.0 else 0.0 end) / count(*) filter (where z = mz), 6) as credit from m group by vec_id""")
def tie_credit(spark: SparkSession, folder: str) -> DataFrame:
    """Credit shared among tied options."""
    rounded = _systems(spark, folder).withColumn("a", F.transform("a", lambda x: F.round(x, 1)))
    return rounded.select("vec_id", F.round(D.tie_credit(F.col("a"), F.col("gold")), 6).alias("credit"))


@R.add(f"with {_P}, g as (select gold, avg(case when top_a = gold then 1.0 else 0.0 end) as acc from tops group by gold) select round(avg(greatest(0, least(1, (acc - 0.25) / 0.75))), 6) as macro_skill, round(avg(acc), 6) as macro_accuracy from g")
def macro_skill(spark: SparkSession, folder: str) -> DataFrame:
    """Skill over chance, averaged over the groups."""
    hit = (D.first_maximum(F.col("pa")) == F.col("gold")).cast("double")
    per = _systems(spark, folder).groupBy("gold").agg(F.avg(hit).alias("acc"))
    return per.agg(F.round(F.avg(scoring.skill(F.col("acc"), F.lit(0.25))), 6).alias("macro_skill"), F.round(F.avg("acc"), 6).alias("macro_accuracy"))


@R.add(f"""with {_P}, second as (select vec_id, max(pa) filter (where k <> top_a) as sa, max(pb) filter (where k <> top_b) as sb, sum(abs(pa - pb)) as gap, max(abs(pa - pb)) as top_gap from p join (select vec_id, top_a, top_b from tops) using (vec_id) group by vec_id)
    select count(*) as n, round(avg(case when top_a = top_b then 1.0 else 0.0 end), 6) as agreement,
        count(*) filter (where top_a <> top_b and least(ca - sa, cb - sb) < 0.05) as near_ties, count(*) filter (where top_a <> top_b and least(ca - sa, cb - sb) >= 0.05) as clear_differences,
        round(avg(gap / 4), 6) as mean_gap, round(max(top_gap), 6) as max_gap, round(avg(gap / 2), 6) as mean_variation from tops join second using (vec_id)""")
def agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How far two systems agree."""
    a = scoring.agreement(_systems(spark, folder), "pa", "pb")
    return a.select("n", F.round("agreement", 6).alias("agreement"), "near_ties", "clear_differences", *[F.round(c, 6).alias(c) for c in ("mean_gap", "max_gap", "mean_variation")])


@R.add(f"with {_P} select count(*) filter (where top_a = gold and top_b = gold) as both, count(*) filter (where top_a = gold and top_b <> gold) as only_a, count(*) filter (where top_a <> gold and top_b = gold) as only_b, count(*) filter (where top_a <> gold and top_b <> gold) as neither from tops")
def discordant(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of two systems against each other."""
    hit = lambda p: D.first_maximum(F.col(p)) == F.col("gold")
    return scoring.discordance(_systems(spark, folder), hit("pa"), hit("pb"))


_Z = 1.959963984540054
_WILSON = f"""case when k = 0 then 0.0 else greatest(0, (p + {_Z}*{_Z}/(2*n) - {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n))) / (1 + {_Z}*{_Z}/n)) end"""


@R.add(f"""with c as (select track, count(*) filter (where status = 'ok') as k, count(*) as n, count(*) filter (where status = 'ok')::double / count(*) as p from deliveries group by track)
    select track, k, n, round({_WILSON}, 6) as low, round(case when k = n then 1.0 else least(1, (p + {_Z}*{_Z}/(2*n) + {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4*n*n))) / (1 + {_Z}*{_Z}/n)) end, 6) as high from c""")
def wilson(spark: SparkSession, folder: str) -> DataFrame:
    """Interval of the share of good messages per track."""
    c = table(spark, folder, "deliveries").groupBy("track").agg(F.count_if(F.col("status") == "ok").alias("k"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return c.select("track", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@R.add("""with r as (select c_mktsegment, c_acctbal, c_nationkey, rank() over (partition by c_mktsegment order by c_acctbal) + (count(*) over (partition by c_mktsegment, c_acctbal) - 1) / 2.0 as rx,
        rank() over (partition by c_mktsegment order by c_nationkey) + (count(*) over (partition by c_mktsegment, c_nationkey) - 1) / 2.0 as ry from customer)
    select c_mktsegment, count(*) as n, round(corr(rx, ry), 6) as rho from r group by c_mktsegment""")
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation per segment, ties sharing their mean rank."""
    return S.spearman(table(spark, folder, "customer"), "c_acctbal", "c_nationkey", ["c_mktsegment"]).select("c_mktsegment", "n", F.round("rho", 6).alias("rho"))


@R.add("""with c as (select source, count(*) as n, count(*) filter (where lang = 'en' and length(text) > 800) as tp, count(*) filter (where coalesce(lang, '') <> 'en' and length(text) > 800) as fp, count(*) filter (where lang = 'en' and length(text) <= 800) as fn from documents where text is not null group by source)
    select source, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(2 * ((tp + fn)::double / n) / (1 + (tp + fn)::double / n), 6) as chance from c""")
def f1_prevalence(spark: SparkSession, folder: str) -> DataFrame:
    """F1 of a rule against always saying yes."""
    d = table(spark, folder, "documents").where("text is not null")
    f = scoring.f1_against_prevalence(d, F.coalesce(F.col("lang") == "en", F.lit(False)), F.length("text") > 800, ["source"])
    return f.select("source", F.round("f1", 6).alias("f1"), F.round("chance", 6).alias("chance"))


@R.add(f"""with {_P}, mix as (select vec_id, gold, arg_max(k, (pa + pb) * 1e6 - k * 1e-9) as top from p group by vec_id, gold),
    acc as (select avg(case when top_a = gold then 1.0 else 0.0 end) as a, avg(case when top_b = gold then 1.0 else 0.0 end) as b from tops), both_ as (select avg(case when top = gold then 1.0 else 0.0 end) as m from mix)
    select 'a' as a, 'b' as b, round(m, 6) as accuracy, round(m - greatest(acc.a, acc.b), 6) as gain from acc, both_""")
def pair_gains(spark: SparkSession, folder: str) -> DataFrame:
    """Gain of the mean of two systems over the better one."""
    s, gold = _systems(spark, folder), F.col("gold")
    g = scoring.pair_gains(s, "vec_id", {x: D.first_maximum(F.col(f"p{x}")) == gold for x in "ab"}, {x: F.col(f"p{x}") for x in "ab"}, gold)
    return g.select("a", "b", F.round("accuracy", 6).alias("accuracy"), F.round("gain", 6).alias("gain"))


@R.add(f"""with {_P}, h as (select vec_id, ('0x' || right(sha256(vec_id::varchar), 1))::bigint % 2 as half from embeddings),
    w as (select p.vec_id, gold, half, wt / 10.0 as weight, arg_max(k, (wt / 10.0 * pa + (1 - wt / 10.0) * pb) * 1e6 - k * 1e-9) as top from p join h using (vec_id), range(11) r(wt) group by p.vec_id, gold, half, wt),
    a as (select weight, avg(case when top = gold then 1.0 else 0.0 end) filter (where half = 0) as fitted, avg(case when top = gold then 1.0 else 0.0 end) filter (where half = 1) as held_out from w group by weight)
    select weight, round(fitted, 6) as fitted, round(held_out, 6) as held_out from a order by round(fitted, 12) desc, weight limit 1""")
def weight_grid_heldout(spark: SparkSession, folder: str) -> DataFrame:
    """Weight fitted on one half, measured on the other."""
    w = scoring.weight_grid(_systems(spark, folder), F.col("pa"), F.col("pb"), F.col("gold"), H.half(F.col("vec_id")))
    return w.select("weight", F.round("fitted", 6).alias("fitted"), F.round("held_out", 6).alias("held_out"))


@R.add(f"""with {_P}, t as (select *, unnest([0.3, 0.4, 0.5, 0.6]::double[]) as threshold from tops),
    g as (select threshold, gold, avg(case when (case when ca < threshold then top_b else top_a end) = gold then 1.0 else 0.0 end) as acc, count(*) filter (where ca < threshold) as sent, count(*) as n from t group by threshold, gold)
    select threshold, round(avg(acc), 6) as macro, round(sum(sent) / sum(n), 6) as sent from g group by threshold""")
def gate_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy when unsure rows go to the other system."""
    s, gold = _systems(spark, folder), F.col("gold")
    c = scoring.gate_curve(s, F.array_max("pa"), D.first_maximum(F.col("pa")) == gold, D.first_maximum(F.col("pb")) == gold, "gold", [0.3, 0.4, 0.5, 0.6])
    return c.select("threshold", F.round("macro", 6).alias("macro"), F.round("sent", 6).alias("sent"))


#: The reference's thresholds: 0 is the first system alone, above 1 the second alone.
_GATES = [0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.01]


@R.add(f"""with {_P}, t as (select *, unnest({_GATES}::double[]) as threshold from tops),
    g as (select threshold, gold, avg(case when (case when ca < threshold then top_b else top_a end) = gold then 1.0 else 0.0 end) as acc, count(*) filter (where ca < threshold) as sent, count(*) as n from t group by threshold, gold)
    select threshold, round(avg(acc), 6) as macro, round(sum(sent) / sum(n), 6) as sent from g group by threshold""")
def gate_curve_full(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy at each of the reference's ten thresholds when unsure rows go to the other system."""
    s, gold = _systems(spark, folder), F.col("gold")
    c = scoring.gate_curve(s, F.array_max("pa"), D.first_maximum(F.col("pa")) == gold, D.first_maximum(F.col("pb")) == gold, "gold", _GATES)
    return c.select("threshold", F.round("macro", 6).alias("macro"), F.round("sent", 6).alias("sent"))


@R.add("""with a as (select o_orderpriority as area, avg(o_totalprice) as m from orders group by 1), w(area, w) as (values ('1-URGENT', 3.0), ('2-HIGH', 2.0), ('3-MEDIUM', 1.0), ('no such', 5.0))
    select count(*) as areas, round(sum(w * m) / sum(w), 4) as index from a join w using (area)""")
def weighted_index(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted mean of area means; the weight of an absent area is shared out."""
    i = scoring.weighted_index(table(spark, folder, "orders"), "o_orderpriority", F.col("o_totalprice"), {"1-URGENT": 3, "2-HIGH": 2, "3-MEDIUM": 1, "no such": 5})
    return i.select("areas", F.round("index", 4).alias("index"))


@R.add("select d.doc_id, d.topic, count(l.level) as ratings, round(avg(l.level), 6) as level from documents d left join level_labels l on l.doc_id = d.doc_id group by d.doc_id, d.topic")
def missing_label_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their ratings, also those without."""
    per = table(spark, folder, "level_labels").groupBy("doc_id").agg(F.count("level").alias("ratings"), F.avg("level").alias("level"))
    d = table(spark, folder, "documents").select("doc_id", "topic").join(per, "doc_id", "left")
    return d.select("doc_id", "topic", F.coalesce("ratings", F.lit(0)).alias("ratings"), F.round("level", 6).alias("level"))


@R.add("select d.source, round(avg(case when l.doc_id is not null then 1.0 else 0.0 end), 6) as coverage from documents d left join (select distinct doc_id from level_labels where level is not null) l on l.doc_id = d.doc_id group by d.source")
def label_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Share of documents with a rating per source."""
    rated = table(spark, folder, "level_labels").where("level is not null").select("doc_id").distinct().withColumn("one", F.lit(1))
    d = table(spark, folder, "documents").select("doc_id", "source").join(rated, "doc_id", "left")
    return d.groupBy("source").agg(F.round(F.avg(F.when(F.col("one").isNotNull(), 1.0).otherwise(0.0)), 6).alias("coverage"))


@R.add("select doc_id, count(distinct level) as values from level_labels group by doc_id having count(distinct level) > 1")
def conflicting_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that two raters rated differently."""
    return labels.conflicting_labels(table(spark, folder, "level_labels"), ["doc_id"], "level")


@R.add("select d.doc_id, l.pairs from documents d join (select doc_id, string_agg(rater || '=' || level::varchar, ',' order by rater) as pairs from (select doc_id, rater, min(level) as level from level_labels where level is not null group by doc_id, rater) group by doc_id) l using (doc_id)")
def pivoted_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings of each rated document by rater, in the order of raters; of different ratings by one rater the lowest, as ``pivot_labels`` refuses them. Ratings without a rater are left out of the list, which is null where there is no other."""
    rated = table(spark, folder, "level_labels").where("level is not null")
    d = table(spark, folder, "documents").select("doc_id").join(rated.select("doc_id"), "doc_id", "left_semi")
    one = rated.where("rater is not null").groupBy("doc_id", "rater").agg(F.min("level").alias("level"))
    entries = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return labels.pivot_labels(d, one, ["doc_id"], "rater", "level").select("doc_id", F.when(F.size("labels") > 0, F.array_join(entries, ",")).alias("pairs"))


@R.add("select d.doc_id from documents d where not exists (select 1 from level_labels l where l.doc_id = d.doc_id)")
def anti_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that nobody rated."""
    return table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "level_labels").select("doc_id"), "doc_id", "left_anti")


@R.add("select doc_id from level_labels group by doc_id having count(distinct rater) = 2")
def usable_in_all(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that two raters rated."""
    return scoring.usable_in_all(table(spark, folder, "level_labels"), "doc_id", "rater", 2)


@R.add()
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """95 % intervals of the macro accuracy of the first system, of the second and of their difference, by a paired stratified bootstrap of 10,000 replicates."""
    hit = lambda p: (D.first_maximum(F.col(p)) == F.col("gold")).cast("int")
    hits = _systems(spark, folder).select("gold", hit("pa").alias("a"), hit("pb").alias("b"))
    drawn = S.paired_bootstrap(hits, "a", "b", "gold")
    ends = []
    for value, name in ((F.col("first"), ""), (F.col("second"), "_b"), (F.round(F.col("first") - F.col("second"), 12), "_difference")):
        ends += [S.rank_percentile(F.collect_list(value), share, upper=upper).alias(f"{end}{name}") for end, share, upper in (("low", 0.025, False), ("high", 0.975, True))]
    return drawn.agg(*ends, F.count("*").alias("replicates"))


@R.add()
def permutation_pvalue(spark: SparkSession, folder: str) -> DataFrame:
    """Permutation p of the rank correlation of nations' suppliers and customers (at most 25 nations, collected)."""
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"))
    s = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("k")).count().withColumnRenamed("count", "s")
    c = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("k")).count().withColumnRenamed("count", "c")
    rows = n.join(s, "k").join(c, "k").orderBy("k").collect()
    return spark.createDataFrame([(len(rows), S.permutation_p([(r["s"], r["c"]) for r in rows]) if len(rows) > 1 else None)], "n int, p double")


@R.add("""with o as (select * from (values (1, [0, 1, 2, 3]), (2, [3, 2, 1, 0]), (3, [2, 3, 0, 1])) t(view, ord)) select view, array_to_string(ord, ',') as shown from o""")
def view_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The orders in which a question of four options is shown in three views."""
    return spark.createDataFrame([(i + 1, ",".join(map(str, o))) for i, o in enumerate(D.view_orders(4, 3))], "view int, shown string")


@R.add(f"with {_P} select vec_id, k::int as k, round(pa, 6) as p from p")
def tta_views_restored(spark: SparkSession, folder: str) -> DataFrame:
    """A distribution seen in three orders, each brought back, and averaged: the distribution again."""
    orders = D.view_orders(4, 3)
    mean = D.average_of_views([(D.shown_in(F.col("pa"), o), o) for o in orders])
    return _systems(spark, folder).select("vec_id", F.posexplode(mean).alias("k", "p")).select("vec_id", "k", F.round("p", 6).alias("p"))


@R.add(f"""with {_P}, q as (select p.*, case when vec_id % 3 = 0 then 'choice' when vec_id % 3 = 1 then 'score' else 'noul' end as type from p),
    mixed as (select vec_id, k, case type when 'choice' then (3 * pa + pb) / 4 when 'score' then pb else sqrt(greatest(pa, 1e-12) * greatest(pb, 1e-12)) end as x from q)
    select vec_id, k::int as k, round(x / sum(x) over (partition by vec_id), 6) as p from mixed""")
def combine_by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Two systems combined by the recipe of each type of question: a weighted mean, one of them, a log pool."""
    stated = {"method": "mean", "teachers": {"a": {"weight": 3}, "b": {}}, "by_question_type": {"score": {"method": "single", "teacher": "b"}, "noul": {"method": "logpool", "teachers": {"a": {"weight": 1}, "b": {}}}}}
    kind = F.element_at(F.array(F.lit("choice"), F.lit("score"), F.lit("noul")), (F.col("vec_id") % 3 + 1).cast("int"))
    mixed = labels.combine_by_type(kind, {"a": F.col("pa"), "b": F.col("pb")}, {}, labels.recipes(stated, ("choice", "score", "noul")))
    return _systems(spark, folder).select("vec_id", F.posexplode(mixed).alias("k", "p")).select("vec_id", "k", F.round("p", 6).alias("p"))


@R.add()
def cluster_bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """95 % interval of the share of good messages, whole groups resampled."""
    d = table(spark, folder, "deliveries").select("group_id", F.coalesce(F.col("status") == "ok", F.lit(False)).cast("int").alias("ok"), F.lit(1).alias("one"))
    return S.interval(S.cluster_bootstrap(d, "group_id", "ok", "one"), "share")


@R.add()
def skill_bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """95 % interval of the difference of two systems' skill over chance, averaged over the labels as sources."""
    s = _systems(spark, folder)
    credit = lambda p: D.tie_credit(F.col(p), F.col("gold"))
    rows = s.select("gold", credit("pa").alias("a"), credit("pb").alias("b"), F.lit(0.25).alias("c"))
    return S.interval(S.skill_bootstrap(rows, "gold", "a", "b", "c"), "difference")

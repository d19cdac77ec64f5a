"""Incremental reports, statistics, selection and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import checks, classify, incremental, selection, sources_text, statistics
from .registry import query

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("""
with p as (select unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) variant),
m as (select o_custkey, o_orderpriority variant, count(*) n from orders group by 1, 2)
select c.c_custkey, p.variant, m.n from customer c cross join p left join m on m.o_custkey = c.c_custkey and m.variant = p.variant""")
def matrix_expand(t):
    matrix = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("variant")).agg(F.count(F.lit(1)).alias("n"))
    return incremental.expand(t.customer, matrix, ["c_custkey"], PRIORITIES)


_FACTS = """
with p as (select unnest(['manual', 'auto', 'auto-100', 'improved', 'adopted', 'agentic']) variant, unnest(['', '1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) pr),
b as (select o_custkey, count(*) base, count(*) filter (o_orderstatus = 'F') fin from orders group by 1),
m as (select o_custkey, o_orderpriority pr, count(*) n, count(*) filter (o_orderstatus = 'O') o, max(o_totalprice) top from orders group by 1, 2),
f as (select c.c_custkey, p.variant, coalesce(b.fin, 0) > 0 verified, m.n is not null has_row, coalesce(m.o, 0) > 0 hit, coalesce(m.n, 0) <> 2 same_id, coalesce(m.o, 0) = 1 same_universe,
  case when m.top > 400000 then 'failed' else 'passed' end test_status, coalesce(b.fin, 0) manual_lines, coalesce(b.fin, 0) + coalesce(m.o, 0) - case when m.n > 4 then 3 else 0 end combined, coalesce(b.base, 0) total
  from customer c cross join p left join b on b.o_custkey = c.c_custkey left join m on m.o_custkey = c.c_custkey and m.pr = p.pr),
s as (select *, case when not verified then 'unavailable' when variant = 'manual' then 'baseline' when not has_row then 'unavailable' when not hit then 'measured_no_target_hit'
  when not same_id then (case when same_universe then 'measured_equivalent_target_lines' else 'incompatible_target_cut' end) when combined < manual_lines then 'unavailable' else 'measured' end measurement_status from f),
i as (select *, case when measurement_status in ('measured', 'measured_equivalent_target_lines') then combined - manual_lines when measurement_status in ('baseline', 'measured_no_target_hit') then 0 end incremental_lines from s)
select c_custkey, variant, measurement_status, incremental_lines::bigint incremental_lines,
  round(case when incremental_lines is not null then (case when total > 0 then 100.0 * incremental_lines / total else 0 end) end, 6) incremental_line_percentage,
  measurement_status not in ('unavailable', 'incompatible_target_cut') and (test_status = 'passed' or variant = 'manual') analysis_eligible from i
"""


@query(_FACTS)
def incremental_status(t):
    c = F.col
    # One aggregate of the orders; what is known of a customer as a whole is summed from it, over the same shuffle.
    counts = {"n": F.count(F.lit(1)), "o": F.count_if(c("o_orderstatus") == "O"), "f": F.count_if(c("o_orderstatus") == "F"), "top": F.max("o_totalprice")}
    by = t.orders.groupBy(c("o_custkey").alias("c_custkey"), c("o_orderpriority").alias("pr")).agg(*[v.alias(k) for k, v in counts.items()])
    base = by.groupBy("c_custkey").agg(F.sum("n").alias("base"), F.sum("f").alias("fin"))
    names = dict(zip(PRIORITIES, incremental.VARIANTS[1:], strict=True))
    matrix = by.withColumn("variant", F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c("pr")])
    rows = incremental.expand(t.customer, matrix, ["c_custkey"]).join(base, "c_custkey", "left")
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    combined = zero("fin") + zero("o") - F.when(c("n") > 4, 3).otherwise(0)
    none = F.lit(0).cast("long")
    rows = rows.select(
        "c_custkey", "variant", (zero("fin") > 0).alias("target_verified"), c("n").isNotNull().alias("has_row"), (zero("o") > 0).alias("has_target_hit"), (zero("n") != 2).alias("same_class_id"),
        (zero("o") == 1).alias("same_universe"), F.when(c("top") > 400000, "failed").otherwise("passed").alias("test_status"), zero("fin").alias("manual_lines"), combined.alias("combined_lines"),
        zero("base").alias("line_total"), zero("base").alias("combined_line_total"), *[none.alias(x) for x in ("manual_branches", "combined_branches", "branch_total", "combined_branch_total")],
    )
    out = incremental.status(rows)
    return out.select("c_custkey", "variant", "measurement_status", c("incremental_lines").cast("long").alias("incremental_lines"), F.round("incremental_line_percentage", 6).alias("incremental_line_percentage"), "analysis_eligible")


@query("""
select o_orderpriority, count(v) n, count(*) filter (v > 0) n_positive, round(sum(v), 2) total, round(quantile_cont(v, 0.25), 4) q1,
  round(quantile_cont(v, 0.5), 4) median, round(quantile_cont(v, 0.75), 4) q3 from (select o_orderpriority, case when o_orderkey % 40 > 0 then o_totalprice end v from orders) group by 1""")
def variant_quartiles(t):
    """Some values are NaN, which counts as none."""
    rows = t.orders.withColumn("v", F.when(F.col("o_orderkey") % 40 > 0, F.col("o_totalprice")).otherwise(float("nan")))
    out = statistics.quartiles(rows, ["o_orderpriority"], "v")
    return out.select("o_orderpriority", "n", "n_positive", F.round("total", 2).alias("total"), *[F.round(x, 4).alias(x) for x in ("q1", "median", "q3")])


_PIVOT = """
with m as (select c.c_nationkey k, o_orderpriority p, count(*)::double v from orders join customer c on c.c_custkey = o_custkey group by 1, 2),
w as (select k, coalesce(max(v) filter (p = '1-URGENT'), 0) a, coalesce(max(v) filter (p = '2-HIGH'), 0) b, coalesce(max(v) filter (p = '3-MEDIUM'), 0) c from m group by 1)
"""


def _wide(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    wide = rows.groupBy(F.col("c_nationkey").alias("k")).pivot("o_orderpriority", list(PRIORITIES[:3])).count()
    return wide.select("k", *[F.coalesce(F.col(p), F.lit(0)).cast("double").alias(x) for p, x in zip(PRIORITIES, "abc", strict=False)])


@query(_PIVOT + "select k, tol, array_to_string(list_filter([case when a >= greatest(a, b, c) * (1 - tol) then 'a' end, case when b >= greatest(a, b, c) * (1 - tol) then 'b' end, case when c >= greatest(a, b, c) * (1 - tol) then 'c' end], lambda x: x is not null), '=') best from w, (select unnest([0.0::double, 0.05::double, 0.1::double, 0.15::double]) tol)")
def category_tolerance(t):
    cells = F.array(*[F.struct(F.lit(x).alias("tol"), scalars.best_set(list("abc"), [F.col(y) for y in "abc"], x).alias("best")) for x in (0.0, 0.05, 0.1, 0.15)])
    return _wide(t).select("k", F.inline(cells))


@query(_PIVOT + """, o as (select k, unnest([{'v': -a, 'i': 0, 'n': 'a'}, {'v': -b, 'i': 1, 'n': 'b'}, {'v': -c, 'i': 2, 'n': 'c'}]) s from w),
l as (select k, s.v v, s.i i, s.n n, lag(s.v) over (partition by k order by s.v, s.i) p from o)
select k, string_agg(case when p is null then '' when p = v then ' = ' else ' > ' end || n, '' order by v, i) as ordering from l group by 1""")
def exact_ordering(t):
    return _wide(t).select("k", scalars.ordering(list("abc"), [F.col(y) for y in "abc"]).alias("ordering"))


@query(_PIVOT + """
select 'all' g, count(*) filter (a = b) identical, count(*) filter (a <> b and abs(b - a) > greatest(a, b) * 0.1 and b < a) left_wins, count(*) filter (a <> b and abs(b - a) <= greatest(a, b) * 0.1) ties,
  count(*) filter (a <> b and abs(b - a) > greatest(a, b) * 0.1 and b > a) right_wins, round(avg(case when b > a then 1.0 when a = b then 0.5 else 0.0 end), 6) p_superior,
  arg_min(k, {'d': b - a, 'k': k}) least_target, arg_max(k, {'d': b - a, 'k': k}) most_target from w""")
def pairwise_tie(t):
    out = statistics.pair_summary(_wide(t).withColumn("g", F.lit("all")), ["g"], "a", "b", "k")
    return out.withColumn("p_superior", F.round("p_superior", 6))


@query("""
with p as (select c_nationkey, c_mktsegment, (count(*) filter (c_acctbal < 0) + 1)::double / (count(*) * 20 + 1) p from customer group by 1, 2),
s as (select *, least(1.0, p * (count(*) over (partition by c_nationkey) - row_number() over (partition by c_nationkey order by p, c_mktsegment) + 1)) step from p)
select c_nationkey, c_mktsegment, round(max(step) over (partition by c_nationkey order by p, c_mktsegment rows unbounded preceding), 9) p_holm from s""")
def holm(t):
    p = (F.count_if(F.col("c_acctbal") < 0) + 1).cast("double") / (F.count(F.lit(1)) * 20 + 1)
    rows = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(p.alias("p"))
    return statistics.holm(rows, ["c_nationkey"], "p", "c_mktsegment").select("c_nationkey", "c_mktsegment", F.round("p_holm", 9).alias("p_holm"))


@query("""
with r as (select s_suppkey, s_nationkey, floor(s_acctbal / 2000)::bigint v from supplier)
select s_suppkey, rank() over (partition by s_nationkey order by v) + (count(*) over (partition by s_nationkey, v) - 1) / 2.0::double midrank from r""")
def midranks(t):
    rows = t.supplier.withColumn("v", F.floor(F.col("s_acctbal") / 2000).cast("long"))
    return statistics.midranks(rows, ["s_nationkey"], "v").select("s_suppkey", F.col("midrank").cast("double").alias("midrank"))


def _differences(t):
    rows = t.orders.where("o_orderstatus in ('F', 'O')").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment", "c_custkey").agg((F.count_if(F.col("o_orderstatus") == "O") - F.count_if(F.col("o_orderstatus") == "F")).alias("d"))


@query("""
with d as (select c_mktsegment, c_custkey, count(*) filter (o_orderstatus = 'O') - count(*) filter (o_orderstatus = 'F') d from orders join customer on c_custkey = o_custkey where o_orderstatus in ('F', 'O') group by 1, 2),
r as (select *, rank() over (partition by c_mktsegment order by abs(d)) + (count(*) over (partition by c_mktsegment, abs(d)) - 1) / 2.0 rk from d where d <> 0),
t as (select c_mktsegment, sum(n * n * n - n)::double ties from (select c_mktsegment, abs(d) a, count(*) n from r group by 1, 2) group by 1),
s as (select c_mktsegment, count(*) n, sum(rk) filter (d > 0) w_plus, sum(rk) filter (d < 0) w_minus from r group by 1)
select c_mktsegment, n, w_plus::double w_plus, w_minus::double w_minus, least(w_plus, w_minus)::double w, ties,
  round((least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) z from s join t using (c_mktsegment)""")
def wilcoxon_sums(t):
    out = statistics.wilcoxon_sums(_differences(t), ["c_mktsegment"], "d")
    return out.select("c_mktsegment", "n", *[F.col(x).cast("double").alias(x) for x in ("w_plus", "w_minus", "w", "ties")], F.round("z", 6).alias("z"))


@query("""
with z as (select c_mktsegment, c_nationkey, round((avg(c_acctbal) - 4500) / 700, 4)::double z from customer group by 1, 2)
select c_mktsegment, c_nationkey, z, round(1 - 2 / sqrt(pi()) * (select sum(exp(-power((k + 0.5) * (abs(z) / sqrt(2)) / 20000, 2))) * (abs(z) / sqrt(2)) / 20000 from unnest(range(0, 20000)) v(k)), 6) p from z""")
def normal_tail(t):
    """Two-sided p of groups' scores, against a sum of midpoints in the SQL."""
    rows = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.round((F.avg("c_acctbal") - 4500) / 700, 4).alias("z"))
    return rows.withColumn("p", F.round(statistics.normal_p(F.col("z")), 6))


@query("""
with m as (select n_regionkey, floor((median(s_acctbal) - 4500) / 500) d from nation join supplier on n_nationkey = s_nationkey group by n_regionkey, n_nationkey),
r as (select n_regionkey, d, rank() over w + (count(*) over (partition by n_regionkey, abs(d)) - 1) / 2.0 r, row_number() over (partition by n_regionkey order by abs(d)) - 1 i from m where d <> 0 window w as (partition by n_regionkey order by abs(d))),
g as (select n_regionkey, count(*) n, least(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end)) w from r group by 1),
s as (select g.n_regionkey, b, sum(case when (b >> i::int) & 1 = 1 then r else 0 end) x from g join r using (n_regionkey), unnest(range(0, 1 << 10)) u(b) where b < (1 << g.n::int) group by 1, 2)
select k.n_regionkey, coalesce(g.n, 0) n, coalesce((select least(1.0, 2.0 * count(*) filter (x <= g.w) / count(*)) from s where s.n_regionkey = k.n_regionkey), 1.0)::double p from (select distinct n_regionkey from m) k left join g on g.n_regionkey = k.n_regionkey""")
def wilcoxon_exact_p(t):
    """Nations of suppliers' balances against the mean: small groups, of which the SQL tries all signs."""
    rows = t.nation.join(statistics.quantiles(t.supplier, ["s_nationkey"], "s_acctbal", {"m": 0.5}), F.col("n_nationkey") == F.col("s_nationkey"))
    return statistics.wilcoxon_exact(rows.select("n_regionkey", F.floor((F.col("m") - 4500) / 500).cast("double").alias("d")), ["n_regionkey"], "d")


@query("""
with n as (select o_custkey, count(*) n from orders group by 1),
x as (select c_mktsegment, floor(c_acctbal / 100) a, n from customer join n on o_custkey = c_custkey),
r as (select c_mktsegment, rank() over (partition by c_mktsegment order by a) + (count(*) over (partition by c_mktsegment, a) - 1) / 2.0 ra,
  rank() over (partition by c_mktsegment order by n) + (count(*) over (partition by c_mktsegment, n) - 1) / 2.0 rn from x)
select c_mktsegment, count(*) n, round(corr(ra, rn), 6) rho from r group by 1""")
def spearman(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    rows = t.customer.withColumn("a", F.floor(F.col("c_acctbal") / 100)).join(n, "c_custkey")
    out = statistics.spearman(rows, ["c_mktsegment"], "a", "n_orders")
    return out.select("c_mktsegment", "n", F.round("rho", 6).alias("rho"))


@query("""
with c as (select user_id item, floor(value / 50)::bigint s, count(*)::double n from events group by 1, 2),
m as (select *, sum(n) over (partition by item) m from c), k as (select * from m where m > 1),
l as (select s, sum(n) f from k group by 1), p as (select s, f, sum(f) over (order by s rows unbounded preceding) - f / 2 pl from l),
o as (select item, any_value(m) m, sum(n * pl) a, sum(n * pl * pl) b from k join p using (s) group by 1),
ob as (select count(*) n_items, sum(2 * (m * b - a * a) / (m - 1)) o from o), e as (select sum(f) n, sum(f * pl) a, sum(f * pl * pl) b from p)
select 'all' g, n_items, round(1 - o / (2 * (n * b - a * a) / (n - 1)), 6) alpha from ob, e""")
def krippendorff_ordinal(t):
    rows = t.events.select(F.lit("all").alias("g"), F.col("user_id").alias("item"), F.col("event_type").alias("rater"), F.floor(F.col("value") / 50).cast("long").alias("s"))
    return statistics.alpha_ordinal(rows, ["g"], "item", "rater", "s").withColumn("alpha", F.round("alpha", 6))


@query("""
with recursive l(k, term, upto) as (select 0, exp(-1.0::double), exp(-1.0::double) union all select k + 1, term / (k + 1), upto + term / (k + 1) from l where k < 11),
d as (select c_mktsegment, rep, c_acctbal, ('0x' || substr(md5('1:' || rep || ':' || c_custkey), 1, 8))::bigint / 4294967296.0::double u from customer, unnest(range(1, 201)) r(rep)),
w as (select c_mktsegment, rep, c_acctbal, (select count(*) from l where upto <= u) w from d),
m as (select c_mktsegment, rep, sum(w * c_acctbal) / sum(w) m from w group by 1, 2)
select c_mktsegment, round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high from m group by 1""")
def bootstrap_ci(t):
    out = statistics.bootstrap_ci(t.customer, ["c_mktsegment"], "c_custkey", "c_acctbal")
    return out.select("c_mktsegment", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""
select lang, count(quality) n, median(quality) median, round(avg(quality), 6) mean, count(*) filter (quality = 0) n_0, count(*) filter (quality = 1) n_1,
  round(count(*) filter (quality = 0) / count(quality), 6) share_0, round(count(*) filter (quality = 1) / count(quality), 6) share_1 from labels join documents using (doc_id) group by 1""")
def rating_summary(t):
    out = statistics.ratings(t.labels.join(t.documents.select("doc_id", "lang"), "doc_id"), ["lang"], "quality", (0, 1))
    return out.select("lang", "n", F.col("median").cast("double").alias("median"), F.round("mean", 6).alias("mean"), "n_0", "n_1", F.round("share_0", 6).alias("share_0"), F.round("share_1", 6).alias("share_1"))


@query("""
select o_orderstatus, count(v) available, count(*) - count(v) unavailable, count(*) filter (v > 0) positive, count(*) filter (v = 0) zero, count(*) filter (v < 0) negative,
  round(avg(v), 6) mean, median(v) median, min(v) least, max(v) most
from (select o_orderstatus, case when o_orderpriority <> '5-LOW' then floor((o_totalprice - 250000) / 50000)::double end v from orders) group by 1""")
def sign_summary(t):
    v = F.when(F.col("o_orderpriority") != "5-LOW", F.floor((F.col("o_totalprice") - 250000) / 50000).cast("double"))
    return statistics.signs(t.orders.select("o_orderstatus", v.alias("v")), ["o_orderstatus"], "v").withColumn("mean", F.round("mean", 6))


@query("""
with a as (select source, lang, count(*)::double n from documents group by 1, 2), s as (select source, lang, n / sum(n) over (partition by source) p from a),
b as (select lang, count(*)::double n from documents group by 1), q as (select lang, n / sum(n) over () q from b)
select source, round(sum(least(p, coalesce(q, 0))), 6) overlap from s left join q using (lang) group by 1""")
def histogram_overlap(t):
    own = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    every = own.groupBy("lang").agg(F.sum("n").alias("n"))
    return statistics.histogram_overlap(own, every, ["source"], "lang").withColumn("overlap", F.round("overlap", 6))


@query("""
with n as (select o_custkey k, count(*) n, sum(o_totalprice) p from orders group by 1), x as (select c_custkey, c_acctbal a, coalesce(n, 0) n, coalesce(p, 0) p from customer left join n on k = c_custkey)
select c_custkey, round((10 * (a - min(a) over ()) / (max(a) over () - min(a) over ()) + 4 * (n - min(n) over ()) / (max(n) over () - min(n) over ()) - 3 * (p - min(p) over ()) / (max(p) over () - min(p) over ())) / 11 * 1000, 4) score from x""")
def minmax_score(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("p"))
    rows = t.customer.join(n, "c_custkey", "left").na.fill(0)
    return statistics.minmax_score(rows, {"c_acctbal": 10, "n": 4, "p": -3}).select("c_custkey", F.round("score", 4).alias("score"))


@query("""
with x as (select p_partkey, p_retailprice v, case when p_size > 10 then p_size::double end s from part)
select p_partkey, round(case when s is not null then (0.8 * v + 0.2 * s) else v end, 6) closeness, round(case when s is not null then (v + s) / 2 else v end, 6) plain from x""")
def weighted_closeness(t):
    s = F.when(F.col("p_size") > 10, F.col("p_size").cast("double"))
    v = F.col("p_retailprice")
    return t.part.select("p_partkey", F.round(scalars.weighted_mean([v, s], [0.8, 0.2]), 6).alias("closeness"), F.round(scalars.mean_of_available(v, s), 6).alias("plain"))


@query("""
with m as (select c_nationkey k, c_mktsegment g, median(c_acctbal) m from customer group by 1, 2), w as (select k, max(m) filter (g = 'BUILDING') a, max(m) filter (g = 'MACHINERY') b, max(m) filter (g = 'FURNITURE') f from m group by 1)
select k, case when b > f then round((a - f) / (b - f), 6) end fit from w""")
def human_fit(t):
    per = statistics.quantiles(t.customer, ["c_nationkey", "c_mktsegment"], "c_acctbal", {"m": 0.5})
    wide = per.groupBy(F.col("c_nationkey").alias("k")).agg(*[F.max(F.when(F.col("c_mktsegment") == s, F.col("m"))).alias(s) for s in ("BUILDING", "MACHINERY", "FURNITURE")])
    return wide.select("k", F.round(scalars.fit(F.col("BUILDING"), F.col("FURNITURE"), F.col("MACHINERY")), 6).alias("fit"))


@query("""
with m as (select n_regionkey r, s_nationkey k, median(s_acctbal) m from supplier join nation on n_nationkey = s_nationkey group by 1, 2)
select r, round(median(m), 4) median_of_medians, count(*) filter (m > 4500) wins, count(*) filter (m < 4500) losses from m group by 1""")
def two_stage_median(t):
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).withColumnRenamed("n_regionkey", "r")
    per = statistics.quantiles(rows, ["r", "s_nationkey"], "s_acctbal", {"m": 0.5})
    middle = statistics.quantiles(per, ["r"], "m", {"median_of_medians": 0.5}).withColumn("median_of_medians", F.round("median_of_medians", 4))
    return middle.join(per, "r").groupBy("r", "median_of_medians").agg(F.count_if(F.col("m") > 4500).alias("wins"), F.count_if(F.col("m") < 4500).alias("losses"))


@query("""
with x as (select o_custkey, count(*) filter (o_orderdate < timestamp '1998-01-01') b, count(*) filter (o_orderdate >= timestamp '1998-01-01') a from orders group by 1)
select o_custkey, b as n_before, a as n_after, a - b as change from x""")
def phase_delta(t):
    phase = F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "before").otherwise("after")
    wide = t.orders.withColumn("phase", phase).groupBy("o_custkey").pivot("phase", ["before", "after"]).count().na.fill(0)
    return wide.select("o_custkey", F.col("before").alias("n_before"), F.col("after").alias("n_after"), (F.col("after") - F.col("before")).alias("change"))


@query("""
with s as (select l_returnflag, count(*) filter (l_discount > 0.05) discount, count(*) filter (l_tax > 0.05) tax, count(*) filter (l_quantity > 40) quantity, count(*) n from lineitem group by 1),
u as (unpivot s on discount, tax, quantity into name smell value k), r as (select *, k::double / n per, k::double / sum(k) over (partition by l_returnflag) share from u)
select l_returnflag, smell, k::bigint k, round(per, 6) per_line, round(share, 6) share from r""")
def smells_unpivot(t):
    c = F.col
    n = t.lineitem.groupBy("l_returnflag").agg(F.count_if(c("l_discount") > 0.05).alias("discount"), F.count_if(c("l_tax") > 0.05).alias("tax"), F.count_if(c("l_quantity") > 40).alias("quantity"), F.count(F.lit(1)).alias("n"))
    rows = n.unpivot(["l_returnflag", "n"], ["discount", "tax", "quantity"], "smell", "k")
    share = c("k") / F.sum("k").over(Window.partitionBy("l_returnflag"))
    return rows.select("l_returnflag", "smell", "k", F.round(c("k") / c("n"), 6).alias("per_line"), F.round(share, 6).alias("share"))


@query("""
with x as (select o_custkey, count(*) n, max(o_orderdate) d from orders group by 1)
select o_custkey, n commit_count, d last_commit from x where n >= 10 and d >= timestamp '2001-08-01' - interval 730 day""")
def select_active(t):
    rows = selection.commit_stats(t.orders, ["o_custkey"], "o_orderdate", 1_000_000)
    return selection.active(rows, "2001-08-01")


@query("""
with s as (select n_name, 'src/main/java/' || n_name || '.java' path from nation), t as (select 'src/test/java/NATION_' || c_nationkey || (case when c_mktsegment = 'BUILDING' then 'Test' when c_mktsegment = 'MACHINERY' then 'IT' else 'Helper' end) || '.java' path from customer)
select s.n_name, array_to_string(list_sort(list(distinct t.path)), ',') tests from s join t on t.path in ('src/test/java/' || s.n_name || 'Test.java', 'src/test/java/' || s.n_name || 'Tests.java', 'src/test/java/' || s.n_name || 'IT.java', 'src/test/java/Test' || s.n_name || '.java') group by 1""")
def name_expansion_join(t):
    suffix = F.when(F.col("c_mktsegment") == "BUILDING", "Test").when(F.col("c_mktsegment") == "MACHINERY", "IT").otherwise("Helper")
    tests = t.customer.select(F.lit(1).alias("g"), F.concat(F.lit("src/test/java/NATION_"), F.col("c_nationkey"), suffix, F.lit(".java")).alias("path"))
    sources = t.nation.select(F.lit(1).alias("g"), "n_name", F.concat(F.lit("src/main/java/"), "n_name", F.lit(".java")).alias("path"))
    return selection.tests_of_sources(sources, tests, ["g"]).select("n_name", F.array_join("test_paths", ",").alias("tests"))


@query("""
with p as (select page_id, regexp_replace(url, '^https?://', '') || (case when page_id < 50 then '/src' when page_id < 99 then '/unit-tests' else '' end) || '/A.java' path from pages)
select page_id, case when len(list_filter(string_split(lower(path), '/'), lambda x: x in ('test', 'tests', 'integration-tests', 'unit-tests') or regexp_matches(x, '^tests?-|-tests?$|^src\\.test|^src[-_]tests'))) > 0 then 'test'
  when list_contains(string_split(lower(path), '/'), 'src') then 'source' end kind from p""")
def test_path_classify(t):
    middle = F.when(F.col("page_id") < 50, "/src").when(F.col("page_id") < 99, "/unit-tests").otherwise("")
    path = F.concat(F.regexp_replace("url", "^https?://", ""), middle, F.lit("/A.java"))
    return t.pages.select("page_id", selection.path_kind(path).alias("kind"))


_LOGS = """
with l as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'A.java:3: error: cannot find symbol' || chr(10) || 'package a.b does not exist' when '2-HIGH' then 'java.lang.AssertionError: x' when '3-MEDIUM' then 'Could not resolve dependencies for a'
  when '4-NOT SPECIFIED' then 'x: incompatible types: int' || chr(10) || 'NoClassDefFoundError: a/B' else '' end || case when o_orderstatus = 'P' then chr(10) || 'class file for a.B not found' || chr(10) || 'OutOfMemoryError' else '' end log from orders)
"""


@query(_LOGS + """select o_orderkey,
  case when trim(log) = '' then 'no_javac_output' when contains(lower(log), 'cannot find symbol') and regexp_matches(lower(log), 'package\\s+[a-z0-9_.$]+\\s+does not exist') then 'missing_symbol_and_package'
    when contains(lower(log), 'class file for') and contains(lower(log), 'not found') then 'missing_class_file' when contains(lower(log), 'incompatible types:') then 'incompatible_types' else 'other_compile_error' end compile_problem,
  case when contains(log, 'AssertionError') then 'assertion_failure' when contains(log, 'NoClassDefFoundError') then 'missing_runtime_dependency' when contains(log, 'Error:') or contains(log, 'Exception:') then 'runtime_error' else 'test_process_failed' end run_failure,
  case when contains(lower(log), 'could not resolve dependencies') then 'DEPS_RESOLUTION' else 'UNKNOWN' end build_failure,
  case when contains(log, 'NoClassDefFoundError') or contains(log, 'cannot find symbol') then 'missing_class_or_dep' when contains(log, 'OutOfMemoryError') then 'oom' else 'other' end generator_failure from l""")
def log_classifiers(t):
    head = {
        "1-URGENT": "A.java:3: error: cannot find symbol\npackage a.b does not exist", "2-HIGH": "java.lang.AssertionError: x", "3-MEDIUM": "Could not resolve dependencies for a",
        "4-NOT SPECIFIED": "x: incompatible types: int\nNoClassDefFoundError: a/B", "5-LOW": "",
    }
    first = F.create_map(*[F.lit(x) for kv in head.items() for x in kv])[F.col("o_orderpriority")]
    log = F.concat(first, F.when(F.col("o_orderstatus") == "P", "\nclass file for a.B not found\nOutOfMemoryError").otherwise(""))
    rows = t.orders.select("o_orderkey", log.alias("log"))
    kinds = {"compile_problem": classify.compile_problem, "run_failure": classify.run_failure, "build_failure": classify.build_failure, "generator_failure": classify.generator_failure}
    return rows.select("o_orderkey", *[f(F.col("log")).alias(n) for n, f in kinds.items()])


@query("select event_id, (props->>'k')::int k, coalesce(props->>'missing', 'none') missing from events")
def json_extract(t):
    return t.events.select("event_id", scalars.json_path(F.col("props"), "$.k").cast("int").alias("k"), scalars.json_path(F.col("props"), "$.missing", "none").alias("missing"))


@query("select page_id, nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') title from pages")
def tag_extract(t):
    wrapped = F.regexp_replace(F.regexp_replace("html", "<title>", "[TITLE]"), "</title>", "[/TITLE]")
    return t.pages.select("page_id", scalars.first_tagged(wrapped, "TITLE").alias("title"))


@query("select distinct l_partkey as key from lineitem where l_partkey not in (select p_partkey from part where p_size > 5)")
def orphan_parts(t):
    return checks.orphans(t.lineitem, t.part.where("p_size > 5"), "l_partkey", "p_partkey")


@query("select l_orderkey, l_partkey, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def duplicate_keys(t):
    return checks.duplicates(t.lineitem, ["l_orderkey", "l_partkey"])


@query("""
with a as (select distinct o_custkey from orders where o_orderstatus = 'F'), b as (select distinct o_custkey from orders where o_orderstatus = 'O')
select o_custkey, 'left' side from a where o_custkey not in (select o_custkey from b) union all select o_custkey, 'right' from b where o_custkey not in (select o_custkey from a)""")
def differing_sets(t):
    return checks.differing_sets(t.orders.where("o_orderstatus = 'F'"), t.orders.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("""
select l_orderkey, l_linenumber, 'quantity' as "check" from lineitem where not l_quantity <= 45 union all select l_orderkey, l_linenumber, 'discount' from lineitem where not l_discount < 0.1""")
def row_violations(t):
    return checks.violations(t.lineitem, ["l_orderkey", "l_linenumber"], {"quantity": F.col("l_quantity") <= 45, "discount": F.col("l_discount") < 0.1})


@query("select o_custkey, count(*) n from orders group by 1 having not count(*) between 5 and 15")
def group_size_violations(t):
    return checks.outside(t.orders, ["o_custkey"], 5, 15)


@query("""
with l as (unpivot (select o_orderstatus, o_totalprice, o_custkey::double o_custkey from orders) on o_totalprice, o_custkey into name metric value v)
select o_orderstatus, metric, count(*) n, round(avg(v), 4) mean, round(stddev_samp(v), 4) sd, round(quantile_cont(v, 0.25), 4) q1, round(quantile_cont(v, 0.5), 4) median, round(quantile_cont(v, 0.75), 4) q3 from l group by 1, 2""")
def described(t):
    out = sources_text.described(t.orders.select("o_orderstatus", "o_totalprice", "o_custkey"), ["o_orderstatus"], ["o_totalprice", "o_custkey"])
    return out.select("o_orderstatus", "metric", "n", *[F.round(x, 4).alias(x) for x in ("mean", "sd", "q1", "median", "q3")])


@query("""
select o_custkey, bool_or(contains(lower(o_orderpriority), 'urgent')) named, bool_or(o_orderstatus = 'F') said from orders group by 1""")
def any_flags(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.lower("o_orderpriority").contains("urgent")).alias("named"), F.bool_or(F.col("o_orderstatus") == "F").alias("said"))


@query("""
select o_orderkey, case when o_orderstatus = 'F' then 'sanitized' when o_orderstatus = 'O' then 'baseline' when o_totalprice > 200000 then 'sanitized' when o_totalprice > 100000 then 'baseline' else 'sanitized' end side,
  case when o_orderstatus = 'F' then 'prefer_sanitized' when o_orderstatus = 'O' then 'fallback_to_baseline' when o_totalprice > 200000 then 'sanitized_failed_without_baseline_recovery' when o_totalprice > 100000 then 'baseline_failed_last_fallback' else 'missing_generated_variant' end reason from orders""")
def result_choice(t):
    passed = lambda s: F.when(F.col("o_orderstatus") == s, "passed").otherwise("failed")
    chosen = sources_text.choose_result(passed("F"), F.col("o_totalprice") > 200000, passed("O"), F.col("o_totalprice") > 100000)
    return t.orders.select("o_orderkey", chosen.alias("c")).select("o_orderkey", "c.side", "c.reason")

"""Operators over run tables, by analogy: orders as runs and snapshots, line items as deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import ranking, stages
from .registry import query

_DELTAS = "with l as (select l_suppkey, l_partkey, min(l_linenumber) a, max(l_linenumber) b, max(l_quantity)::int c from lineitem group by 1, 2)"


def _line_deltas(t):
    """A supplier's part is a test's class: its spec spans the line numbers, with a quantity as one more line."""
    per = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"), F.max("l_quantity").cast("int").alias("c"))
    name = F.concat(F.lit("p"), F.when(F.col("a") == 1, "$x").otherwise(""))
    return per.select("l_suppkey", "l_partkey", name.alias("class_name"), F.concat_ws("-", "b", "a").alias("newly_covered_lines"), F.col("c").cast("string").alias("upgraded_to_full_lines"))


@query(_DELTAS + """
, x as (select l_suppkey, unnest(list_concat(range(a, b + 1), [c])) n from l) select l_suppkey, count(distinct n) target_lines from x group by 1""")
def target_line_counts(t):
    return stages.target_lines(_line_deltas(t), ["l_suppkey"], F.lit("p"))


@query(_DELTAS + """
, x as (select l_suppkey, a = 1 nested, unnest(range(a, b + 1)) n from l) select l_suppkey, round(100.0 * count(distinct (nested, n)) / 20, 6) percentage from x group by 1""")
def target_percentage(t):
    out = stages.target_percentage(_line_deltas(t), ["l_suppkey"], F.lit("p"), F.lit(20))
    return out.select("l_suppkey", F.round("percentage", 6).alias("percentage"))


@query(_DELTAS + """
, d as (select l_suppkey, count(*) added_lines from lineitem group by 1)
select l_suppkey, any_value(added_lines) added_lines, sum(b - a + 1)::bigint target_added_lines, count(*) n_entries from l join d using (l_suppkey) group by 1""")
def method_deltas(t):
    tests = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("added_lines"))
    out = stages.method_deltas(tests, _line_deltas(t), ["l_suppkey"], F.lit("p"))
    return out.select("l_suppkey", "added_lines", "target_added_lines", F.size("entries").cast("long").alias("n_entries"))


@query("""
with f as (select distinct c_custkey k from customer where c_acctbal < 0), d as (select o_custkey, count(*) n from orders group by 1)
select o_custkey, case when o_custkey in (select k from f) then 0 else n end n from d""")
def failed_zeroed(t):
    deltas = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return stages.without_failed(deltas, t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"], ["n"], True)


@query("select o_custkey, count(*) n from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0) group by 1")
def failed_removed(t):
    deltas = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return stages.without_failed(deltas, t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"], ["n"], False)


@query("select o_custkey, min(o_orderkey) o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') group by 1")
def stale_selectors(t):
    methods = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return stages.existing(t.orders.select("o_custkey", "o_orderkey"), methods, ["o_custkey"], "o_orderkey")


@query("""
with t as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders where o_orderstatus <> 'P'), k as (select * from t where r <= 3)
select o_custkey, o_orderkey from k union all select o_custkey, o_orderkey from orders where o_orderstatus = 'P' and o_custkey in (select o_custkey from k)""")
def reduced_class(t):
    methods = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderstatus") != "P").alias("is_test"))
    return stages.reduced(methods, ["o_custkey"], ("-o_totalprice", "o_orderkey"), 3).select("o_custkey", "o_orderkey")


@query("""
select o_custkey, o_orderkey, greatest(n - 2, 0) omitted from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r, count(*) over (partition by o_custkey) n from orders) where r <= 2""")
def annotation_entries(t):
    return stages.shown_and_omitted(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ("-o_totalprice", "o_orderkey")).select("o_custkey", "o_orderkey", "omitted")


@query("""
with r as (select o_custkey, o_orderkey seq, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end tier, strftime(o_orderdate, '%Y%m%d') run_id from orders)
select o_custkey, tier, run_id, seq from (select *, row_number() over (partition by o_custkey order by tier, case when tier < 2 then run_id end desc nulls last, seq) n from r) where n = 1""")
def newest_run(t):
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    runs = t.orders.select("o_custkey", tier.alias("tier"), F.date_format("o_orderdate", "yyyyMMdd").alias("run_id"), F.col("o_orderkey").alias("seq"))
    return stages.newest_run(runs, ["o_custkey"])


@query("""
with x as (select o_custkey, max(o_orderkey) filter (o_orderstatus = 'F') v0, max(o_totalprice) filter (o_orderstatus = 'F') t0, max(o_orderkey) filter (o_orderstatus = 'O') v1, max(o_totalprice) filter (o_orderstatus = 'O') t1 from orders group by 1)
select o_custkey, case when t0 is null then 0 else v0 end as "before", coalesce(t0, t1) before_total, v1 as "after", t1 after_total from x""")
def before_after(t):
    phase = F.when(F.col("o_orderstatus") == "F", "before").when(F.col("o_orderstatus") == "O", "after")
    return stages.before_after(t.orders.withColumn("phase", phase), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("""
with a as (select o_custkey k, list_sort(list(distinct o_orderpriority)) s from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey k, list_sort(list(distinct o_orderpriority)) s from orders where o_orderstatus = 'O' group by 1)
select a.k, len(a.s)::int n from a join b on a.k = b.k and a.s = b.s""")
def same_list_join(t):
    of = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("s"))  # five at most
    return stages.same_list(of("F"), of("O"), ["k"], "s").select("k", F.size("s").alias("n"))


@query("select distinct o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0) or o_custkey in (select o_custkey from orders where o_totalprice > 450000)")
def retry_filter(t):
    low = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return stages.retry(t.orders.select("o_custkey"), [low, t.orders.where("o_totalprice > 450000")], ["o_custkey"]).distinct()


@query("""
with n as (select n_nationkey k, n_regionkey f, coalesce(sum(s_acctbal), 0) v from nation left join supplier on s_nationkey = n_nationkey group by 1, 2)
select a.k, round(a.v, 2) v, round(b.v, 2) floor_value from n a left join n b on a.f = b.k""")
def floor_join(t):
    rows = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("f")).agg(F.coalesce(F.sum("s_acctbal"), F.lit(0.0)).alias("v"))
    return stages.floor_of(rows, "k", "f", "v").select("k", F.round("v", 2).alias("v"), F.round("floor_value", 2).alias("floor_value"))


@query("""
with v as (select unnest(['F', 'O', 'X']) variant), m as (select o_custkey, o_orderstatus variant, count(*) filter (o_totalprice > 200000) n from orders group by 1, 2)
select c.c_custkey, v.variant, coalesce(m.n, 0) n, case when m.variant is null then 'no_row' when m.n <= 0 then 'no_match' end reason from customer c cross join v left join m on m.o_custkey = c.c_custkey and m.variant = v.variant""")
def every_variant(t):
    rows = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("variant")).agg(F.count_if(F.col("o_totalprice") > 200000).alias("n"))
    return stages.every_variant(t.customer, rows, ["c_custkey"], ["F", "O", "X"], ["n"])


@query("""
with w as (select unnest([0.0::double, 0.2::double, 0.5::double]) weight)
select p_type, weight, round(median(case when p_size <= 10 then p_retailprice else p_retailprice * (1 - weight) + p_size * weight end), 6) median from part, w group by 1, 2""")
def closeness_sensitivity(t):
    rows = t.part.withColumn("s", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")))
    return stages.reweighted(rows, ["p_type"], "p_retailprice", "s", [0.0, 0.2, 0.5]).withColumn("median", F.round("median", 6))


@query("""
with p as (select page_id, html, string_split(html, chr(10)) l, regexp_extract_all(html, '[A-Za-z_][0-9A-Za-z_]*') n from pages)
select page_id, len(l)::double lines, round(list_avg(list_transform(l, lambda x: length(x)::double)), 6) mean_line_length,
  round(list_avg(list_transform(n, lambda x: length(x)::double)), 6) mean_name_length, round(len(list_filter(n, lambda x: contains(x, '_'))) / len(n)::double, 6) snake_ratio from p""")
def style_profile(t):
    parts = stages.style_profile(F.col("html"))
    return t.pages.select("page_id", parts["lines"].alias("lines"), *[F.round(parts[k], 6).alias(k) for k in ("mean_line_length", "mean_name_length", "snake_ratio")])


@query("""
with s as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) r from orders), m as (select * from s where r <= 12 and o_orderstatus <> 'P')
select o_custkey, count(*) reviews, round(sum(o_totalprice), 2) total from (select *, row_number() over (partition by o_custkey order by r) k from m) where k <= 5 group by 1""")
def first_reviews(t):
    rows = t.orders.withColumn("merged", F.col("o_orderstatus") != "P")
    kept = stages.first_reviews(rows, ["o_custkey"], ("-o_orderdate", "o_orderkey"), 5, 12)
    return kept.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("reviews"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
with v as (select p_type, p_brand, p_size, p_partkey, regexp_extract(p_brand, '(\\d+)', 1)::int b, p_name from part), r as (select *, case when p_name like 'red%' then 0 else 1 end k from v)
select p_type, arg_max(b || '.' || p_size || '.' || p_partkey, [b, p_size, p_partkey]) version from r join (select p_type, min(k) k from r group by 1) using (p_type, k) group by 1""")
def artifact_winners(t):
    version = F.concat_ws(".", F.regexp_extract("p_brand", r"(\d+)", 1), F.col("p_size"), F.col("p_partkey"))
    rows = t.part.select("p_type", version.alias("version"), F.when(F.col("p_name").startswith("red"), 0).otherwise(1).alias("k"))
    return stages.winners(rows, ["p_type"], "k", "version").select("p_type", "version")


@query("""
select user_id, arg_min(event_id, (case event_type when 'purchase' then 0 when 'error' then 1 else 2 end, event_id)) event_id from events group by 1""")
def source_preference(t):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return ranking.best(t.events.select("user_id", "event_id", "event_type"), ["user_id"], rank, F.col("event_id")).select("user_id", "event_id")


@query("select c_custkey, replace(c_name, '#', '_') || '_' || replace(c_mktsegment, '.', '_') target_id, regexp_replace(c_name, '[^a-zA-Z0-9._-]+', '_', 'g') safe from customer")
def target_keys(t):
    repo = F.translate("c_name", "#", "/")
    return t.customer.select("c_custkey", scalars.target_id(repo, F.col("c_mktsegment")).alias("target_id"), scalars.safe_name(F.col("c_name")).alias("safe"))

"""Coverage, range, ranking and upsert operators over the driver's tables.

A supplier stands for a candidate test (in the order of its key), a part for a unit that a line covers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranges, scalars
from ..operators import coverage, ordered, ranking
from .registry import query


def _units(t):
    lines = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("unit"), "l_quantity")
    return lines.select("l_suppkey", "unit"), lines.where("l_quantity <= 3").select("unit")


@query("""
with base as (select distinct l_partkey unit from lineitem where l_quantity <= 3),
new as (select distinct l_suppkey c, l_partkey unit from lineitem where l_partkey not in (select unit from base)),
owned as (select c, count(*) owned from (select unit, min(c) c from new group by unit) group by c)
select n.c candidate, count(*) added, any_value(o.owned) owned from new n join owned o on n.c = o.c group by n.c""")
def incremental_filter(t):
    candidates, base = _units(t)
    return coverage.incremental_filter(candidates, base, ["unit"], "l_suppkey")


@query("""
with m as (select distinct l_partkey u from lineitem where l_quantity <= 3), c as (select distinct l_partkey u from lineitem)
select (select count(*) from m) n_manual, (select count(*) from c) n_candidate, (select count(*) from c where u not in (select u from m)) n_new""")
def class_level_totals(t):
    candidates, base = _units(t)
    return coverage.class_level(base, candidates, ["unit"])


@query("""
with base as (select distinct l_partkey unit from lineitem where l_quantity <= 3)
select l_partkey unit, min(l_suppkey) "owner" from lineitem where l_partkey not in (select unit from base) group by l_partkey""")
def unit_owners(t):
    candidates, base = _units(t)
    return coverage.owners(candidates, base, ["unit"], "l_suppkey")


@query("select l_partkey unit from lineitem where l_quantity <= 3 union select l_partkey from lineitem where l_discount = 0")
def unit_union(t):
    u = F.col("l_partkey").alias("unit")
    return coverage.union(t.lineitem.where("l_quantity <= 3").select(u), t.lineitem.where("l_discount = 0").select(u))


@query("""
with c as (select l_partkey, count(*) lines, count(distinct l_suppkey) methods from lineitem where l_returnflag = 'N' group by 1),
b as (select l_partkey, count(*) lines, count(distinct l_suppkey) methods from lineitem where l_returnflag = 'R' group by 1)
select * from (select c.l_partkey, c.lines - coalesce(b.lines, 0) lines, c.methods - coalesce(b.methods, 0) methods from c left join b using (l_partkey))
where lines <> 0 or methods <> 0""")
def class_deltas(t):
    def per(flag):
        return t.lineitem.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("l_suppkey").alias("methods"))

    return coverage.class_deltas(per("N"), per("R"), ["l_partkey"], ["lines", "methods"])


@query("""
with s as (select l_partkey, l_linenumber line, max(case when l_linestatus = 'F' then (case when l_quantity > 25 then 2 else 1 end) else 0 end) was,
  max(case when l_quantity > 25 then 2 else 1 end) now from lineitem group by 1, 2)
select l_partkey, count(*) filter (was = 0 and now > 0) n_newly, count(*) filter (was = 1 and now = 2) n_upgraded from s
where (was = 0 and now > 0) or (was = 1 and now = 2) group by 1""")
def line_transitions(t):
    status = F.when(F.col("l_quantity") > 25, 2).otherwise(1)
    after = t.lineitem.groupBy("l_partkey", F.col("l_linenumber").alias("line")).agg(F.max(status).alias("status"))
    before = t.lineitem.where("l_linestatus = 'F'").groupBy("l_partkey", F.col("l_linenumber").alias("line")).agg(F.max(status).alias("status"))
    out = coverage.line_transitions(before, after, ["l_partkey"])
    return out.select("l_partkey", F.size("newly").cast("long").alias("n_newly"), F.size("upgraded").cast("long").alias("n_upgraded"))


@query("""
with c as (select l_orderkey, count(*) lines, count(*) filter (l_returnflag = 'R') branches from lineitem group by 1),
u as (select 'LINE' kind, unnest(range(1, lines + 1)) ord from c union all select 'BRANCH', unnest(range(1, branches + 1)) from c)
select kind, ord::int ordinal, count(*) n from u group by all""")
def unit_construction(t):
    counters = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("branches"))
    return coverage.units(counters, ["l_orderkey"], {"lines": "LINE", "branches": "BRANCH"}).groupBy("kind", "ordinal").agg(F.count(F.lit(1)).alias("n"))


@query("""
select l_suppkey, sum(lines)::bigint lines, sum(methods)::bigint methods from (
  select l_suppkey, l_partkey, count(*) lines, count(distinct l_orderkey) methods from lineitem group by 1, 2) group by 1""")
def delta_totals(t):
    by, n = ["l_suppkey", "l_partkey", "l_orderkey"], t.lineitem.count()
    orders = ordered.dealt(t.lineitem.select(*by), by, n).groupBy(*by).agg(F.count(F.lit(1)).alias("lines"))
    per = ordered.dealt(orders, by[:2], n).groupBy(*by[:2]).agg(F.sum("lines").alias("lines"), F.count("l_orderkey").alias("methods"))
    return coverage.totals(per, ["l_suppkey"], ["lines", "methods"])


@query("""
with a as (select o_custkey k, max(n) line_total, max(m) branch_total from (
  select o_custkey, count(*) n, null m from orders where o_orderstatus = 'F' group by 1 union all
  select o_custkey, count(*) n, count(distinct o_orderpriority) m from orders where o_orderstatus = 'O' group by 1) group by 1)
select k, line_total, branch_total from a""")
def denominators(t):
    by = lambda s: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k"))
    n, m = F.count(F.lit(1)).alias("line_total"), F.count_distinct("o_orderpriority").alias("branch_total")
    return coverage.denominators([by("F").agg(n), by("O").agg(n, m)], ["k"], ["line_total", "branch_total"])


@query("""
select o_custkey, coalesce(max(case when o_orderstatus = 'F' and o_totalprice > 0 then o_totalprice end), max(case when o_orderstatus <> 'F' and o_totalprice > 0 then o_totalprice end), 0) o_totalprice
from orders group by 1""")
def denominator_pick(t):
    return coverage.pick_denominator(t.orders, ["o_custkey"], "o_totalprice", F.col("o_orderstatus") == "F")


@query("""
select c_custkey from customer where c_name = 'Customer#000000001' or starts_with(c_name, 'Customer#000000001' || '0')
union select c_custkey from customer where c_mktsegment = (select c_mktsegment from customer where c_custkey = 7) and c_nationkey = (select c_nationkey from customer where c_custkey = 7)""")
def class_selection(t):
    classes = t.customer.select("c_custkey", "c_name", F.col("c_custkey").alias("class_name"), F.col("c_mktsegment").alias("package"), F.col("c_nationkey").alias("source_file"))
    same = coverage.select_classes(classes, classes.where("class_name = 7")).select("c_custkey")
    target = F.lit("Customer#000000001")
    named = classes.where((F.col("c_name") == target) | F.col("c_name").startswith(F.concat(target, F.lit("0")))).select("c_custkey")
    return same.union(named).distinct()


_RUNS = """
with d as (select distinct l_suppkey, l_orderkey from lineitem),
r as (select *, l_orderkey - row_number() over (partition by l_suppkey order by l_orderkey) run from d)
select l_suppkey, min(l_orderkey) as "start", max(l_orderkey) as "end" from r group by l_suppkey, run"""


@query(_RUNS)
def line_ranges(t):
    return ordered.islands(t.lineitem, ["l_suppkey"], "l_orderkey")


@query("""
with d as (select distinct l_orderkey, l_linenumber n from lineitem where l_returnflag <> 'A'),
r as (select *, n - row_number() over (partition by l_orderkey order by n) run from d),
s as (select l_orderkey, min(n) a, max(n) b from r group by l_orderkey, run)
select l_orderkey, string_agg(case when a = b then a::varchar else a || '-' || b end, ';' order by a) spec from s group by 1""")
def line_spec_encode(t):
    lines = t.lineitem.where("l_returnflag <> 'A'").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("lines"))  # a few lines an order
    return lines.select("l_orderkey", ranges.encode(F.col("lines")).alias("spec"))


@query("""
select p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(p_size, p_size + 4), [p_size + 7, 2]))), ',') lines from part""")
def line_spec_decode(t):
    size = F.col("p_size")
    spec = F.concat_ws(";", F.concat_ws("-", size + 3, size), F.lit("x"), (size + 7).cast("string"), F.lit(" 2 "), F.lit("0"))
    return t.part.select("p_partkey", F.array_join(ranges.decode(spec), ",").alias("lines"))


_SPANS = """
with s as (select user_id, floor(epoch(ts) / 3600)::bigint a, floor(epoch(ts) / 3600)::bigint + floor(value / 100)::bigint b from events),
h as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) held from s),
r as (select *, sum(case when held is null or a > held + 1 then 1 else 0 end) over (partition by user_id order by a, b rows unbounded preceding) run from h),
m as (select user_id, min(a) as "start", max(b) as "end" from r group by user_id, run)
"""


def _event_spans(t):
    hour = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)") / 3_600_000_000)  # down, before 1970 too
    spans = t.events.select("user_id", hour.alias("a"), (hour + F.floor(F.col("value") / 100).cast("long")).alias("b"))
    return ordered.merged(spans, ["user_id"], "a", "b", unknown=True)


@query(_SPANS + "select * from m")
def span_merge(t):
    return _event_spans(t)


@query(_SPANS + 'select user_id, arg_min("start", (("start" - "end"), "start")) as "start", arg_min("end", (("start" - "end"), "start")) as "end" from m group by 1')
def largest_span(t):
    return ranking.largest_span(_event_spans(t), ["user_id"])


@query("""
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders) where r <= 3""")
def topk_per_group(t):
    return ranking.top_k(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ("-o_totalprice", "o_orderkey"), 3)


_DELTAS = """
with d as (select l_partkey target, l_suppkey test_selector, count(*) added_lines, count(distinct l_orderkey) added_methods, count(*) filter (l_returnflag = 'R') added_branches,
  sum(l_quantity)::bigint added_instructions, count(*) filter (l_linestatus = 'F') target_lines, (max(l_discount) > 0.05) measured from lineitem group by 1, 2)
"""


def _deltas(t):
    """Dealt by target, a row for each test; orders are told apart before, so that a test's lines are spread."""
    lines, n = t.lineitem.withColumnsRenamed({"l_partkey": "target", "l_suppkey": "test_selector"}), t.lineitem.count()
    by = ["target", "test_selector", "l_orderkey"]
    orders = ordered.dealt(lines.select(*by, "l_returnflag", "l_quantity", "l_linestatus", "l_discount"), by, n).groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("branches"),
        F.sum("l_quantity").alias("quantity"),
        F.count_if(F.col("l_linestatus") == "F").alias("ended"),
        F.max("l_discount").alias("discount"),
    )
    return ordered.dealt(orders, ["target"], n).groupBy("target", "test_selector").agg(
        F.sum("lines").alias("added_lines"),
        F.count("l_orderkey").alias("added_methods"),
        F.sum("branches").alias("added_branches"),
        F.sum("quantity").cast("long").alias("added_instructions"),
        F.sum("ended").alias("target_lines"),
        (F.max("discount") > 0.05).alias("measured"),
    )


@query(
    _DELTAS
    + """select target, test_selector,
  row_number() over (partition by target order by added_lines desc, added_instructions desc, added_branches desc, added_methods desc, test_selector)::int by_filter,
  row_number() over (partition by target order by added_lines, added_instructions desc, added_branches, added_methods desc, test_selector)::int by_filter_legacy,
  row_number() over (partition by target order by target_lines desc, added_lines desc, added_instructions desc, added_branches desc, added_methods desc, test_selector)::int by_reduce,
  row_number() over (partition by target order by added_lines desc, added_methods desc, added_branches desc, added_instructions desc, test_selector)::int by_top100,
  row_number() over (partition by target order by added_lines desc, added_branches desc, added_methods desc, added_instructions desc, measured desc, test_selector)::int by_pr from d"""
)
def rank_specs(t):
    rows = _deltas(t)
    for name, spec in ranking.ORDERS.items():
        rows = ranking.ranked(rows, ["target"], [*(c for c in spec if c != "test_selector"), "test_selector"], f"by_{name}")
    return rows.select("target", "test_selector", *[f"by_{n}" for n in ranking.ORDERS])


@query("select user_id, event_type, min(event_id) event_id, arg_min(value, event_id) as value from events group by 1, 2")
def first_wins(t):
    return ranking.first_wins(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("select user_id, event_type, max(event_id) event_id, arg_max(value, event_id) as value from events group by 1, 2")
def last_wins(t):
    return ranking.last_wins(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""
with o as (select user_id, event_type, max(event_id) m, min(event_id) s, arg_max(value, event_id) as value from events where ts < timestamp '2024-01-15' group by 1, 2),
n as (select user_id, event_type, max(event_id) m, min(event_id) s, arg_max(value, event_id) as value from events where ts >= timestamp '2024-01-15' group by 1, 2)
select coalesce(o.user_id, n.user_id) user_id, coalesce(o.event_type, n.event_type) event_type, coalesce(o.s, n.s) seq, coalesce(n.value, o.value) as value
from o full join n on o.user_id = n.user_id and o.event_type = n.event_type""")
def upsert_summary(t):
    rows = t.events.select("user_id", "event_type", F.col("event_id").alias("seq"), "value", "ts")
    early = rows.where("ts < timestamp '2024-01-15'").drop("ts")
    return ranking.upsert(early, rows.where("ts >= timestamp '2024-01-15'").drop("ts"), ["user_id", "event_type"], "seq")


_RANK = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 3}


@query("""
with r as (select *, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 3 else 9 end k from orders)
select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by k, o_orderkey) n from r) where n = 1""")
def representative_variant(t):
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv])[F.col("o_orderpriority")], F.lit(9))
    return ranking.best(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], rank, F.col("o_orderkey"))


@query("""
with c as (select conv_id, turn, length(text) n, sum(length(text)) over (partition by conv_id order by turn, text rows between unbounded preceding and 1 preceding) b,
  row_number() over (partition by conv_id order by turn, text) r from conversations)
select conv_id, turn, greatest(least(n, 600 - coalesce(b, 0)), 0)::bigint taken from c where greatest(least(n, 600 - coalesce(b, 0)), 0) > 0 and r <= 4""")
def running_budget(t):
    rows = t.conversations.withColumn("n", F.length("text").cast("long"))
    out = ranking.within_budget(rows, ["conv_id"], ("turn", "text"), "n", 600, 4)
    return out.select("conv_id", "turn", F.col("taken").cast("long").alias("taken"))


@query("""
with e as (select *, case when event_type = 'view' then 1 when event_type = 'click' then -1 else 0 end d from events)
select event_id, coalesce(sum(d) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0)::bigint as depth from e""")
def running_depth(t):
    change = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    out = ranking.depth(t.events.withColumn("d", change), ["user_id"], "event_id", "d")
    return out.select("event_id", F.col("depth").cast("long").alias("depth"))


@query("""
with f as (select user_id, min(event_id) m from events where event_type = 'purchase' group by 1)
select e.event_id from events e join f using (user_id) where e.event_id > f.m""")
def after_marker(t):
    return ranking.after_marker(t.events, ["user_id"], "event_id", F.col("event_type") == "purchase").select("event_id")


@query("""
select o_orderkey, case when o_orderstatus = 'P' then 'timeout' when o_orderpriority = '1-URGENT' then 'failed' when o_totalprice > 400000 then 'skipped' else 'passed' end status from orders""")
def status_from_flags(t):
    flags = F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 400000
    return t.orders.select("o_orderkey", scalars.status_from_flags(*flags).alias("status"))


@query("""
select l_suppkey, round(100.0 * count(*) filter (l_returnflag = 'R') / count(*), 6) returned,
  round(100.0 * (100.0 * count(*) filter (l_returnflag = 'A') / count(*)) / (100.0 - 100.0 * count(*) filter (l_returnflag = 'R') / count(*)), 6) gap_closed from lineitem group by 1""")
def coverage_percent(t):
    n = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count(F.lit(1)).alias("n"))
    returned, added = scalars.percentage(F.col("r"), F.col("n")), scalars.percentage(F.col("a"), F.col("n"))
    return n.select("l_suppkey", F.round(returned, 6).alias("returned"), F.round(scalars.gap_closed(added, returned), 6).alias("gap_closed"))


@query("""
with v as (select p_type, p_name, p_brand, p_size, p_partkey, regexp_extract(p_brand, '(\\d+)', 1)::int b from part)
select p_type, arg_max(p_partkey, [b, p_size, p_partkey]) p_partkey, arg_max(b || '.' || p_size, [b, p_size, p_partkey]) version from v group by 1""")
def version_max(t):
    version = F.concat_ws(".", F.regexp_extract("p_brand", r"(\d+)", 1), F.col("p_size"))
    rows = t.part.select("p_type", "p_partkey", version.alias("version"))
    return rows.groupBy("p_type").agg(F.max_by("p_partkey", F.struct(scalars.version_key(F.col("version")), "p_partkey")).alias("p_partkey"), F.max_by("version", F.struct(scalars.version_key(F.col("version")), "p_partkey")).alias("version"))

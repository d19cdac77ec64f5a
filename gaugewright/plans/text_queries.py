"""Text similarity, names, matching, events and the generic surface over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import conventions, matching, ordered, ranking
from ..streaming import events as streams
from .registry import query


def _turns(t):
    """Each turn with the next one of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b"))
    return rows.where("b is not null")


_PAIRS = """
with n as (select conv_id, turn, text a, lead(text) over (partition by conv_id order by turn, text) b from conversations),
p as (select conv_id, turn, regexp_extract_all(lower(a), '[\\p{L}\\p{N}]+') a, regexp_extract_all(lower(b), '[\\p{L}\\p{N}]+') b from n where b is not null)
"""


@query(_PAIRS + """
select conv_id, turn, round(case when len(a) = 0 and len(b) = 0 then 1.0 else len(list_intersect(list_distinct(a), list_distinct(b))) / (len(list_distinct(a)) + len(list_distinct(b)) - len(list_intersect(list_distinct(a), list_distinct(b))))::double end, 9) score,
  round(case when len(a) > 0 then len(list_intersect(list_distinct(a), list_distinct(b)))::double / len(list_distinct(a)) end, 9) contained from p""")
def token_jaccard(t):
    a, b = text.words(F.col("a")), text.words(F.col("b"))
    return _turns(t).select("conv_id", "turn", F.round(text.jaccard(a, b), 9).alias("score"), F.round(text.containment(a, b), 9).alias("contained"))


@query(_PAIRS + """, s as (select conv_id, turn,
  case when len(a) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(a) - 2, 1) + 1), lambda i: array_to_string(a[i:i + 2], chr(1)))) end a,
  case when len(b) = 0 then [] else list_distinct(list_transform(range(1, greatest(len(b) - 2, 1) + 1), lambda i: array_to_string(b[i:i + 2], chr(1)))) end b from p)
select conv_id, turn, round(case when len(a) = 0 and len(b) = 0 then 1.0 else len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::double end, 9) score from s""")
def shingle_jaccard(t):
    a, b = text.shingles(text.words(F.col("a")), 3), text.shingles(text.words(F.col("b")), 3)
    return _turns(t).select("conv_id", "turn", F.round(text.jaccard(a, b), 9).alias("score"))


@query("""
select doc_id, length(text) chars, len(string_split(text, chr(10))) lines, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) words, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) distinct_words,
  len(regexp_extract_all(text, '[.,;:!?]')) marks from documents""")
def doc_profile(t):
    words = text.words(F.col("text"))
    return t.documents.select(
        "doc_id", F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"), F.size(words).cast("long").alias("words"),
        F.size(F.array_distinct(words)).cast("long").alias("distinct_words"), F.regexp_count("text", F.lit("[.,;:!?]")).cast("long").alias("marks"),
    )


@query("""
select page_id, length(regexp_replace(html, '(?s)/\\*.*?\\*/|//[^\\n]*', '', 'g')) bare, length(regexp_replace(regexp_replace(html, '"(?:\\\\.|[^"\\\\])*"', '"<STR>"', 'g'), '''(?:\\\\.|[^''\\\\])''', '''<CHR>''', 'g')) normalized,
  len(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*|\\d+|==|!=|<=|>=|&&|\\|\\||[{}()\\[\\];.,+\\-*/%<>=!&|^~?:]')) tokens from pages""")
def source_tokens(t):
    code = F.col("html")
    return t.pages.select(
        "page_id", F.length(text.strip_comments(code)).cast("long").alias("bare"), F.length(text.normalize_literals(code)).cast("long").alias("normalized"), F.size(text.tokenize(code)).cast("long").alias("tokens")
    )


@query("""
with n as (select p_partkey, p_name, 'should' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '') || p_size || '_' || p_type as name from part)
select p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '^should', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_+', ' ', 'g'))) human from n""")
def humanized_names(t):
    camel = F.array_join(F.transform(F.split("p_name", " "), F.initcap), "")
    name = F.concat(F.lit("should"), camel, F.col("p_size"), F.lit("_"), F.col("p_type"))
    return t.part.select("p_partkey", text.humanize(name).alias("human"))


#: Pairs less alike change no decision about a match.
_LEAST = matching.COUNTS
_MATCH = f"""
with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) a from documents where text is not null),
l as (select doc_id, len(a) n, unnest(a) x from w), p as (select l.doc_id left_id, r.doc_id right_id, any_value(l.n) m, any_value(r.n) n, count(*) shared from l join l r using (x) where l.doc_id <> r.doc_id group by 1, 2),
j as (select left_id, right_id, shared::double / (m + n - shared) jaccard from p where shared::double / (m + n - shared) >= {_LEAST}::double),
r as (select *, row_number() over (partition by left_id order by jaccard desc, right_id) k, lead(jaccard) over (partition by left_id order by jaccard desc, right_id) nx from j)
"""


def _similar(t):
    """Each document and the one whose words are most alike."""
    rows = t.documents.select(F.col("doc_id").alias("left_id"), text.words(F.col("text")).alias("a"))
    return matching.best_matches(rows, rows.withColumnRenamed("left_id", "right_id"), "left_id", "right_id", "a", _LEAST, but_itself=True)


@query(_MATCH + "select left_id, right_id, round(jaccard, 9) jaccard, round(jaccard - coalesce(nx, 0), 9) margin from r where k = 1")
def similar_pairs_best(t):
    return _similar(t).select("left_id", "right_id", F.round("jaccard", 9).alias("jaccard"), F.round("margin", 9).alias("margin"))


@query(_MATCH + ", b as (select *, row_number() over (partition by right_id order by jaccard desc, left_id) u from r where k = 1) select left_id, right_id, round(jaccard, 9) jaccard from b where u = 1")
def greedy_unique(t):
    out = matching.one_to_one(_similar(t), [], "left_id", "right_id", "jaccard")
    return out.select("left_id", "right_id", F.round("jaccard", 9).alias("jaccard"))


_PARTS = """
with d as (select doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) w from documents where text is not null),
m as (select *, list_sort(w)[1:6] "name", list_distinct(list_filter(w, lambda x: length(x) > 11)) calls, list_distinct(list_transform(list_filter(w, lambda x: length(x) > 11), lambda x: x[1:8])) words from d),
q as (select x.lang, x.doc_id l, y.doc_id r, x."name" n1, y."name" n2, x.calls c1, y.calls c2, x.words w1, y.words w2, x.w b1, y.w b2 from m x join m y on x.lang = y.lang and x.doc_id % 2 = 0 and y.doc_id % 2 = 1),
i as (select *, len(list_intersect(n1, n2)) ni, len(list_intersect(c1, c2)) ci, len(list_intersect(w1, w2)) wi, len(list_intersect(b1, b2)) bi from q),
s as (select *, 0.40 * coalesce(ni::double / nullif(len(n1) + len(n2) - ni, 0), 0) + 0.35 * greatest(coalesce(ci::double / nullif(len(c1) + len(c2) - ci, 0), 0), coalesce(wi::double / nullif(len(w1) + len(w2) - wi, 0), 0))
  + 0.25 * coalesce(bi::double / nullif(len(b1) + len(b2) - bi, 0), 0) + case when ni > 0 and ci > 0 then 0.27 else 0 end raw from i where ni > 0 or ci > 0 or wi > 0),
k as (select lang, l, r, least(raw, 1.0) score, ni > 0 and ci > 0 specific from s where least(raw, 1.0) >= 0.35),
f as (select *, row_number() over (partition by lang, l order by score desc, r) p, lead(score) over (partition by lang, l order by score desc, r) nx from k)
"""


@query(_PARTS + """select lang, l left_id, r right_id, round(score, 9) score, round(score - coalesce(nx, 0), 9) margin, score >= 0.5 or (score >= 0.4 and score - coalesce(nx, 0) >= 0.05 and specific) accepted from f where p = 1""")
def semantic_matches(t):
    """Documents of even number as methods against those of odd number, within a language: first words by the alphabet as names,
    long words as calls, their beginnings as words of calls."""
    words = F.array_distinct(text.words(F.col("text")))
    rows = t.documents.where("text is not null and lang is not null").select("doc_id", "lang", words.alias("body"))
    calls = F.filter("body", lambda w: F.length(w) > 11)
    rows = rows.select("*", F.slice(F.array_sort("body"), 1, 6).alias("name"), calls.alias("calls"), F.array_distinct(F.transform(calls, lambda w: F.substring(w, 1, 8))).alias("call_words"))
    left, right = rows.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "left_id"), rows.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "right_id")
    out = matching.semantic_matches(left, right, "left_id", "right_id", ["lang"])
    return out.select("lang", "left_id", "right_id", F.round("score", 9).alias("score"), F.round("margin", 9).alias("margin"), "accepted")


@query("""
with recursive e as (select distinct l_partkey a, l_suppkey b from lineitem union select distinct l_suppkey, l_partkey % 37 from lineitem where l_quantity > 45),
c(target, node) as (select n_nationkey, n_nationkey::bigint from nation union select target, b from e join c on e.a = c.node) select target, node from c""")
def reference_closure(t):
    """What each nation's number reaches, over edges with cycles, all at once."""
    edges = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).unionByName(t.lineitem.where("l_quantity > 45").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 37).alias("b"))).distinct()
    return matching.closure(edges, t.nation.select(F.col("n_nationkey").alias("target"), F.col("n_nationkey").cast("long").alias("node")))


@query("""
with a as (select l_suppkey, array_to_string(list_sort(list(distinct l_returnflag)), ',') s from lineitem where l_quantity > 48 group by 1),
b as (select l_suppkey, array_to_string(list_sort(list(distinct l_returnflag)), ',') s from lineitem group by 1)
select b.l_suppkey, coalesce(a.s = b.s, false) same from b left join a using (l_suppkey)""")
def set_equality(t):
    flags = lambda df: df.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("s"))  # three flags at most
    some = flags(t.lineitem.where("l_quantity > 48")).withColumnRenamed("s", "some")
    return flags(t.lineitem).join(some, "l_suppkey", "left").select("l_suppkey", F.coalesce(F.col("some") == F.col("s"), F.lit(False)).alias("same"))


# Windows of events; the streaming forms of the same functions are tested against these.


@query("""
select time_bucket(interval 1 hour, ts) window_start, time_bucket(interval 1 hour, ts) + interval 1 hour window_end, event_type, count(*) n, round(sum(value), 4) total from events group by all""")
def tumbling_windows(t):
    return streams.windowed(t.events, "1 hour").withColumn("total", F.round("total", 4))


@query("""
with e as (select *, unnest([0, 1, 2]) i from events), w as (select time_bucket(interval 10 minute, ts) - i * interval 10 minute s, event_type, value from e)
select s window_start, s + interval 30 minute window_end, event_type, count(*) n, round(sum(value), 4) total from w group by all""")
def sliding_windows(t):
    return streams.windowed(t.events, "30 minutes", "10 minutes").withColumn("total", F.round("total", 4))


@query("""
with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end new from events),
r as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) g from s)
select user_id, min(ts) session_start, max(ts) + interval 2 hour session_end, count(*) n from r group by user_id, g""")
def session_windows(t):
    return streams.sessions(t.events, "2 hours")


@query("select distinct user_id, event_type from events")
def event_dedup(t):
    return streams.distinct_within(t.events.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "1 hour").select("user_id", "event_type")


@query("""
select a.user_id, a.event_id left_id, b.event_id right_id from events a join events b on a.user_id = b.user_id and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour where a.event_type = 'view' and b.event_type = 'purchase'""")
def interval_join(t):
    """The key is hashed with the hour, so that a busy user's events do not meet in one task."""
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01', ts)")
    e = t.events.select("user_id", "event_id", "event_type", "ts", hour.alias("h"))
    left = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("left_id"), F.col("ts").alias("a"), F.explode(F.array(F.col("h"), F.col("h") + 1)).alias("h"))
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("right_id"), F.col("ts").alias("b"), "h")
    near = (F.col("b") >= F.col("a")) & (F.col("b") <= F.col("a") + F.expr("interval 1 hour"))
    return left.join(right, ["user_id", "h"]).where(near).select("user_id", "left_id", "right_id")


@query("""
select a.event_id, b.event_id last_view from (select * from events where event_type = 'purchase') a asof left join (select user_id, event_id, ts from events where event_type = 'view') b on a.user_id = b.user_id and a.ts >= b.ts""")
def asof_join(t):
    """The latest view at or before each purchase of a user: a running last value instead of a join, carried from day
    to day, so that a busy user's events do not meet in one task."""
    order = [F.col("ts"), F.when(F.col("event_type") == "view", 0).otherwise(1), F.col("event_id")]
    day = F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01', ts)")
    rows = ordered.by_position(t.events.where("event_type in ('view', 'purchase')"), ["user_id"], day, 1)
    seen = ordered.running(rows, order, {"last_view": ("last", F.when(F.col("event_type") == "view", F.col("event_id")))})
    return seen.where("event_type = 'purchase'").select("event_id", "last_view")


@query("select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by cube (o_orderstatus, o_orderpriority)")
def cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by grouping sets ((o_orderstatus), (o_orderpriority))")
def grouping_sets(t):
    by = ["o_orderstatus", "o_orderpriority"]
    return t.orders.groupingSets([[c] for c in by], *by).agg(F.count(F.lit(1)).alias("n"))


@query("select user_id, event_type from events where value > 20 except all select user_id, event_type from events where value > 60")
def except_all(t):
    keys = lambda v: t.events.where(F.col("value") > v).select("user_id", "event_type")
    return keys(20).exceptAll(keys(60))


@query("select user_id, event_type from events where value > 20 intersect all select user_id, event_type from events where value < 60")
def intersect_all(t):
    return t.events.where("value > 20").select("user_id", "event_type").intersectAll(t.events.where("value < 60").select("user_id", "event_type"))


@query("""
select o_orderkey, ntile(4) over w quartile, lag(o_totalprice) over w previous, lead(o_totalprice) over w as following, dense_rank() over w::int place, round(avg(o_totalprice) over (partition by o_custkey order by o_totalprice, o_orderkey rows between 2 preceding and current row), 4) moving
from orders window w as (partition by o_custkey order by o_totalprice, o_orderkey)""".replace("dense_rank() over w::int", "(dense_rank() over w)::int").replace("ntile(4) over w quartile", "(ntile(4) over w)::int quartile"))
def window_functions(t):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    moving = F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4)
    return t.orders.select(
        "o_orderkey", F.ntile(4).over(w).alias("quartile"), F.lag("o_totalprice").over(w).alias("previous"), F.lead("o_totalprice").over(w).alias("following"), F.dense_rank().over(w).alias("place"), moving.alias("moving")
    )


@query("""
select n_name, count(*) n, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1""")
def star_join(t):
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))

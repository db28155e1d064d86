"""Queries of operators on ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import sequences as seq
from inkwell.operators.matching import grid
from inkwell.plans.registry import Tables, query

_PARAGRAPHS = """(select doc_id, idx - 1 as para_idx, seg, coalesce(sum(length(seg) + 1) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as start_cp
from (select doc_id, unnest(string_split(text, chr(10))) as seg, generate_subscripts(string_split(text, chr(10)), 1) as idx from documents))"""


@query(f"select doc_id, para_idx::integer as para_idx, start_cp::bigint as start_cp, (start_cp + length(seg))::bigint as end_cp, md5(seg) as digest from {_PARAGRAPHS}")
def paragraph_segments(t: Tables) -> DataFrame:
    return seq.paragraphs(t.documents, "doc_id", F.col("text")).select("doc_id", "para_idx", "start_cp", "end_cp", F.md5("segment").alias("digest"))


@query(f"""select lang, count(*) as n_paragraphs, sum(length(seg))::bigint as n_chars, count(*) filter (where length(regexp_replace(seg, '\\s+', '', 'g')) between 1 and 256) as n_usable
from {_PARAGRAPHS} join documents using (doc_id) group by lang""")
def language_profile(t: Tables) -> DataFrame:
    """Paragraphs, characters and usable short texts by language: one pass and one aggregate with partial sums."""
    from inkwell.functions.text import visible

    rows = t.documents.select("lang", F.explode(F.split("text", "\n")).alias("s"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.length("s")).alias("n_chars"), F.count_if(visible(F.col("s")).between(1, 256)).alias("n_usable"))


@query("""select event_id, user_id, count(*) filter (where brk) over (partition by user_id order by event_id rows unbounded preceding) as island, event_type from (
select *, event_type is distinct from lag(event_type) over (partition by user_id order by event_id) as brk from events)""")
def run_islands(t: Tables) -> DataFrame:
    return seq.islands(t.events.select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type"))


@query("""with b as (select event_id, user_id, event_type, count(*) filter (where brk) over (partition by user_id order by event_id rows unbounded preceding) as island from (
select *, event_type is distinct from lag(event_type) over (partition by user_id order by event_id) as brk from events))
select event_id, user_id, event_type, case when row_number() over (partition by user_id, island order by event_id) = 1 then count(*) over (partition by user_id, island) else 0 end as span from b""")
def merge_spans(t: Tables) -> DataFrame:
    return seq.merge_spans(t.events.select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type")).select("event_id", "user_id", "event_type", "span")


@query("""with k as (select user_id, event_id, case when event_type in ('signup', 'purchase') then 1 when event_type = 'error' then -1 end as k from events),
d as (select *, sum(k) over (partition by user_id order by event_id rows unbounded preceding) as depth from k where k is not null),
l as (select *, case when k = 1 then depth else depth + 1 end as level from d),
p as (select *, lag(k) over (partition by user_id, level order by event_id) as pk, lag(event_id) over (partition by user_id, level order by event_id) as begin_at from l)
select user_id, begin_at, event_id as end_at, level::bigint as level from p where k = -1 and pk = 1""")
def nested_field_pairs(t: Tables) -> DataFrame:
    return seq.nested_pairs(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], F.col("event_type").isin("signup", "purchase"), F.col("event_type") == "error")


@query("""select event_id, user_id, last_value(case when event_type in ('signup', 'purchase', 'error') then event_type end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as state from events""")
def field_state(t: Tables) -> DataFrame:
    marker = F.when(F.col("event_type").isin("signup", "purchase", "error"), F.col("event_type"))
    return seq.carried(t.events.select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], marker, "state").select("event_id", "user_id", "state")


@query("""with r as (select user_id, event_id as s, event_id + 10 as e from events), c as (select distinct user_id, 7 * event_id as c from events),
p as (select user_id, s, e, s as a from r union all select r.user_id, s, e, c from r join c on r.user_id = c.user_id and c.c > r.s and c.c < r.e)
select user_id, s as start_cp, e as end_cp, a as seg_start, coalesce(lead(a) over (partition by user_id, s, e order by a), e) as seg_end from p""")
def split_runs_at_boundaries(t: Tables) -> DataFrame:
    ranges = t.events.select("user_id", F.col("event_id").alias("start_cp"), (F.col("event_id") + 10).alias("end_cp"))
    return seq.split_at(ranges, t.events.select("user_id", (7 * F.col("event_id")).alias("cut")), ["user_id"], "start_cp", "end_cp", "cut")


@query("""select event_id, user_id, ((row_number() over (partition by user_id order by event_id) - 1) * 7) // count(*) over (partition by user_id) as slot from events where event_type = 'signup'""")
def even_distribution(t: Tables) -> DataFrame:
    return seq.even_slots(t.events.filter("event_type = 'signup'").select("event_id", "user_id"), ["user_id"], ["event_id"], 7)


@query("""with a as (select user_id, event_id as anchor, row_number() over (partition by user_id order by event_id) as k from events where event_type = 'signup'),
b as (select user_id, event_id as box, row_number() over (partition by user_id order by event_id) as k from events where event_type = 'error') select user_id, k, anchor, box from a join b using (user_id, k)""")
def ordinal_zip(t: Tables) -> DataFrame:
    side = lambda kind: t.events.filter(F.col("event_type") == kind).select("user_id", "event_id")
    return seq.zipped(side("signup"), side("error"), ["user_id"], "event_id", "event_id", "anchor", "box")


@query("""with n as (select user_id, count(*) filter (where event_type = 'signup') as a, count(*) filter (where event_type = 'error') as b from events group by user_id),
a as (select user_id, event_id as anchor, row_number() over (partition by user_id order by event_id) as k from events where event_type = 'signup'),
b as (select user_id, event_id as box, row_number() over (partition by user_id order by event_id) as k from events where event_type = 'error')
select user_id, k, anchor, box from a join b using (user_id, k) join n using (user_id) where n.a = n.b""")
def global_zip(t: Tables) -> DataFrame:
    """As ordinal_zip, but only where both sides have as many."""
    side = lambda kind: t.events.filter(F.col("event_type") == kind).select("user_id", "event_id")
    even = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("a"), F.count_if(F.col("event_type") == "error").alias("b")).filter("a = b")
    return seq.zipped(side("signup"), side("error"), ["user_id"], "event_id", "event_id", "anchor", "box").join(even.select("user_id"), "user_id", "left_semi")


@query("""with h as (select page_id, unnest(hs) as href, generate_subscripts(hs, 1) as i from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as hs from pages)),
f as (select page_id, lower(split_part(href, '#', 1)) as k, min(i) as m from h group by all), n as (select *, row_number() over (partition by page_id order by m) as link_id from f)
select h.page_id, h.i::integer as i, h.href, n.link_id from h join n on h.page_id = n.page_id and lower(split_part(h.href, '#', 1)) = n.k""")
def link_ids(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("i", "href")).withColumn("i", F.col("i") + 1)
    return seq.first_seen_ids(rows, ["page_id"], [F.lower(F.substring_index("href", "#", 1))], "i").select("page_id", "i", "href", "link_id")


@query("""select o_custkey, o_orderkey, coalesce(lead(o_orderkey) over (partition by o_custkey order by o_orderkey) - 1, 15000000) as section_end, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) is null as final from orders""")
def section_ends(t: Tables) -> DataFrame:
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.coalesce(nxt - 1, F.lit(15000000)).alias("section_end"), nxt.isNull().alias("final"))


@query("""with i as (select o_custkey, o_orderkey, o_orderkey % 3 as level, count(*) filter (where brk) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as island from (
select *, (o_orderkey % 3) is distinct from lag(o_orderkey % 3) over (partition by o_custkey order by o_orderkey) as brk from orders)), r as (select distinct o_custkey, island, level from i)
select i.o_custkey, o_orderkey, i.island, (select max(r.island) from r where r.o_custkey = i.o_custkey and r.island < i.island and r.level = i.level - 1) as parent from i""")
def nesting_islands(t: Tables) -> DataFrame:
    return seq.reset_levels(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], F.col("o_orderkey") % 3).select("o_custkey", "o_orderkey", "island", "parent")


@query("""select user_id, bool_and(value < coalesce(lag_v, 1e300)) and count(*) >= 2 as falls from (select user_id, value, lag(value) over (partition by user_id order by event_id) as lag_v from events) group by user_id""")
def descending_sequence(t: Tables) -> DataFrame:
    return seq.descending(t.events.select("user_id", "event_id", "value"), ["user_id"], ["event_id"], F.col("value"), "falls")


@query("""select user_id, event_id, i // 7 as row_idx, i % 7 as col_idx from (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as i from events)""")
def marker_grid(t: Tables) -> DataFrame:
    return seq.chunked(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"], 7)


@query("""select conv_id, turn, coalesce(lag(role) over (partition by conv_id order by turn) = 'user' and length(trim(text)) >= 60 and len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 8, false) as indent from conversations""")
def following_heading(t: Tables) -> DataFrame:
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    n = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    return t.conversations.select("conv_id", "turn", F.coalesce((before == "user") & (F.length(F.trim("text")) >= 60) & (n >= 8), F.lit(False)).alias("indent"))


@query("""select block, name, row_number() over (order by block, ord) + 1 as rel_id from (select 0 as block, r_regionkey as ord, r_name as name from region union all select 1, n_nationkey, n_name from nation)""")
def relationship_ids(t: Tables) -> DataFrame:
    parts = t.region.select(F.lit(0).alias("block"), F.col("r_regionkey").alias("ord"), F.col("r_name").alias("name")).unionByName(t.nation.select(F.lit(1).alias("block"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name")))
    return seq.numbered(parts.withColumn("__doc", F.lit(0)), ["__doc"], ["block", "ord"], "rel_id", 2).select("block", "name", "rel_id")


@query("""select event_type, user_id, coalesce(sum(value), 0.0) as value from (select e.t as event_type, u.user_id from (select distinct event_type as t from events) e, (select distinct user_id from events) u where t in ('click', 'error', 'purchase', 'signup', 'view')) s left join events using (event_type, user_id) group by all""")
def grid_pivot(t: Tables) -> DataFrame:
    return grid(t.events.select("user_id", "event_type", "value"), "user_id", ["click", "error", "purchase", "signup", "view"], "event_type", F.col("value")).select("event_type", "user_id", "value")


@query("""select user_id, list_transform(range(1, 6), lambda i: coalesce(v[i], 0.0)) as padded from (select user_id, list(value order by event_id) as v from events group by user_id)""")
def pad_truncate(t: Tables) -> DataFrame:
    from inkwell.functions.formats import padded

    rows = t.events.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    return rows.select("user_id", padded(F.col("v"), F.lit(5)).alias("padded"))


@query("""with s as (select o_custkey, o_orderkey, o_orderkey % 5 as kind from orders), m as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from s),
b as (select *, case when kind < 2 then n end as started from m) select o_custkey, o_orderkey, coalesce(last_value(started ignore nulls) over (partition by o_custkey, o_orderkey % 2 order by o_orderkey rows unbounded preceding), -o_orderkey) as id from b""")
def bookmark_ids(t: Tables) -> DataFrame:
    """Starts get the running number; an end takes the latest start of its name, a fresh id without one."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 < 2, n).alias("started"), (F.col("o_orderkey") % 2).alias("name"))
    rows = seq.carried(rows, ["o_custkey", "name"], ["o_orderkey"], F.col("started"), "id")
    return rows.select("o_custkey", "o_orderkey", F.coalesce("id", -F.col("o_orderkey")).cast("long").alias("id"))


@query("""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as idx from orders""")
def reindexed(t: Tables) -> DataFrame:
    return seq.numbered(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "idx", 0).select("o_custkey", "o_orderkey", "idx")


@query("""select o_custkey, o_orderkey, last_value(case when o_orderkey % 4 = 0 then o_totalprice end ignore nulls) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as filled from orders""")
def filled_forward(t: Tables) -> DataFrame:
    return seq.carried(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], F.expr("case when o_orderkey % 4 = 0 then o_totalprice end"), "filled").select("o_custkey", "o_orderkey", "filled")


@query("""select l_orderkey, string_agg(l_returnflag || l_linenumber, '' order by l_linenumber, l_returnflag) as text from lineitem group by l_orderkey""")
def ordered_concat(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("r"))
    return rows.select("l_orderkey", F.array_join(F.transform("r", lambda x: F.concat(x["l_returnflag"], x["l_linenumber"].cast("string"))), "").alias("text"))

"""Queries of joins, aggregates, set operators and derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import matching as m
from inkwell.operators.sequences import paragraphs
from inkwell.plans.registry import Tables, query
from inkwell.plans.sequences import _PARAGRAPHS


def _starts(t: Tables) -> DataFrame:
    return paragraphs(t.documents, "doc_id", F.col("text")).select("doc_id", "para_idx", "start_cp")


@query(f"""select d.doc_id, d.cp, p.para_idx::integer as para_idx from (select doc_id, n_chars // 2 as cp from documents) d asof join {_PARAGRAPHS} p on d.doc_id = p.doc_id and d.cp >= p.start_cp""")
def asof_paragraph(t: Tables) -> DataFrame:
    points = t.documents.select("doc_id", F.expr("n_chars div 2").alias("cp"))
    return m.asof_floor(points, _starts(t), ["doc_id"], "cp", "start_cp", "para_idx")


@query(f"""select d.doc_id, d.cp, coalesce(p.para_idx, (select max(para_idx) from {_PARAGRAPHS} q where q.doc_id = d.doc_id))::integer as para_idx
from (select doc_id, n_chars // 3 as cp from documents) d asof left join {_PARAGRAPHS} p on d.doc_id = p.doc_id and d.cp <= p.start_cp""")
def asof_ceiling(t: Tables) -> DataFrame:
    points = t.documents.select("doc_id", F.expr("n_chars div 3").alias("cp"))
    return m.asof_ceiling(points, _starts(t), ["doc_id"], "cp", "start_cp", "para_idx")


@query("""select e.event_id, e.user_id, (select max(s.event_id) from events s where s.event_type = 'signup' and s.user_id = e.user_id and s.event_id <= e.event_id and e.event_id - s.event_id <= 300) as found from events e where e.event_type = 'error'""")
def bounded_lookback(t: Tables) -> DataFrame:
    side = lambda kind: t.events.filter(F.col("event_type") == kind).select("event_id", "user_id")
    return m.bounded_lookback(side("error"), side("signup"), ["user_id"], "event_id", "event_id", "found", 300)


@query(f"""select d.doc_id, d.cp, min(p.para_idx)::integer as para_idx from (select doc_id, n_chars // 2 as cp from documents) d left join {_PARAGRAPHS} p on d.doc_id = p.doc_id and p.start_cp <= d.cp and d.cp < p.start_cp + length(p.seg) group by all""")
def containing_piece(t: Tables) -> DataFrame:
    points = t.documents.select("doc_id", F.expr("n_chars div 2").alias("cp"))
    pieces = paragraphs(t.documents, "doc_id", F.col("text")).select("doc_id", "para_idx", "start_cp", "end_cp")
    return m.containing(points, pieces, ["doc_id"], "cp", "start_cp", "end_cp", "para_idx", disjoint=True)


@query(f"""select d.doc_id, (d.cp - p.start_cp)::bigint as offset_in_piece, (1024 + 2 * d.cp)::bigint as fc from (select doc_id, n_chars // 2 as cp from documents) d asof join {_PARAGRAPHS} p on d.doc_id = p.doc_id and d.cp >= p.start_cp""")
def cp_to_fc(t: Tables) -> DataFrame:
    """A character position as a byte offset: the piece's offset and two bytes a character behind its start."""
    pieces = _starts(t).select("doc_id", "start_cp", F.struct("start_cp", (1024 + 2 * F.col("start_cp")).alias("fc")).alias("piece"))
    points = t.documents.select("doc_id", F.expr("n_chars div 2").alias("cp"))
    found = m.asof_floor(points, pieces, ["doc_id"], "cp", "start_cp", "piece")
    return found.select("doc_id", (F.col("cp") - F.col("piece.start_cp")).alias("offset_in_piece"), (F.col("piece.fc") + 2 * (F.col("cp") - F.col("piece.start_cp"))).alias("fc"))


@query("""select o_custkey, v as priority, n from (select o_custkey, o_orderpriority as v, count(*) as n, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority desc) as rn from orders group by o_custkey, o_orderpriority) where rn = 1""")
def dominant_value(t: Tables) -> DataFrame:
    return m.mode(t.orders, ["o_custkey"], "o_orderpriority", "priority")


@query("""select c_custkey, coalesce((select o_orderkey % 7 from orders where o_custkey = c_custkey and o_orderkey % 7 > 0 group by o_orderkey % 7 order by count(*) desc, o_orderkey % 7 desc limit 1), 200) as indent from customer""")
def inferred_indent(t: Tables) -> DataFrame:
    seen = t.orders.select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 7).alias("v")).filter("v > 0")
    return t.customer.select("c_custkey").join(m.mode(seen, ["c_custkey"], "v", "indent"), "c_custkey", "left").select("c_custkey", F.coalesce("indent", F.lit(200)).alias("indent"))


_WIDTHS = "(select l_orderkey, list(case when l_partkey % 3 = 0 then 0 else l_partkey end order by l_linenumber, case when l_partkey % 3 = 0 then 0 else l_partkey end) as w from lineitem group by l_orderkey)"


@query(f"""select k, w[1:2] as widths from (select l_orderkey % 50 as k, w, row_number() over (partition by l_orderkey % 50 order by len(list_filter(w[1:2], lambda x: x > 0)) desc, list_sum(w[1:2]) desc, l_orderkey) as rn from {_WIDTHS} where len(w) >= 2 and len(list_filter(w[1:2], lambda x: x > 0)) > 0) where rn = 1""")
def width_template(t: Tables) -> DataFrame:
    """Of the rows with at least two widths, cut to two, some positive: the one with most positive widths, then the greatest sum, then the first."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.expr("if(l_partkey % 3 = 0, 0L, l_partkey)").alias("w")))), lambda x: x["w"]).alias("w"))
    rows = rows.filter(F.size("w") >= 2).select((F.col("l_orderkey") % 50).alias("k"), "l_orderkey", F.slice("w", 1, 2).alias("w"))
    positive = F.size(F.filter("w", lambda x: x > 0))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.filter(positive > 0).groupBy("k").agg(F.max_by("w", F.struct(positive, total, -F.col("l_orderkey"))).alias("widths"))


@query("""select o_custkey, min(o_orderkey) as first_key, arg_min(o_orderstatus, o_orderkey) as first_status, arg_max(o_orderstatus, o_orderkey) as last_status, max(o_orderkey) as last_key from orders group by o_custkey""")
def first_and_last(t: Tables) -> DataFrame:
    """First and last row of a key by explicit order: aggregates with partial results, no sort."""
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"), F.max("o_orderkey").alias("last_key"))


@query("""select o_custkey, list(o_orderkey order by o_totalprice, o_orderkey) as keys from orders group by o_custkey""")
def ordered_list(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_totalprice", "o_orderkey"))).alias("r")).select("o_custkey", F.transform("r", lambda x: x["o_orderkey"]).alias("keys"))


@query("""select c_custkey, coalesce(max(o_totalprice), 0) as most, coalesce(min(o_totalprice), -1) as least, count(o_orderkey) as n, count(*) filter (where o_orderstatus = 'F') as n_final, coalesce(bool_or(o_totalprice > 300000), false) as some_big, coalesce(bool_and(o_totalprice > 1000), true) as all_over
from customer left join orders on c_custkey = o_custkey group by c_custkey""")
def defaults_on_empty(t: Tables) -> DataFrame:
    by = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most"), F.min("o_totalprice").alias("least"), F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"), F.bool_or(F.col("o_totalprice") > 300000).alias("some_big"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_over"))
    return t.customer.select("c_custkey").join(by, "c_custkey", "left").na.fill({"most": 0.0, "least": -1.0, "n": 0, "n_final": 0, "some_big": False, "all_over": True})


@query("""select distinct p_brand, p_type from part""")
def distinct_pairs(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_type").distinct()


@query("""select c_custkey as k from customer where c_custkey % 3 = 0 union select s_suppkey from supplier union select o_custkey from orders where o_totalprice > 400000""")
def union_of_keys(t: Tables) -> DataFrame:
    return t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k")).union(t.supplier.select("s_suppkey")).union(t.orders.filter("o_totalprice > 400000").select("o_custkey")).distinct()


@query("""select 'customer' as story, c_custkey as k, c_name as name from customer union all select 'supplier', s_suppkey, s_name from supplier union all select 'part', p_partkey, p_name from part""")
def union_of_stories(t: Tables) -> DataFrame:
    one = lambda df, story, key, name: df.select(F.lit(story).alias("story"), F.col(key).alias("k"), F.col(name).alias("name"))
    return one(t.customer, "customer", "c_custkey", "c_name").unionByName(one(t.supplier, "supplier", "s_suppkey", "s_name")).unionByName(one(t.part, "part", "p_partkey", "p_name"))


@query("""select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 30)""")
def unconsumed_rows(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem.filter("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)""")
def rows_with_partner(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("""with h as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages), p as (select distinct lower(regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1)) as path from pages)
select distinct page_id, href from h where not exists (select 1 from p where p.path = lower(split_part(split_part(href, '#', 1), '?', 1)))""")
def missing_link_targets(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).withColumn("path", F.lower(F.substring_index(F.substring_index("href", "#", 1), "?", 1)))
    known = t.pages.select(F.lower(F.regexp_extract("url", r"^[^:]+://[^/]+(/[^?#]*)", 1)).alias("path"))
    return links.join(known, "path", "left_anti").select("page_id", "href").distinct()


@query("""select n_nationkey, coalesce(r_name, 'Unknown') as region from nation left join region on n_regionkey = r_regionkey and r_regionkey <> 2""")
def left_with_default(t: Tables) -> DataFrame:
    return t.nation.join(t.region.filter("r_regionkey <> 2"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce("r_name", F.lit("Unknown")).alias("region"))


@query("""select c_custkey, coalesce(a.s_name, b.s_name) as style from customer left join supplier a on a.s_suppkey = c_custkey and a.s_nationkey = c_nationkey left join supplier b on b.s_suppkey = c_custkey % 50""")
def kind_then_any(t: Tables) -> DataFrame:
    """By id and kind, else by id."""
    exact = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_name").alias("one"))
    loose = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("other"))
    rows = t.customer.select("c_custkey", "c_nationkey").join(exact, ["c_custkey", "c_nationkey"], "left")
    return rows.join(loose, F.col("c_custkey") % 50 == F.col("k"), "left").select("c_custkey", F.coalesce("one", "other").alias("style"))


@query("""select c_custkey, arg_min(struct_pack(k := o_orderkey, p := pr), (pr, o_orderkey)).k as picked, min(pr) as priority from (select c_custkey, o_orderkey, case when o_orderstatus = 'F' then 0 when o_orderstatus = 'O' then 1 else 2 end as pr from customer join orders on o_custkey = c_custkey) group by c_custkey""")
def priority_match(t: Tables) -> DataFrame:
    """Of the candidates of a key the one of best priority, then the first."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    right = t.orders.select("o_custkey", F.col("o_orderkey").alias("picked"), rank.alias("priority"))
    return m.by_priority(t.customer.select("c_custkey"), right, F.col("c_custkey") == F.col("o_custkey"), ["c_custkey"], [F.col("priority"), F.col("picked")], ["picked", "priority"]).filter("picked is not null")


@query("""select p_partkey, coalesce(a.s_name, b.s_name) as font from part left join supplier a on a.s_name = 'Supplier#' || lpad((p_partkey % 120)::varchar, 9, '0') left join supplier b on b.s_name = 'Supplier#000000001'""")
def name_pattern_join(t: Tables) -> DataFrame:
    exact = t.supplier.select(F.col("s_name").alias("n"), F.col("s_name").alias("a"))
    rows = t.part.select("p_partkey", F.format_string("Supplier#%09d", F.col("p_partkey") % 120).alias("n"), F.lit("Supplier#000000001").alias("n0"))
    other = t.supplier.select(F.col("s_name").alias("n0"), F.col("s_name").alias("b"))
    return rows.join(exact, "n", "left").join(other, "n0", "left").select("p_partkey", F.coalesce("a", "b").alias("font"))


@query("""with recursive a(node, ancestor, depth) as (select p_partkey, p_partkey, 0 from part union all select node, ancestor // 2, depth + 1 from a where ancestor // 2 >= 1) select node, max(depth)::integer as depth from a group by node""")
def style_depth(t: Tables) -> DataFrame:
    nodes = t.part.select("p_partkey", F.when(F.expr("p_partkey div 2") >= 1, F.expr("p_partkey div 2")).alias("base"))
    return m.ancestors(nodes, "p_partkey", "base").groupBy("node").agg(F.max("depth").alias("depth"))


@query("""with recursive a(node, ancestor, depth) as (select p_partkey, p_partkey, 0 from part union all select node, ancestor // 2, depth + 1 from a where ancestor // 2 >= 1)
select node, arg_min(p_size, depth) filter (where p_partkey % 3 = 0) as size, arg_min(p_brand, depth) filter (where p_partkey % 5 = 0) as brand from a join part on p_partkey = ancestor group by node""")
def style_fold(t: Tables) -> DataFrame:
    """Of each property the nearest ancestor's that sets it."""
    nodes = t.part.select("p_partkey", F.when(F.expr("p_partkey div 2") >= 1, F.expr("p_partkey div 2")).alias("base"))
    props = t.part.select(F.col("p_partkey").alias("ancestor"), F.expr("if(p_partkey % 3 = 0, p_size, null)").alias("size"), F.expr("if(p_partkey % 5 = 0, p_brand, null)").alias("brand"))
    near = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("depth"))).alias(c)
    return m.ancestors(nodes, "p_partkey", "base").join(props, "ancestor").groupBy("node").agg(near("size"), near("brand"))


@query("""select p_size, level, coalesce(n, 0) as n from (select distinct p_size from part) s, range(0, 9) r(level) left join (select p_size as ps, p_partkey % 9 as l, count(*) as n from part group by all) c on c.ps = s.p_size and c.l = r.level""")
def level_spine(t: Tables) -> DataFrame:
    """Nine levels of everything, zero where there are none."""
    counts = [F.count_if(F.col("p_partkey") % 9 == k) for k in range(9)]
    return t.part.groupBy("p_size").agg(F.array(*counts).alias("a")).select("p_size", F.posexplode("a").alias("level", "n")).select("p_size", F.col("level").cast("long").alias("level"), "n")


@query("""select conv_id, v as visible from (select conv_id, sum(length(regexp_replace(text, '\\s+', '', 'g')))::bigint as v from conversations group by conv_id) where v between 1 and 2560""")
def usable_group(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.sum(text.visible(F.col("text"))).alias("visible")).filter(F.col("visible").between(1, 2560))


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderkey) as rn from orders) where rn <= 3""")
def capped_rows(t: Tables) -> DataFrame:
    """At most three rows of a key; the filter on the rank becomes a per-key limit before the shuffle."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rn")).filter("rn <= 3").drop("rn")


@query("""select o_orderkey, i::integer as i, 1000 // n + case when i < 1000 % n then 1 else 0 end as width from (select o_orderkey, o_orderkey % 5 + 1 as n from orders), lateral (select unnest(range(0, n)) as i)""")
def even_widths(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") % 5 + 1).alias("n"))
    return rows.select("o_orderkey", "n", F.explode(F.expr("sequence(0, cast(n as int) - 1)")).alias("i")).select("o_orderkey", "i", F.expr("1000 div n + if(i < 1000 % n, 1, 0)").alias("width"))


@query("""select p_partkey, '[WARNING] base styles of ' || p_partkey || ' run in a circle' as line from part where p_partkey % 10 >= 5""")
def style_cycles(t: Tables) -> DataFrame:
    """In each ten the fifth and sixth are each other's base, and the rest behind them inherit from these."""
    k = F.col("p_partkey")
    nodes = t.part.select("p_partkey", F.when(k % 10 == 5, k + 1).when(k % 10 > 0, k - 1).alias("base"))
    line = text.message(F.lit("Warning"), F.concat(F.lit("base styles of "), k.cast("string"), F.lit(" run in a circle")), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return m.unrooted(nodes, "p_partkey", "base").select("p_partkey", line.alias("line"))

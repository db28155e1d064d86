"""Queries of table geometry, numbering and assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import assign, lists, tables
from inkwell.plans.registry import Tables, query


@query("""select user_id, greatest(0, max(case when value > 50 then case when event_id % 9 >= 2 then least(7, event_id % 9) - 1 else 0 end end)) as n from events group by user_id having max(value) > 50""")
def mark_column_hint(t: Tables) -> DataFrame:
    rows = t.events.filter("value > 50").select("user_id", F.expr("concat('a', repeat(char(7), int(least(7, event_id % 9))), 'b')").alias("s"))
    return rows.groupBy("user_id").agg(F.max(tables.mark_columns(F.col("s"))).cast("long").alias("n"))


@query("""select * replace (row_idx::bigint as row_idx, col_idx::bigint as col_idx) from (select o_orderkey, i // 3 as row_idx, (i % 3) * 2 as col_idx, 't' || i as token from orders, (select unnest([0, 1, 2, 4, 6]) as i))""")
def compact_grid(t: Tables) -> DataFrame:
    """A title, then tokens in three columns: gaps of two marks move on by one place, gaps of four by two."""
    gap = lambda n: f"repeat(char(7), {n})"
    text = F.expr(f"concat('title', {gap(6)}, 't0', {gap(2)}, 't1', {gap(2)}, 't2', {gap(4)}, 't4', {gap(4)}, 't6')")
    rows = t.orders.select("o_orderkey", F.explode(tables.compact_grid(text)).alias("c"))
    return rows.select("o_orderkey", F.col("c.row_idx").cast("long").alias("row_idx"), F.col("c.col_idx").cast("long").alias("col_idx"), "c.token")


@query("""select p_partkey, case when p_size % 4 > 0 and p_size > 4 then [p_size % 4] else (case when p_size < 4 then [p_size] else [] end) end || list_transform(range(0, p_size // 4), lambda x: 4) as rows from part""")
def marker_only_rows(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tables.marker_rows(F.col("p_size"), F.lit(4)).alias("rows"))


@query("""with r as (select user_id, event_id, case when event_type = 'error' then chr(7) else event_type || case when event_id % 3 = 0 then chr(7) else '' end end as s from events),
n as (select *, coalesce(sum(case when s like '%' || chr(7) then 1 else 0 end) over w, 0) as cell, coalesce(sum(case when s = chr(7) then 1 else 0 end) over w, 0) as row_idx from r window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding))
select user_id, row_idx::bigint as row_idx, cell::bigint as cell, string_agg(replace(s, chr(7), ''), '' order by event_id) as text from n where s <> chr(7) group by all""")
def cell_assembly(t: Tables) -> DataFrame:
    runs = t.events.select("user_id", "event_id", F.expr("if(event_type = 'error', char(7), concat(event_type, if(event_id % 3 = 0, char(7), '')))").alias("s"))
    return tables.assembled_cells(runs, "user_id", "event_id", "s").select("user_id", F.col("row_idx").cast("long").alias("row_idx"), F.col("cell").cast("long").alias("cell"), "text")


@query("""select o_custkey, o_orderkey, coalesce(max(r + 1 + o_orderkey % 3) over (partition by o_custkey, c order by r rows between unbounded preceding and 1 preceding) > r, false) as covered
from (select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 2 as r, (row_number() over (partition by o_custkey order by o_orderkey) - 1) % 2 as c from orders)""")
def covered_cells(t: Tables) -> DataFrame:
    from inkwell.operators.sequences import chunked

    cells = chunked(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 2).withColumn("row_span", 1 + F.col("o_orderkey") % 3)
    return tables.covered(cells, "o_custkey").select("o_custkey", "o_orderkey", "covered")


@query("""with l as (select o_custkey, o_orderkey as ord, o_orderkey % 11 as list_id from orders), o as (select o_custkey, o_orderkey as ord, o_orderkey % 4 as override_id, o_orderkey % 11 as list_id from orders where o_orderkey % 3 = 0),
p as (select *, row_number() over (partition by o_custkey order by ord) as place from l),
c as (select o_custkey, override_id, list_id, 0 as f, ord from o where override_id > 0 union all select o_custkey, place, list_id, 1, 2 * place from p where list_id > 0 union all select o_custkey, list_id, list_id, 1, 2 * place + 1 from p where list_id > 0)
select o_custkey, override_id, list_id from (select *, row_number() over (partition by o_custkey, override_id order by f, ord) as rn from c) where rn = 1""")
def list_overrides(t: Tables) -> DataFrame:
    own = t.orders.select("o_custkey", F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 11).alias("list_id"))
    given = t.orders.filter("o_orderkey % 3 = 0").select("o_custkey", F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 4).alias("override_id"), (F.col("o_orderkey") % 11).alias("list_id"))
    return lists.normalised_overrides(own, given, "o_custkey")


@query("""select o_orderkey, o_orderkey % 4 as start_at, o_orderkey % 2 = 0 and o_orderkey % 4 > 0 and (o_orderkey % 3 is distinct from o_orderkey % 4) as has_start, o_orderkey % 5 = 0 as has_format from orders
where (o_orderkey % 2 = 0 and o_orderkey % 4 > 0 and (o_orderkey % 3 is distinct from o_orderkey % 4)) or o_orderkey % 5 = 0""")
def effective_level_overrides(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    over = t.orders.select("o_orderkey", (k % 4).alias("start_at"), (k % 2 == 0).alias("has_start"), (k % 5 == 0).alias("has_format"))
    return lists.effective_levels(over, t.orders.select("o_orderkey", (k % 3).alias("start_at")), ["o_orderkey"])


@query("""select p_brand, p_partkey, case when max(p_size = 7) over (partition by p_brand, p_partkey % 40) then case when p_size = 7 then '-' else '' end else [chr(183), 'o', chr(9642)][(p_partkey % 9 % 3 + 1)::integer] end as glyph from part""")
def bullet_fallback(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", "p_partkey", (F.col("p_partkey") % 40).alias("l"), (F.col("p_partkey") % 9).cast("int").alias("level"), F.expr("if(p_size = 7, '-', '')").alias("glyph"))
    return lists.with_bullets(rows, ["p_brand", "l"], "level", "glyph").select("p_brand", "p_partkey", "glyph")


@query("""select o_custkey, o_orderkey as override_id, o_orderkey % 7 as list_id, coalesce(case when o_orderkey % 7 < 5 then 'f' || (o_orderkey % 7) end, 'Decimal') as format from orders where o_totalprice > 200000""")
def numbering_instances(t: Tables) -> DataFrame:
    over = t.orders.select("o_custkey", F.col("o_orderkey").alias("override_id"), (F.col("o_orderkey") % 7).alias("list_id"))
    used = t.orders.filter("o_totalprice > 200000").select("o_custkey", F.col("o_orderkey").alias("override_id"))
    defs = t.orders.select("o_custkey", (F.col("o_orderkey") % 7).alias("list_id")).distinct().filter("list_id < 5").withColumn("format", F.concat(F.lit("f"), F.col("list_id").cast("string")))
    return lists.used_definitions(over, used, defs, "o_custkey")


@query("""with recursive x as (select user_id, event_id as idx, case when event_id % 5 = 0 then -1 else event_id % 50 end as para from events where event_type = 'signup'), s as (select user_id, event_id as shape_id, case when event_id % 7 = 0 then -1 else event_id % 50 end as para from events where event_type = 'error'),
c as (select x.user_id, x.idx, list(struct_pack(score := case when x.para >= 0 and s.para >= 0 then 100 * abs(x.para - s.para) when x.para >= 0 or s.para >= 0 then 10000 else 0 end + abs(x.idx - s.shape_id % 1000), shape := s.shape_id)) as l from x join s on s.user_id = x.user_id group by all),
b as (select user_id, idx, list_sort(l) as l, row_number() over (partition by user_id order by idx) as k from c),
w(user_id, k, used, idx, pick) as (select distinct user_id, 0::bigint, []::bigint[], null::bigint, null::struct(score bigint, shape bigint) from b
union all select b.user_id, b.k, list_append(w.used, (list_filter(b.l, lambda e: not list_contains(w.used, e.shape))[1]).shape), b.idx, list_filter(b.l, lambda e: not list_contains(w.used, e.shape))[1] from w join b on b.user_id = w.user_id and b.k = w.k + 1)
select user_id, idx, pick.shape as shape_id, pick.score as score from w where pick is not null""")
def textbox_shapes(t: Tables) -> DataFrame:
    """Each box takes the best shape that is left: a loop, in SQL a recursion with a list of those taken."""
    boxes = t.events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("idx"), F.expr("if(event_id % 5 = 0, -1, event_id % 50)").alias("para"))
    shapes = t.events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("shape_id"), F.expr("if(event_id % 7 = 0, -1, event_id % 50)").alias("para"))
    return assign.textboxes_to_shapes(boxes, shapes, "user_id")


@query("""with recursive r as (select user_id, event_id as run, case when event_id % 5 = 0 then 0 else event_id end as o from events where event_type = 'signup'), i as (select user_id, event_id as image, case when event_id % 7 = 0 then 0 else event_id end as o from events where event_type = 'error'),
f as (select user_id, list(image order by image) as free from i group by user_id), c as (select r.user_id, r.run, r.o, list(struct_pack(d := abs(i.o - r.o), image := i.image)) filter (where i.o <> 0) as near from r join i on i.user_id = r.user_id group by all),
b as (select c.user_id, run, case when o <> 0 then list_sort(coalesce(near, [])) else [] end as near, free, row_number() over (partition by c.user_id order by run) as k from c join f on f.user_id = c.user_id),
w(user_id, k, used, run, image) as (select distinct user_id, 0::bigint, []::bigint[], null::bigint, null::bigint from b
union all select user_id, k, list_append(used, pick), run, pick from (select b.user_id, b.k, b.run, w.used, coalesce((list_filter(b.near, lambda e: not list_contains(w.used, e.image))[1]).image, list_filter(b.free, lambda e: not list_contains(w.used, e))[1], 0) as pick from w join b on b.user_id = w.user_id and b.k = w.k + 1))
select user_id, run as run_idx, image as image_idx from w where run is not null""")
def picture_images(t: Tables) -> DataFrame:
    """Each run takes the nearest image that is left: a loop, in SQL a recursion with a list of those taken."""
    runs = t.events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("run_idx"), F.expr("if(event_id % 5 = 0, 0, event_id)").alias("offset"))
    images = t.events.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("image_idx"), F.expr("if(event_id % 7 = 0, 0, event_id)").alias("offset"))
    return assign.runs_to_images(runs, images, "user_id")


@query("""with recursive c as (select l_orderkey, l_linenumber as r, (l_partkey % 5)::integer as c, (l_suppkey % 3 + 1)::integer as s, l_partkey as w from lineitem where l_partkey > 0),
u as (select l_orderkey, list_transform(range(0, 5), lambda k: coalesce(list_max(list_transform(list_filter(l, lambda e: e.c = k and e.s = 1), lambda e: e.w)), 0)) as widths from (select l_orderkey, list(struct_pack(c := c, s := s, w := w)) as l from c group by l_orderkey)),
b as (select *, row_number() over (partition by l_orderkey order by r, c, s, w) as k from c where s > 1),
z(l_orderkey, k, widths) as (select l_orderkey, 0::bigint, widths from u
union all select l_orderkey, k, list_transform(widths, lambda x, i: case when n > 0 and rest > 0 and i > c and i <= e and x = 0 then greatest(1, rest // n) + case when len(list_filter(widths[c + 1:i - 1], lambda y: y = 0)) < rest % n then 1 else 0 end else x end) from (
select z.l_orderkey, b.k, z.widths, b.c, least(5, b.c + b.s) as e, len(list_filter(z.widths[b.c + 1:least(5, b.c + b.s)], lambda y: y = 0)) as n, b.w - list_sum(z.widths[b.c + 1:least(5, b.c + b.s)]) as rest from z join b on b.l_orderkey = z.l_orderkey and b.k = z.k + 1))
select l_orderkey, arg_max(widths, k) as widths from z group by l_orderkey""")
def solved_widths(t: Tables) -> DataFrame:
    """Spanning cells share out what is left, one after another: a loop, in SQL a recursion."""
    cells = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("row_idx"), (F.col("l_partkey") % 5).alias("col_idx"), (F.col("l_suppkey") % 3 + 1).alias("span"), F.col("l_partkey").alias("width"))
    return assign.column_widths(cells, ["l_orderkey"], 5)

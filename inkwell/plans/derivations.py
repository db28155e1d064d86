"""Queries of shapes, borders, headers and other derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import shapes
from inkwell.plans.registry import Tables, query


@query("""select l_orderkey, l_linenumber, ['Page', 'Margin', 'Column', 'Column'][((f >> 1) & 3) + 1] as horizontal, ['Page', 'Margin', 'Paragraph', 'Paragraph'][((f >> 3) & 3) + 1] as vertical,
case (f >> 5) & 7 when 0 then case when (f & 8192) <> 0 then 'Behind' else 'InFront' end when 1 then 'Tight' when 2 then 'Through' when 4 then 'TopBottom' else 'Square' end as wrap from (select l_orderkey, l_linenumber, (l_partkey * 7919) % 65536 as f from lineitem)""")
def anchor_flags(t: Tables) -> DataFrame:
    made = shapes.anchor(F.expr("(l_partkey * 7919) % 65536"))
    return t.lineitem.select("l_orderkey", "l_linenumber", made["horizontal"].alias("horizontal"), made["vertical"].alias("vertical"), shapes.textbox_wrap(made["wrap"]).alias("wrap"))


@query("""select p_partkey, case when c in (1, 2, 4, 7, 8, 21, 65, 84, 109, 114, 116, 176, 177) then 'Rectangle' when c in (3, 63) then 'Ellipse' when c = 202 then 'Textbox' when c = 75 then 'Picture' else 'Unknown' end as kind,
case p_partkey % 8 when 0 then 'png' when 1 then 'jpg' when 2 then 'gif' when 3 then 'emf' when 4 then 'wmf' when 5 then 'bmp' when 6 then 'tiff' else 'bin' end as extension from (select p_partkey, p_partkey % 210 as c from part)""")
def shape_kinds(t: Tables) -> DataFrame:
    image = F.expr("element_at(array('Png', 'Jpeg', 'Gif', 'Emf', 'Wmf', 'Dib', 'Tiff', '?'), int(p_partkey % 8) + 1)")
    return t.part.select("p_partkey", shapes.shape_kind(F.col("p_partkey") % 210).alias("kind"), shapes.image_extension(image).alias("extension"))


@query("""with p as (select p_partkey, i, least(21600, greatest(0, cast(round_even(((p_partkey * (i + 3)) % 1000 - 100) * 21600.0 / 700, 0) as integer))) as x, least(21600, greatest(0, cast(round_even((i * 250 - 100) * 21600.0 / 700, 0) as integer))) as y from part, range(0, 5) r(i)),
d as (select *, coalesce(x = lag(x) over w and y = lag(y) over w, false) as same from p window w as (partition by p_partkey order by i))
select p_partkey, list(x order by i) as xs, list(y order by i) as ys from d where not same group by p_partkey having count(*) >= 3""")
def wrap_polygons(t: Tables) -> DataFrame:
    vertices = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(((F.col("p_partkey") * (i + 3)) % 1000).alias("x"), (i * 250).alias("y")))
    made = t.part.select("p_partkey", shapes.wrap_polygon(vertices, F.lit(100), F.lit(100), F.lit(800), F.lit(800)).alias("p")).filter("p is not null")
    return made.select("p_partkey", F.transform("p", lambda v: v["x"]).alias("xs"), F.transform("p", lambda v: v["y"]).alias("ys"))


@query("""select l_orderkey, l_linenumber, case when wins then b_style else a_style end as style, case when wins then b_colour else a_colour end as colour, a_colour = 255 and l_quantity > 20 as malformed from (
select *, (a_style = 'None' and b_style <> 'None') or (b_colour > 16 and a_colour between 0 and 16) or (a_colour = 0 and b_colour <> 0) as wins from (
select l_orderkey, l_linenumber, l_quantity, case when l_partkey % 3 = 0 then 'None' else 'Single' end as a_style, case when l_partkey % 4 = 0 then 255 else l_partkey % 30 end as a_colour, case when l_suppkey % 3 = 0 then 'None' else 'Double' end as b_style, l_suppkey % 40 as b_colour from lineitem))""")
def merged_borders(t: Tables) -> DataFrame:
    old = F.struct(F.expr("if(l_partkey % 3 = 0, 'None', 'Single')").alias("style"), F.expr("if(l_partkey % 4 = 0, 255L, l_partkey % 30)").alias("colour"))
    new = F.struct(F.expr("if(l_suppkey % 3 = 0, 'None', 'Double')").alias("style"), F.expr("l_suppkey % 40").alias("colour"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", old.alias("a"), new.alias("b"))
    made = shapes.merged_border(F.col("a"), F.col("b"))
    return rows.select("l_orderkey", "l_linenumber", made["style"].alias("style"), made["colour"].alias("colour"), shapes.malformed_border(F.expr("if(l_quantity > 20, 97, 9)"), F.col("a.colour")).alias("malformed"))


@query("""select p_partkey, coalesce(nullif(p_size % 3, 0), p_size % 5) as x, coalesce(nullif(p_partkey % 2, 0), 7) as y, p_size % 2 = 0 and p_partkey % 3 = 0 as overlap from part""")
def merged_floating(t: Tables) -> DataFrame:
    old = F.struct((F.col("p_size") % 3).alias("x"), (F.col("p_partkey") % 2).alias("y"), (F.col("p_size") % 2 == 0).alias("overlap"))
    new = F.struct((F.col("p_size") % 5).alias("x"), F.lit(7).cast("long").alias("y"), (F.col("p_partkey") % 3 == 0).alias("overlap"))
    return t.part.select("p_partkey", shapes.merged_floating(old, new, ["x", "y"]).alias("m")).select("p_partkey", "m.x", "m.y", "m.overlap")


@query("""select conv_id, turn, turn % 2 = 0 or (length(text) <= 40 and contains(text, ':')) as metadata, ['a: ' || role, 'a: x'] as pair from conversations""")
def metadata_pairs(t: Tables) -> DataFrame:
    """Which texts are metadata, and pairs of one label with the longer text first."""
    cell = F.expr("if(turn % 2 = 0, concat(substr(text, 1, 39), ':'), text)")
    return t.conversations.select("conv_id", "turn", shapes.metadata_cell(cell).alias("metadata"), shapes.metadata_pair(F.lit("a: x"), F.concat(F.lit("a: "), "role")).alias("pair"))


@query("""select conv_id, turn, length(b) > 0 and case when length(a) = 0 then length(b) <= 64 else length(b) <= greatest(96, 4 * length(a)) and (contains(b, a) or contains(a, b)) end as plausible
from (select conv_id, turn, regexp_replace(case when turn % 3 = 0 then '' else substr(text, 1, 30) end, '\\s+', '', 'g') as a, regexp_replace(text, '\\s+', '', 'g') as b from conversations)""")
def plausible_headers(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", shapes.plausible_header(F.expr("if(turn % 3 = 0, '', substr(text, 1, 30))"), F.col("text")).alias("plausible"))


@query("""select o_custkey, min(o_orderkey) as shape, o_orderkey % 9 as image from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 48) group by o_custkey, o_orderkey % 9""")
def unused_image_shapes(t: Tables) -> DataFrame:
    """Shapes whose image no run uses, the first of each image."""
    used = t.lineitem.filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    rest = t.orders.select("o_custkey", "o_orderkey").join(used, "o_orderkey", "left_anti")
    return rest.groupBy("o_custkey", (F.col("o_orderkey") % 9).alias("image")).agg(F.min("o_orderkey").alias("shape")).select("o_custkey", "shape", "image")

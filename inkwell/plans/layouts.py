"""Queries of paragraphs, properties, stories, tables and charts: the rules of documents, on rows made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import fields, formats, shapes, text
from inkwell.operators import assign, charts, matching, properties, sequences, stories, tables
from inkwell.plans.registry import Tables, query

_MARKS = r"[\x01\x08\x13\x14\x15]"


@query(f"""select conv_id, turn, case when contains(t, chr(7)) or (conv_id % 5 = 0 and turn % 3 = 2) or turn % 7 = 3 then 'TableCell' when contains(t, chr(12)) then 'PageBreak' else 'Normal' end as kind,
len(regexp_extract_all(replace(t, ' a', chr(19) || 'a'), '{_MARKS}|[^{_MARKS[1:]}+'))::bigint as n_parts
from (select *, text || case turn % 4 when 0 then chr(7) when 1 then chr(12) else '' end as t from conversations)""")
def paragraph_types(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("t", F.concat("text", F.expr("case turn % 4 when 0 then char(7) when 1 then char(12) else '' end")))
    parts = text.special_parts(F.expr("replace(t, ' a', concat(char(19), 'a'))"))
    kind = text.paragraph_type(F.col("t"), F.expr("conv_id % 5 = 0 and turn % 3 = 2"), F.expr("if(turn % 7 = 3, 1, 0)"))
    return rows.select("conv_id", "turn", kind.alias("kind"), F.size(parts).cast("long").alias("n_parts"))


@query("""select p_partkey, p_size = 15 or p_size between 1 and 9 or p_partkey % 4 in (1, 2) as heading from part""")
def heading_tests(t: Tables) -> DataFrame:
    name = F.expr("element_at(array('Body', 'HEADING x', 'title', null), int(p_partkey % 4) + 1)")
    return t.part.select("p_partkey", text.is_heading(F.col("p_size"), name).alias("heading"))


@query("""select conv_id, turn, turn % 2 = 0 and contains(t, chr(7)) as flat, turn % 4 = 0 as article, turn % 4 = 1 as nested from (select *, text || case when turn % 3 = 0 then chr(7) else '' end as t from conversations where not contains(lower(text), 'nested'))""")
def flat_predicates(t: Tables) -> DataFrame:
    rows = t.conversations.filter("not contains(lower(text), 'nested')").withColumn("t", F.expr("concat(text, if(turn % 3 = 0, char(7), ''))"))
    title = F.expr("concat(case turn % 4 when 0 then '第三章：' when 1 then 'Nested ' else 'x第1条：' end, text)")
    return rows.select("conv_id", "turn", text.flat_table_paragraph(F.expr("if(turn % 2 = 0, 'TableCell', 'Normal')"), F.col("t")).alias("flat"), text.article_heading(title).alias("article"), text.nested_title(title).alias("nested"))


@query("""select event_id, event_type not in ('click', 'error') and event_id % 11 <> 0 and event_id % 7 > 0 and length(event_type) = event_id % 7 as splittable from events""")
def splittable_runs(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select("event_id", text.splittable(kind == "click", kind == "error", F.col("event_id") % 11 == 0, kind, F.col("event_id") % 7).alias("splittable"))


@query("""select event_id, case event_id % 8 when 0 then '1' when 1 then case when event_id % 3 = 0 then strftime(ts, '%d.%m.%Y') else strftime(ts, '%Y-%m-%d') end when 2 then strftime(ts, '%H:%M:%S') when 3 then 'a' || user_id when 4 then '' when 5 then case when event_id % 3 = 0 then strftime(ts - interval 1 day, '%d.%m.%Y') else strftime(ts - interval 1 day, '%Y-%m-%d') end when 6 then 'u' else '[ZZ]' end as shown from events""")
def display_values(t: Tables) -> DataFrame:
    kind = F.expr("element_at(array('NumPages', 'Date', 'Time', 'Author', 'Title', 'SaveDate', 'UserName', 'Unknown'), int(event_id % 8) + 1)")
    own = F.struct(F.expr("concat('a', user_id)").alias("author"), F.lit(None).cast("string").alias("title"), F.lit("s").alias("subject"), F.lit("f").alias("file_name"), F.col("ts").alias("created"), F.expr("ts - interval 1 day").alias("modified"), F.lit("u").alias("user_name"))
    shown = fields.display_value(kind, F.lit("ZZ"), own, F.col("ts"), date_picture=F.expr("if(event_id % 3 = 0, 'dd.MM.yyyy', '')"), time_picture=F.lit(""))
    return t.events.select("event_id", shown.alias("shown"))


@query("""select p_partkey, case when p_partkey % 9 = 0 then 'Style99' else replace(p_type, ' ', '') end as id, case when p_partkey % 9 = 0 then 'none' else p_type end as name from part""")
def style_names(t: Tables) -> DataFrame:
    """What XML forbids goes from ids and names; a name of nothing else falls back."""
    name = F.expr("if(p_partkey % 9 = 0, char(2), concat(char(1), p_type, ' ', decode(unhex('EFBFBD'), 'UTF-8')))")
    return t.part.select("p_partkey", formats.style_id(F.lit(99), name).alias("id"), formats.style_name(name, F.lit("none")).alias("name"))


@query("""select p_partkey, coalesce(['none', 'single', 'thick', 'double', 'single', 'dotted', 'dash', 'dotDash', 'dotDotDash', 'triple', 'thinThickSmallGap', 'thickThinSmallGap', 'thinThickThinSmallGap', 'thinThickMediumGap', 'thickThinMediumGap', 'thinThickThinMediumGap', 'thinThickLargeGap', 'thickThinLargeGap', 'thinThickThinLargeGap', 'wave'][p_size % 25 + 1], 'single') as border,
coalesce(['left', 'center', 'right', 'both', 'distribute', 'thaiDistribute'][p_size % 8 + 1], 'left') as alignment, coalesce(['none', 'single', 'word', 'double', 'dotted', 'thick', 'dash', 'dotDash', 'dotDotDash', 'wave', 'thickWave'][p_size % 13 + 1], 'none') as underline, case p_size % 4 when 1 then 'center' when 2 then 'right' else 'left' end as level from part""")
def format_tokens(t: Tables) -> DataFrame:
    n = F.col("p_size")
    return t.part.select("p_partkey", formats.border_token(formats.border_style(n % 25)).alias("border"), formats.alignment_token(n % 8).alias("alignment"), formats.underline_token(n % 13).alias("underline"), formats.level_alignment(n % 4).alias("level"))


@query("""select l_orderkey, list_transform(w, lambda x, i: case when x > 0 then x + case when i = 1 then 3 else 1 end else x end) as widths from (select l_orderkey, list(l_partkey % 3 order by l_linenumber, l_partkey % 3) as w from lineitem group by l_orderkey)""")
def legacy_table_widths(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 3).alias("w")))), lambda x: x["w"]).alias("w"))
    return rows.select("l_orderkey", formats.legacy_widths(F.col("w")).alias("widths"))


def _bytes(value: str, size: int) -> str:
    """SQL of a number's bytes, the lowest first."""
    return "concat(" + ", ".join(f"unhex(lpad(hex(shiftright({value}, {8 * k}) & 255), 2, '0'))" for k in range(size)) + ")"


@query("""select * replace (back::bigint as back) from (select p_partkey, case when p_partkey % 4 = 3 then null when p_partkey % 4 = 2 then p_partkey % 17 else p_partkey * 7 end as fore, case when p_partkey % 4 = 3 then null when p_partkey % 4 = 2 then p_size % 17 else p_size * 1000 end as back,
case when p_partkey % 4 = 3 then null when p_partkey % 4 = 2 then 'clear' when p_size % 5 = 0 then 'nil' when p_size % 5 = 1 then 'solid' when p_size % 5 = 2 then 'pct5' when p_size % 5 = 3 then 'pct10' else 'pct20' end as pattern from part)""")
def shading_operands(t: Tables) -> DataFrame:
    direct = f"concat({_bytes('p_partkey * 7', 4)}, {_bytes('p_size * 1000L', 4)}, {_bytes('if(p_size % 5 = 0, 65535L, p_size % 5)', 2)})"
    data = F.expr(f"case p_partkey % 4 when 0 then {direct} when 1 then concat(unhex('0A'), {direct}) when 2 then concat({_bytes('p_partkey % 17', 2)}, {_bytes('p_size % 17L', 2)}) else unhex('0102') end")
    return t.part.select("p_partkey", formats.shading_operand(data).alias("s")).select("p_partkey", "s.fore", "s.back", "s.pattern")


@query("""select event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '] [WARNING] ' || event_type || case when event_id % 3 = 0 then '' else chr(10) || '  Exception: IOException: ' || user_id end as line from events""")
def diagnostic_lines(t: Tables) -> DataFrame:
    kind = F.expr("if(event_id % 3 = 0, null, 'IOException')")
    return t.events.select("event_id", text.message(F.lit("Warning"), F.col("event_type"), kind, F.col("user_id").cast("string"), F.col("ts")).alias("line"))


_FLAT_SQL = """(select conv_id, turn, replace(replace(text, ' th', chr(7)), '. ', chr(7) || chr(7)) || case turn % 3 when 0 then chr(7) when 1 then chr(13) else '' end as t from conversations)"""
_ROWS_SQL = f"""(select conv_id, turn, t, list_filter(list_transform(list_transform(regexp_split_to_array(t, '\\r+|\\x07{{2,}}'), lambda l: struct_pack(e := case when l like '%' || chr(7) then 1 else 0 end, c := list_transform(string_split(l, chr(7)), lambda x: trim(replace(x, chr(13), chr(10)), chr(13) || chr(10) || chr(9) || ' ')))),
lambda s: s.c[1:greatest(s.e, list_max(list_transform(s.c, lambda x, i: case when trim(x) = '' then 0 else i end)))]), lambda r: len(r) > 0) as rows from {_FLAT_SQL})"""


def _flat(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.expr("concat(replace(replace(text, ' th', char(7)), '. ', repeat(char(7), 2)), case turn % 3 when 0 then char(7) when 1 then char(13) else '' end)").alias("t"))


@query(f"select conv_id, turn, rows from {_ROWS_SQL}")
def flat_rows(t: Tables) -> DataFrame:
    return _flat(t).select("conv_id", "turn", tables.row_candidates(F.col("t")).alias("rows"))


@query(f"""with p as (select conv_id, greatest(case when conv_id % 3 = 0 then turn % 3 else 0 end, case when n < 2 then 0 when n = 6 or (n % 3 = 0 and n >= 6) then 3 when n % 2 = 0 then 2 else least(3, n) end) as hint, coalesce(list_max(list_transform(rows, lambda r: len(r))), 0) as most, len(list_filter(rows, lambda r: len(r) = 2)) > 0 as two,
len(list_filter(flatten(rows), lambda x: x like '%:%' or x like '%：%')) as labels, len(flatten(rows)) as cells from (select *, coalesce(list_max(list_transform(regexp_extract_all(t, '\\x07{{2,}}'), lambda m: length(m))), 0) as n from {_ROWS_SQL})),
g as (select conv_id, max(hint) as hint, max(most) as most, bool_or(two) as two, sum(labels) as labels, sum(cells) as cells from p group by conv_id),
e as (select conv_id, case when hint >= 2 then hint when most <= 4 then most when two or labels >= greatest(4, cells - 1) then 2 else most end as columns from g)
select conv_id, columns::integer as columns, columns >= 2 and (conv_id % 4 <= 1 or conv_id % 5 < columns) as needed from e""")
def flat_tables(t: Tables) -> DataFrame:
    """How many columns flat paragraphs have, and whether the document's tables are too narrow for them."""
    widths = F.expr("if(conv_id % 3 = 0 and turn % 3 > 0, sequence(1, int(turn % 3)), cast(array() as array<int>))")
    estimates = tables.estimated_columns(_flat(t).withColumn("w", widths), "conv_id", "t", "w")
    known = t.conversations.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 4).alias("row_count"), (F.col("conv_id") % 5).alias("column_count"), F.lit(99).alias("most_cells")).filter("conv_id % 7 < 99")
    return estimates.join(tables.needs_recovery(estimates, known, "conv_id"), "conv_id").select("conv_id", "columns", "needed")


_LINES = """(select l_orderkey, l_discount >= 0.09 as shaded, case when l_linenumber % 2 = 0 then ' ' else 'x' end as t, case when l_returnflag = 'A' then l_tax > 0.02 else l_linestatus = 'O' end as white, (l_partkey % 4) * 1000 as colour from lineitem)"""


@query(f"""select l_orderkey, not bool_or(shaded) and count(*) filter (where t = 'x') > 0 and count(*) filter (where t = 'x' and white) = count(*) filter (where t = 'x') as needed from {_LINES} group by l_orderkey""")
def unshaded_headers(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("t", F.expr("if(l_linenumber % 2 = 0, ' ', 'x')"))
    white = tables.is_white(F.col("l_returnflag") == "A", F.expr("if(l_tax > 0.02, 16777215, 255)"), F.expr("if(l_linestatus = 'O', 8, 1)"))
    return tables.unshaded_headers(rows, ["l_orderkey"], F.col("l_discount") >= 0.09, F.col("t"), white)


@query(f"""with c as (select l_orderkey, colour, count(*) as n from {_LINES} where colour <> 0 group by all) select o_orderkey as l_orderkey, coalesce((select arg_max(colour, (n, colour)) from c where c.l_orderkey = o_orderkey), case when o_orderkey % 2 = 0 then 16777220 else 12419407 end) as colour from orders""")
def header_colours(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.header_colours(rows, t.lineitem.select("l_orderkey", (F.col("l_partkey") % 4 * 1000).alias("colour")), ["l_orderkey"], F.col("l_orderkey") % 2 == 0)


@query("""select l_orderkey, bool_or(l_quantity = 50) as nested, bool_or(l_discount > 0.05) as renderable, bool_or(not (l_tax > 0.02 or l_discount > 0.05 or l_quantity = 50)) as empty_cells,
bool_or(l_quantity = 50) or (bool_or(l_discount > 0.05) and (l_orderkey % 3 > 0 or bool_or(not (l_tax > 0.02 or l_discount > 0.05 or l_quantity = 50)))) as needs_borders from lineitem group by l_orderkey""")
def table_predicates(t: Tables) -> DataFrame:
    return tables.table_needs(t.lineitem, "l_orderkey", F.col("l_orderkey") % 3 == 0, F.col("l_quantity") == 50, F.col("l_discount") > 0.05, F.col("l_tax") > 0.02)


@query("""select p_partkey, case when own is not null then coalesce(nullif(own.indent, 0), st.indent, own.indent) when needs then 0 end as indent,
case when own is null and not needs then null when own is not null and coalesce(own.b, st.b) is not null then coalesce(own.b, st.b) when needs then 'Single' end as top from (
select p_partkey, case when p_partkey % 3 > 0 then struct_pack(indent := p_size % 4, b := case when p_partkey % 5 = 0 then 'Double' end) end as own, case when p_partkey % 2 = 0 then struct_pack(indent := 7, b := case when p_partkey % 7 = 0 then 'Thick' end) end as st, p_size % 2 = 0 as needs from part)""")
def effective_tables(t: Tables) -> DataFrame:
    border = lambda cond, style: F.when(cond, F.struct(F.lit(style).alias("style"), F.lit(4).alias("width"), F.lit(0).alias("space"), F.lit(0).alias("colour")))
    none = F.lit(None).cast("struct<style:string,width:int,space:int,colour:int>")

    def record(indent: Column, top: Column) -> Column:
        values = {"style": F.lit(-1), "spacing": F.lit(0), "indent": indent, "justify": F.lit(0), "width": F.lit(0), "border_top": top, "shading": F.lit(None).cast("string")}
        return F.struct(*[values.get(n, none).alias(n) for n in properties.TABLE_DEFAULTS])

    own = F.when(F.col("p_partkey") % 3 > 0, record((F.col("p_size") % 4).cast("int"), border(F.col("p_partkey") % 5 == 0, "Double")))
    style = F.when(F.col("p_partkey") % 2 == 0, record(F.lit(7), border(F.col("p_partkey") % 7 == 0, "Thick")))
    rows = t.part.select("p_partkey", own.alias("own"), style.alias("style"), (F.col("p_size") % 2 == 0).alias("needs"))
    made = rows.select("p_partkey", properties.effective_table(F.col("own"), F.col("style"), F.col("needs")).alias("e"))
    return made.select("p_partkey", "e.indent", F.col("e.border_top.style").alias("top"))


@query("""select * replace (size::integer as size) from (select o_orderkey, case when o_orderkey % 5 > 0 and o_orderkey % 3 > 0 then 20 + o_orderkey % 3 when o_orderkey % 2 = 0 and o_orderkey % 7 > 0 then 30 + o_orderkey % 7 else 24 + o_custkey % 2 * 4 end as size,
o_custkey % 4 = 0 or (o_orderkey % 2 = 0 and o_orderkey % 9 = 0) or (o_orderkey % 5 > 0 and o_orderkey % 6 = 0) as bold,
case when o_orderkey % 5 > 0 and o_orderkey % 4 = 0 then o_orderkey % 8 = 0 else o_custkey % 3 = 0 or (o_orderkey % 2 = 0 and o_orderkey % 11 = 0) or (o_orderkey % 5 > 0 and o_orderkey % 8 = 0) end as italic from orders)""")
def effective_properties(t: Tables) -> DataFrame:
    """Paragraph style, over it character style, over it direct formatting; 24 is an unset size."""
    defaults = {"size": 24, "bold": False, "italic": False}
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    record = lambda size, bold, italic, explicit: F.struct(size.cast("int").alias("size"), bold.alias("bold"), italic.alias("italic"), explicit.alias("explicit_italic"))
    paragraph = F.struct((24 + c % 2 * 4).cast("int").alias("size"), (c % 4 == 0).alias("bold"), (c % 3 == 0).alias("italic"))
    character = F.when(k % 2 == 0, record(F.when(k % 7 > 0, 30 + k % 7).otherwise(24), k % 9 == 0, k % 11 == 0, F.lit(False)))
    direct = F.when(k % 5 > 0, record(F.when(k % 3 > 0, 20 + k % 3).otherwise(24), k % 6 == 0, k % 8 == 0, k % 4 == 0))
    rows = t.orders.select("o_orderkey", paragraph.alias("p"), character.alias("c"), direct.alias("d"))
    return rows.select("o_orderkey", properties.effective_run(F.col("p"), F.col("c"), F.col("d"), defaults).alias("e")).select("o_orderkey", "e.*")


@query("""select p_partkey, case when p_size % 3 = 0 and p_partkey % 4 > 0 then p_partkey % 5 when p_size % 3 = 0 then 0 else p_size % 3 end as font, case when p_size % 2 = 0 then true when p_partkey % 4 > 0 then p_partkey % 3 = 0 else false end as bold from part""")
def filled_properties(t: Tables) -> DataFrame:
    """What a style leaves unset comes from its base, if it has one."""
    own = F.struct((F.col("p_size") % 3).alias("font"), (F.col("p_size") % 2 == 0).alias("bold"))
    base = F.when(F.col("p_partkey") % 4 > 0, F.struct((F.col("p_partkey") % 5).alias("font"), (F.col("p_partkey") % 3 == 0).alias("bold")))
    rows = t.part.select("p_partkey", own.alias("o"), base.alias("b"))
    return rows.select("p_partkey", *properties.filled(F.col("o"), F.col("b"), {"font": 0, "bold": False}))


@query("""select * replace (level::bigint as level, line::bigint as line) from (with r as (select p_partkey, p_size % 3 as j, p_size % 4 as sb, p_size % 5 as lb, p_partkey % 3 as li, p_size % 2 as lv, p_size % 7 = 0 as ex, case when p_size % 6 = 0 then 240 else 300 end as ln, p_partkey % 5 > 0 as st, p_partkey % 4 as sj, p_partkey % 2 as ssb, p_partkey % 7 as slb, p_partkey % 6 as sli, p_partkey % 9 = 0 as sex from part)
select p_partkey, case when j = 0 and st then sj else j end as justify, case when sb = 0 and st then ssb else sb end as space_before, case when sb = 0 and lb = 0 and st and ssb = 0 then slb else lb end as lines_before,
case when li = 0 and st and sli > 0 then sli else li end as list, case when st and ((li = 0 and sli > 0) or (li > 0 and lv = 0 and sli = li)) then 5 else lv end as level,
case when not ex and st and (sex or ln = 240) then 360 else ln end as line, ex or (st and sex) as explicit_line from r)""")
def paragraph_styles(t: Tables) -> DataFrame:
    """A paragraph's unset fields from its style; some have none."""
    p, n = F.col("p_partkey"), F.col("p_size").cast("long")
    zero = F.lit(0).cast("long")
    names = [k for k in properties.PARAGRAPH_DEFAULTS if k not in ("list", "level", "outline_level", "justify", "keep", "keep_next", "page_break")]

    def record(justify: Column, space: Column, lines: Column, listed: Column, level: Column, explicit: Column, line: Column) -> Column:
        own = {"justify": justify, "space_before": space, "lines_before": lines, "space_after": zero, "lines_after": zero, "list": listed, "level": level, "explicit_line": explicit, "line": line, "line_multiple": F.lit(1).cast("long"), "keep": F.lit(False), "keep_next": F.lit(False), "page_break": F.lit(False)}
        return F.struct(*[v.alias(k) for k, v in (own | dict.fromkeys(names, zero)).items()])

    own = record(n % 3, n % 4, n % 5, p % 3, n % 2, n % 7 == 0, F.when(n % 6 == 0, F.lit(240).cast("long")).otherwise(F.lit(300).cast("long")))
    style = F.when(p % 5 > 0, record(p % 4, p % 2, p % 7, p % 6, F.lit(5).cast("long"), p % 9 == 0, F.lit(360).cast("long")))
    rows = t.part.select("p_partkey", own.alias("o"), style.alias("s"))
    return rows.select("p_partkey", properties.paragraph_with_style(F.col("o"), F.col("s")).alias("e")).select("p_partkey", "e.justify", "e.space_before", "e.lines_before", "e.list", "e.level", "e.line", "e.explicit_line")


@query("""select doc_id, case when doc_id % 3 = 0 then 'Own' when doc_id % 4 = 1 or regexp_matches(text, '[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]') then case when doc_id % 2 = 0 then 'Minor' else 'SimSun' end end as font from documents""")
def east_asian_fonts(t: Tables) -> DataFrame:
    made = text.east_asian_font(F.expr("if(doc_id % 3 = 0, 'Own', '')"), F.col("text"), F.expr("if(doc_id % 4 = 1, 2052, 1033)"), F.expr("if(doc_id % 2 = 0, 'Minor', null)"), F.lit(None).cast("string"))
    return t.documents.select("doc_id", made.alias("font"))


@query("""with s as (select distinct o_custkey, (o_orderkey % 12)::integer as style_id from orders), d as (select 0 as style_id, 'Normal' as name, 24 as size union all select i, 'heading ' || i, (18 - 2 * i) * 2 from range(1, 10) r(i))
select o_custkey, style_id, 'own' as name, 20 as size from s union all select c.o_custkey, d.style_id::integer, d.name, d.size::integer from (select distinct o_custkey from orders) c, d where not exists (select 1 from s where s.o_custkey = c.o_custkey and s.style_id = d.style_id)
union all select distinct o_custkey, 10, 'Default Paragraph Font', 24 from orders""")
def style_defaults(t: Tables) -> DataFrame:
    """Own styles, and the default ones that a document lacks; a character style isn't a paragraph style of the same number."""
    own = t.orders.select("o_custkey", (F.col("o_orderkey") % 12).cast("int").alias("style_id")).distinct().select("*", F.lit("paragraph").alias("kind"), F.lit("own").alias("name"), F.lit(20).alias("size"))
    defaults = properties.default_styles(t.spark).select("style_id", "kind", "name", "size")
    return properties.with_default_styles(own, defaults, "o_custkey").select("o_custkey", "style_id", "name", "size")


_RANGES = """b as (select user_id, event_id as s, coalesce(lead(event_id) over w, event_id + 5) as e, case when event_id % 3 = 0 then 24 else (event_id % 3 * 10)::integer end as size, event_id % 4 = 0 as bold from events window w as (partition by user_id order by event_id)),
o as (select user_id, event_id as s, least(coalesce(lead(event_id) over w, event_id + 40), event_id + 40) as e, case when event_id % 2 = 0 then 24 else (event_id % 2 * 50)::integer end as size, event_id % 5 = 0 as bold from events where event_type in ('click', 'view') window w as (partition by user_id order by event_id))"""
_SEGMENTS = """p as (select user_id, s as p0 from b union select user_id, e from b union select user_id, s from o union select user_id, e from o), g as (select user_id, p0, lead(p0) over (partition by user_id order by p0) as nx from p)"""


def _ranges(t: Tables) -> tuple[DataFrame, DataFrame]:
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    k = F.col("event_id")
    base = t.events.select("user_id", k.alias("s"), F.coalesce(after, k + 5).alias("e"), F.when(k % 3 == 0, 24).otherwise(k % 3 * 10).cast("int").alias("size"), (k % 4 == 0).alias("bold"))
    over = t.events.filter("event_type in ('click', 'view')")
    over = over.select("user_id", k.alias("s"), F.least(F.coalesce(after, k + 40), k + 40).alias("e"), F.when(k % 2 == 0, 24).otherwise(k % 2 * 50).cast("int").alias("size"), (k % 5 == 0).alias("bold"))
    return base, over


@query(f"""with {_RANGES}, {_SEGMENTS} select g.user_id, g.p0 as s, g.nx as e, coalesce(nullif(o.size, 24), b.size) as size, b.bold or coalesce(o.bold, false) as bold from g join b on b.user_id = g.user_id and b.s <= g.p0 and g.p0 < b.e left join o on o.user_id = g.user_id and o.s <= g.p0 and g.p0 < o.e where g.nx is not null""")
def range_overlay(t: Tables) -> DataFrame:
    """Ranges of any length with others laid over them, segment by segment."""
    base, over = _ranges(t)
    return properties.overlaid_runs(base, over, ["user_id"], "s", "e", {"size": 24, "bold": False})


@query(f"""with {_RANGES}, {_SEGMENTS}, x as (select b.user_id, b.s as ident, b.size as own, b.bold as own_bold, g.p0, o.size, o.bold from g join b on b.user_id = g.user_id and b.s <= g.p0 and g.p0 < b.e left join o on o.user_id = g.user_id and o.s <= g.p0 and g.p0 < o.e where g.nx is not null)
select user_id, ident, coalesce(arg_max(size, p0) filter (where size <> 24), any_value(own)) as size, any_value(own_bold) or coalesce(bool_or(bold), false) as bold from x group by user_id, ident""")
def overlaid_paragraphs(t: Tables) -> DataFrame:
    base, over = _ranges(t)
    return properties.overlaid_in_order(base.withColumn("ident", F.col("s")), over, ["user_id"], "s", "e", "ident", {"size": 24, "bold": False})


@query("""with b as (select user_id, event_id as s, coalesce(lead(event_id) over (partition by user_id order by event_id), event_id + 5) as e, event_type, value > 50 as big from events), m as (select distinct user_id, event_id + 1 as m from events where event_type = 'error'),
c as (select user_id, m as c from m union select user_id, m + 1 from m), p as (select user_id, s as p0 from b union select user_id, e from b union select user_id, c from c), g as (select user_id, p0, lead(p0) over (partition by user_id order by p0) as nx from p),
x as (select b.user_id, g.p0, g.nx, event_type, big, m.m is not null as special from g join b on b.user_id = g.user_id and b.s <= g.p0 and g.p0 < b.e left join m on m.user_id = g.user_id and m.m = g.p0 where nx is not null),
y as (select *, coalesce(lag(event_type) over w = event_type and lag(big) over w = big and lag(nx) over w = p0 and not special and not lag(special) over w, false) as same from x window w as (partition by user_id order by p0)),
z as (select *, sum(case when same then 0 else 1 end) over (partition by user_id order by p0 rows unbounded preceding) as run from y)
select user_id, min(p0) as s, max(nx) as e, any_value(special) as special, any_value(event_type) as event_type, any_value(big) as big from z group by user_id, run""")
def property_runs(t: Tables) -> DataFrame:
    """Runs of equal properties, with special marks apart."""
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    ranges = t.events.select("user_id", F.col("event_id").alias("s"), F.coalesce(after, F.col("event_id") + 5).alias("e"), "event_type", (F.col("value") > 50).alias("big"))
    marks = t.events.filter("event_type = 'error'").select("user_id", (F.col("event_id") + 1).alias("m"))
    return sequences.property_runs(ranges, ["user_id"], "s", "e", ["event_type", "big"], marks, "m")


_PARAS = """q as (select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 5 as para_idx from events), pa as (select user_id, para_idx, min(event_id) as start_cp, max(event_id) + 1 as end_cp from q group by all)"""


def _paragraphs(t: Tables) -> tuple[DataFrame, DataFrame]:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    runs = t.events.select("user_id", F.col("event_id").alias("cp"), F.floor(place / 5).alias("para_idx"))
    return runs, runs.groupBy("user_id", "para_idx").agg(F.min("cp").alias("start_cp"), (F.max("cp") + 1).alias("end_cp"))


@query(f"""with {_PARAS}, r as (select * from q where para_idx % 4 < 3), m as (select user_id, event_id as start_cp, event_id + event_id % 3 as end_cp, 'b' || event_id as name, event_id as ord from events where event_type = 'signup'),
l as (select user_id, start_cp as cp, 'start' as kind, name, ord, 0 as rank from m union all select user_id, end_cp, 'end', name, ord, 1 from m),
s as (select user_id, para_idx, event_id as cp, 0 as side from r union select user_id, para_idx, start_cp, 0 from pa where para_idx % 4 = 3 union select user_id, para_idx, end_cp, 1 from pa),
a as (select s.user_id, para_idx, s.cp, kind, name, ord, rank, side from s join l on l.user_id = s.user_id and l.cp = s.cp union all select user_id, para_idx, event_id, 'run', null, 0, 2, 0 from r)
select user_id, para_idx, row_number() over (partition by user_id, para_idx order by cp, side, rank, ord) as pos, cp, kind, name from a""")
def bookmark_markers(t: Tables) -> DataFrame:
    runs, paragraphs = _paragraphs(t)
    k = F.col("event_id")
    marks = t.events.filter("event_type = 'signup'").select("user_id", k.alias("start_cp"), (k + k % 3).alias("end_cp"), F.concat(F.lit("b"), k.cast("string")).alias("name"), k.alias("ord"))
    return sequences.with_markers(runs.filter("para_idx % 4 < 3"), marks, paragraphs, ["user_id"], "cp")


@query(f"""with {_PARAS}, b as (select user_id, para_idx, coalesce(case when para_idx % 4 < 3 then start_cp end, max(case when para_idx % 4 < 3 then end_cp end) over (partition by user_id order by para_idx rows between unbounded preceding and 1 preceding), 0) as b from pa),
c as (select user_id, event_id as idx, event_id as s, event_id + event_id % 7 - 2 as e from events where event_type = 'error'),
f as (select c.*, coalesce((select arg_max(para_idx, (b, para_idx)) from b where b.user_id = c.user_id and b.b <= c.s), (select arg_min(para_idx, (b, para_idx)) from b where b.user_id = c.user_id)) as start_para, coalesce((select arg_max(para_idx, (b, para_idx)) from b where b.user_id = c.user_id and b.b <= c.e), (select arg_min(para_idx, (b, para_idx)) from b where b.user_id = c.user_id)) as ep from c)
select user_id, idx, start_para, case when e > s then ep else start_para end as end_para from f""")
def comment_paragraphs(t: Tables) -> DataFrame:
    _, paragraphs = _paragraphs(t)
    some = F.col("para_idx") % 4 < 3
    paragraphs = paragraphs.select("user_id", "para_idx", F.when(some, F.col("start_cp")).alias("start_cp"), F.when(some, F.col("end_cp")).alias("end_cp"))
    k = F.col("event_id")
    comments = t.events.filter("event_type = 'error'").select("user_id", k.alias("idx"), k.alias("start_cp"), (k + k % 7 - 2).alias("end_cp"))
    return stories.comment_paragraphs(comments, paragraphs, "user_id").select("user_id", "idx", "start_para", "end_para")


@query(f"""with {_PARAS}, r as (select user_id, event_id as s, event_id + 2 as e, event_id as v from events where event_type = 'purchase' and event_id % 3 = 0)
select user_id, para_idx, coalesce((select any_value(v) from r where r.user_id = pa.user_id and s <= start_cp and start_cp < e), (select arg_min(v, s) from r where r.user_id = pa.user_id and s > start_cp and s <= end_cp), (select arg_max(v, s) from r where r.user_id = pa.user_id and e - 1 < start_cp and start_cp - (e - 1) <= 400),
(select case when min(s) <= start_cp + 400 then arg_min(v, s) end from r where r.user_id = pa.user_id)) as v from pa""")
def property_at(t: Tables) -> DataFrame:
    _, paragraphs = _paragraphs(t)
    k = F.col("event_id")
    ranges = t.events.filter("event_type = 'purchase' and event_id % 3 = 0").select("user_id", k.alias("start_cp"), (k + 2).alias("end_cp"), k.alias("v"))
    return matching.property_at(paragraphs, ranges, ["user_id"], "v", 400).select("user_id", "para_idx", "v")


@query("""with pc as (select user_id, event_id as n, row_number() over (partition by user_id order by event_id) * 10 - 10 as cs, event_id * 50 as o, event_id * 100 as raw, event_id % 2 = 0 as wide from events), x as (select *, case when wide then 2 else 1 end as step from pc),
pt as (select distinct user_id, event_id * 37 as fc from events union select user_id, max(o) + 10 * arg_max(step, n) from x group by user_id), c as (select pt.*, x.n, 0 as way, cs + (fc - o) // step as cp from pt join x on x.user_id = pt.user_id and o <= fc and fc < o + 10 * step union all select pt.*, x.n, 1, cs + (fc - raw) // 2 from pt join x on x.user_id = pt.user_id and raw <= fc and fc < raw + 20),
b as (select user_id, fc, arg_min(cp, (n, way)) as cp from c group by all), l as (select user_id, arg_max(cs + 10, n) as e, arg_max(o + 10 * step, n) as s1, arg_max(raw + 20, n) as s2 from x group by user_id)
select pt.user_id, pt.fc, coalesce(b.cp, case when pt.fc in (s1, s2) then e end, greatest(0, least(pt.fc, 5000))) as cp, coalesce(b.cp, case when pt.fc in (s1, s2) then e end) is null as clamped from pt left join b on b.user_id = pt.user_id and b.fc = pt.fc join l on l.user_id = pt.user_id""")
def positions_of_bytes(t: Tables) -> DataFrame:
    k = F.col("event_id")
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 10 - 10).cast("long")
    pieces = t.events.select("user_id", k.alias("piece_no"), place.alias("cp_start"), (place + 10).alias("cp_end"), (k * 50).alias("offset"), (k * 100).alias("raw"), (k % 2 == 0).alias("wide"))
    last = pieces.groupBy("user_id").agg(F.max_by(F.col("offset") + F.when(F.col("wide"), 20).otherwise(10), "piece_no").alias("fc"))
    points = t.events.select("user_id", (k * 37).alias("fc")).unionByName(last).distinct()
    return stories.positions_of_bytes(points, pieces, ["user_id"], "fc", F.lit(5000).cast("long"))


@query("""select conv_id, turn, case when turn % 3 > 0 then text when turn % 2 = 1 then 'again' when turn % 4 = 0 then 'table' else '' end as note, replace(text, chr(10), chr(10)) as comment from conversations""")
def note_texts(t: Tables) -> DataFrame:
    """A garbled note is decoded anew, and at last taken as it is; a comment loses the marks at its end."""
    own, again, table = F.expr("if(turn % 3 > 0, text, repeat(char(0), 3))"), F.expr("if(turn % 2 = 1, 'again', '')"), F.expr("if(turn % 4 = 0, 'table', '')")
    note = stories.note_text(own, again, table)
    comment = stories.comment_text(F.expr("concat(replace(text, char(10), char(13)), char(13), char(5))"))
    return t.conversations.select("conv_id", "turn", F.when(F.startswith(note, F.lit("\0")), F.lit("")).otherwise(note).alias("note"), comment.alias("comment"))


@query("""with s as (select user_id, event_id % 20 as idx, arg_max(event_id, event_id) as cp from events where event_type = 'click' group by all), e as (select user_id, event_id % 30 as idx, arg_max(event_id, event_id) as cp from events where event_type = 'view' group by all), c as (select user_id, min(event_id) as cp, event_id % 25 as idx from events group by user_id, event_id % 25)
select c.user_id, c.idx, coalesce(s.cp, c.cp) as start_cp, coalesce(e.cp, c.cp) as end_cp from c left join s on s.user_id = c.user_id and s.idx = c.idx left join e on e.user_id = c.user_id and e.idx = c.idx""")
def refined_comments(t: Tables) -> DataFrame:
    k = F.col("event_id")
    side = lambda kind, n: t.events.filter(F.col("event_type") == kind).select("user_id", (k % n).alias("idx"), k.alias("cp"), k.alias("ord"))
    comments = t.events.groupBy("user_id", (k % 25).alias("idx")).agg(F.min("event_id").alias("cp"))
    return stories.refined_comments(comments, side("click", 20), side("view", 30), "user_id").select("user_id", "idx", "start_cp", "end_cp")


@query("""with c as (select o_custkey, list(o_orderkey % 900 order by o_orderkey % 900) as cps from orders group by o_custkey), x as (select o_custkey, cps, unnest(range(0, ((len(cps) - 1) // 6) * 6)) as i from c)
select o_custkey, (i // 6)::integer as section, ['HeaderEven', 'HeaderOdd', 'FooterEven', 'FooterOdd', 'HeaderFirst', 'FooterFirst'][i % 6 + 1] as kind, cps[i + 1] as cp, least(cps[i + 2], 700) - cps[i + 1] as size from x where cps[i + 1] < 700 and least(cps[i + 2], 700) > cps[i + 1]""")
def header_slots(t: Tables) -> DataFrame:
    """Six slots to a section, clamped to the story."""
    rows = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.col("o_orderkey") % 900)).alias("cps"))
    return rows.select("o_custkey", F.explode(stories.header_slots(F.col("cps"), F.lit(700).cast("long"))).alias("s")).select("o_custkey", "s.*")


@query("""select o_custkey, coalesce(nullif(min(case when o_orderstatus = 'F' then o_orderkey end), 0), max(o_orderkey)) as ccp, count(*) filter (where u and k < 2) as n_headers, count(*) filter (where u and k >= 2) as n_footers, bool_or(o_orderkey % 97 = 0) or bool_or(u and k in (0, 2)) as even_and_odd
from (select *, o_orderkey % 4 as k, o_totalprice between 1000 and 100000 as u from orders) group by o_custkey""")
def header_parts(t: Tables) -> DataFrame:
    """A story length repaired from its last position; usable parts, and whether even pages differ."""
    kind = F.expr("element_at(array('HeaderEven', 'HeaderOdd', 'FooterEven', 'FooterFirst'), int(o_orderkey % 4) + 1)")
    settings = stories.header_settings(t.orders, "o_custkey", kind, F.col("o_totalprice").between(1000, 100000), F.col("o_orderkey") % 97 == 0)
    lengths = t.orders.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("n"), F.sort_array(F.collect_list("o_orderkey")).alias("cps"))
    return lengths.select("o_custkey", stories.repaired_length(F.col("n"), F.col("cps")).alias("ccp")).join(settings, "o_custkey")


@query("""select * replace (page_width::bigint as page_width, page_height::bigint as page_height, gutter::bigint as gutter) from (select p_partkey, case when p_size % 3 = 0 then p_size * 1000 else 11906 end as page_width, case when p_size % 4 = 0 then 9000 else 16838 end as page_height, case when p_partkey % 2 = 0 or p_partkey % 5 = 0 then case when p_size % 3 = 0 then 300 else 0 end else 0 end as gutter,
case when p_size % 3 = 0 then p_size * 1000 else 11906 end > case when p_size % 4 = 0 then 9000 else 16838 end as landscape, p_size % 4 = 0 as title_page from part)""")
def section_pages(t: Tables) -> DataFrame:
    wide, high = "if(p_size % 3 = 0, map('page_width', p_size * 1000L, 'gutter', 300L), cast(map() as map<string, bigint>))", "if(p_size % 4 = 0, map('page_height', 9000L, 'title_page', 1L), cast(map() as map<string, bigint>))"
    made = stories.section_page(F.expr(f"map_concat({wide}, {high})"), F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 5 == 0)
    return t.part.select("p_partkey", made.alias("s")).select("p_partkey", *[f"s.{c}" for c in ("page_width", "page_height", "gutter", "landscape", "title_page")])


@query("""select * replace (page_height::bigint as page_height, "left"::bigint as "left", "right"::bigint as "right", top::bigint as top, bottom::bigint as bottom) from (select o_custkey, arg_min(o_orderkey * 10, o_orderkey) as page_width, 16838 as page_height, 1440 as "left", 1440 as "right", 1440 as top, 1440 as bottom from orders group by o_custkey)""")
def document_pages(t: Tables) -> DataFrame:
    page = stories.section_page(F.expr("map('page_width', o_orderkey * 10)"), F.lit(False), F.lit(False))
    return stories.document_page(t.orders.select("o_custkey", "o_orderkey", page.alias("page")), "o_custkey", "o_orderkey", "page")


@query("""select conv_id, turn::varchar as story from conversations where turn % 4 > 0""")
def field_faults(t: Tables) -> DataFrame:
    """Of four kinds of stories only those with a begin and an end at listed places have a field."""
    story = F.expr("concat(case turn % 4 when 2 then 'x' else char(19) end, text, case turn % 4 when 1 then '' else char(21) end)")
    rows = t.conversations.select("conv_id", F.col("turn").cast("string").alias("story"), story.alias("text"), "turn")
    cps = F.when(F.col("turn") % 4 == 3, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.length("text") - 1))
    return stories.field_faults(rows.withColumn("cps", cps), "conv_id")


@query("""with r as (select user_id, event_id as run_idx, event_id % 4 as image, case when event_id % 5 = 0 then 9 else 0 end as w, row_number() over (partition by user_id, event_id % 4 order by event_id) as k, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as m from events where event_type = 'click'),
s as (select user_id, event_id % 3 as image, event_id % 6 * 10 as w, row_number() over (partition by user_id, event_id % 3 order by event_id % 50, event_id) as k, row_number() over (partition by user_id order by event_id % 50, event_id) as n, count(*) over (partition by user_id) as m from events where event_type = 'view')
select r.user_id, run_idx, r.image, coalesce(case when s.w > 0 then s.w end, case when r.w > 0 then r.w end, case when a.w > 0 then a.w end, 0)::integer as width, coalesce(case when s.w > 0 then s.w + 1 end, case when r.w > 0 then r.w + 1 end, case when a.w > 0 then a.w + 1 end, 0)::integer as height from r left join s on s.user_id = r.user_id and s.image = r.image and s.k = r.k left join s a on a.user_id = r.user_id and a.n = r.n and a.m = r.m""")
def picture_sizes(t: Tables) -> DataFrame:
    k = F.col("event_id")
    size = lambda w: [w.cast("int").alias("width"), F.when(w > 0, w + 1).otherwise(0).cast("int").alias("height")]
    runs = t.events.filter("event_type = 'click'").select("user_id", k.alias("run_idx"), (k % 4).alias("image"), *size(F.when(k % 5 == 0, 9).otherwise(0)))
    shapes_of = t.events.filter("event_type = 'view'").select("user_id", k.alias("shape_id"), (k % 50).alias("para"), F.lit(0).alias("z"), (k % 3).alias("image"), *size(k % 6 * 10))
    return stories.picture_sizes(runs, shapes_of, "user_id")


@query("""select p_partkey, case when p_size % 6 > 0 and round(w) > 0 and round(h) > 0 then round(w)::integer end as width, case when p_size % 6 > 0 and round(w) > 0 and round(h) > 0 then round(h)::integer end as height, p_partkey % 3 = 0 and p_size % 6 > 0 and round(w) > 0 and round(h) > 0 as flipped, octet_length(case when p_partkey % 2 = 0 then 'abc'::blob else ''::blob end) = 0 as placed
from (select *, least(p_size % 6 * 1000.0 * case when sx in (0, 1000) then 1000 else sx end / 1000, 4000) as w, p_size * 100.0 * 333 / 1000 as h from (select *, p_partkey % 4 * 500 as sx from part))""")
def picture_headers(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    scale = F.when(p % 3 == 0, -(p % 4) * 500).otherwise(p % 4 * 500)
    flip = F.when(p % 3 == 0, F.lit(-333)).otherwise(F.lit(333))
    made = shapes.picture_size(F.col("p_size") % 6 * 1000, F.col("p_size") * 100, scale, flip, F.lit(4000))
    image = shapes.image_bytes(F.expr("if(p_partkey % 2 = 0, cast('abc' as binary), cast('' as binary))"))
    rows = t.part.select("p_partkey", made.alias("m"), (image == F.lit(bytearray(shapes.PLACEHOLDER))).alias("placed"))
    return rows.select("p_partkey", "m.width", "m.height", F.coalesce("m.flip_y", F.lit(False)).alias("flipped"), "placed")


@query("""select user_id, event_id, event_type is not distinct from lag(event_type) over w and (value > 50) is not distinct from lag(value > 50) over w and lag(event_id) over w is not null as unchanged from events window w as (partition by user_id order by event_id)""")
def unchanged_rows(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", (F.col("value") > 50).alias("big"))
    return properties.unchanged(rows, ["user_id"], ["event_id"], ["event_type", "big"]).select("user_id", "event_id", "unchanged")


@query("""select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n > 2 and n <= 6""")
def page_of_rows(t: Tables) -> DataFrame:
    return sequences.page_of(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4, offset=2)


@query("""select conv_id, turn, idx::integer - 1 as para_idx, (turn * 1000 + coalesce(sum(length(seg) + 1) over (partition by conv_id, turn order by idx rows between unbounded preceding and 1 preceding), 0))::bigint as start_cp, length(seg)::bigint as size from (select conv_id, turn, unnest(string_split(replace(text, '. ', chr(13)), chr(13))) as seg, generate_subscripts(string_split(replace(text, '. ', chr(13)), chr(13)), 1) as idx from conversations)""")
def textbox_segments(t: Tables) -> DataFrame:
    """Paragraphs of textboxes at the places of their story."""
    rows = t.conversations.withColumn("key", F.struct("conv_id", "turn"))
    made = sequences.paragraphs(rows, "key", F.expr("replace(text, '. ', char(13))"), "\r", start=F.col("turn") * 1000)
    return made.select("key.conv_id", "key.turn", "para_idx", "start_cp", (F.col("end_cp") - F.col("start_cp")).alias("size"))


@query("""with c as (select o_custkey, o_orderkey, row_number() over w - 1 as i, count(*) over (partition by o_custkey) as n, o_custkey % 4 as c, case when o_custkey % 3 = 0 then o_custkey % 4 else 1 end = o_custkey % 4 as t from orders window w as (partition by o_custkey order by o_orderkey)),
l as (select *, t::integer as ti from c where c >= 2 and n > c), r as (select o_custkey, case when i < ti then 0 else ti + (i - ti) // c end as row_idx, case when i < ti then 0 else (i - ti) % c end as col_idx, case when i < ti then c else 1 end as span, o_orderkey, i, n, c, ti from l)
select o_custkey, row_idx::bigint as row_idx, col_idx::bigint as col_idx, span::bigint as span, o_orderkey from r union all select o_custkey, row_idx, k, 1, null from r, lateral (select unnest(range(col_idx + 1, c)) as k) where i = n - 1 and (ti = 0 or row_idx > 0)""")
def rows_of_single_cells(t: Tables) -> DataFrame:
    cells = t.orders.select("o_custkey", "o_orderkey", (F.col("o_custkey") % 4).alias("c"), F.expr("if(o_custkey % 3 = 0, o_custkey % 4, 1)").alias("lead"))
    return tables.rows_of_single_cells(cells, "o_custkey", "o_orderkey", "c", "lead")


_HINT_SQL = "case when n < 2 then 0 when n = 6 or (n % 3 = 0 and n >= 6) then 3 when n % 2 = 0 then 2 else least(3, n) end"


@query(f"""with r as (select user_id, event_id % 6 as n, case when user_id % 2 = 0 then 1 else event_id % 3 + 1 end as cells, user_id % 7 > 0 or event_id % 5 > 0 as flat, case when user_id % 3 = 0 then 0 else event_id % 9 end as width from events where event_id % 2 = user_id % 2),
g as (select user_id, bool_and(flat) as flat, max(cells) as now, max({_HINT_SQL}) as hint, max(n) as tail, max(width) as width from r group by user_id), c as (select *, case when now = 1 then greatest(hint, tail) else hint end as columns from g)
select user_id, columns::integer as columns, case when columns = 3 and now < 3 and width = 0 then [1242, 6378, 1621] end as widths from c where flat and columns > now and tail >= 2""")
def trailing_columns(t: Tables) -> DataFrame:
    rows = t.events.filter("event_id % 2 = user_id % 2").select("user_id", F.expr("concat('x', repeat(char(7), int(event_id % 6)))").alias("text"), F.expr("if(user_id % 2 = 0, 1, int(event_id % 3) + 1)").alias("cells"), F.expr("user_id % 7 > 0 or event_id % 5 > 0").alias("flat"), F.expr("if(user_id % 3 = 0, 0, event_id % 9)").alias("width"))
    return tables.trailing_columns(rows, "user_id", "text", "cells", "flat", "width")


@query("""select o_custkey, o_orderkey, coalesce(lead(o_orderkey) over w is null and lag(o_orderkey % 4) over w >= 2 and o_orderkey % 4 = 1, false) as trailing from orders window w as (partition by o_custkey order by o_orderkey)""")
def trailing_paragraphs(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4).alias("cells"), F.lit("x").alias("t"), F.lit(2).alias("columns"))
    return tables.trailing_paragraphs(rows, "o_custkey", "o_orderkey", "cells", "t", "columns").select("o_custkey", "o_orderkey", "trailing")


@query("""with j as (select user_id, list(event_id // 7 % 3 order by event_id) as j, (user_id % 6 + 1)::integer as n from events group by user_id), c as (select *, list_filter(j, lambda x, i: i = 1 or x <> j[i - 1]) as c from j), k as (select *, list_filter(c, lambda x, i: i = 1 or x <> 0)[1:greatest(2, n)] as k from c)
select user_id, k || list_transform(range(0, greatest(0, n - len(k))), lambda i: k[len(k)]) as alignments from k""")
def row_alignments(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", F.expr("event_id div 7 % 3").alias("j")))), lambda x: x["j"]).alias("j"))
    return rows.select("user_id", tables.row_alignments(F.col("j"), (F.col("user_id") % 6 + 1).cast("int")).alias("alignments"))


@query("""with c as (select o_custkey, o_orderkey, (row_number() over w - 1) // 4 as r, (row_number() over w - 1) % 4 as c from orders window w as (partition by o_custkey order by o_orderkey)), e as (select o_custkey, r, max(c) as m from c group by all)
select o_custkey, r as row_idx, c as col_idx, false as filler from c union all select o_custkey, r, k, true from e, lateral (select unnest(range(m + 1, 5)) as k)""")
def filled_rows(t: Tables) -> DataFrame:
    cells = sequences.chunked(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4).withColumn("columns", F.lit(5))
    return tables.filled_rows(cells, "o_custkey", "columns")


@query("""with c as (select user_id, event_id % 5 as row, event_id // 5 % (3 + user_id % 4) as col, value::double as number from events where event_id % 5 > 0 and event_id // 5 % (3 + user_id % 4) > 0 and event_id < 400),
v as (select user_id, row, col, max(number) as number from c group by all), h as (select user_id, max(row) as r, max(col) as c from v group by user_id)
select h.user_id, s.row as series, 'r' || s.row as name, list_transform(range(1, c + 1), lambda i: case when i % 2 = 1 then 'c' || i else 'Category ' || i end) as categories, list_transform(range(1, c + 1), lambda i: coalesce((list_filter(vs, lambda x: x.col = i)[1]).number, 0.0)) as values
from h join (select user_id, row, list(struct_pack(col := col, number := number)) as vs from v group by all) s on s.user_id = h.user_id""")
def chart_series(t: Tables) -> DataFrame:
    """Sheets with names in the first row and column, some missing."""
    k = F.col("event_id")
    place = t.events.filter("event_id < 400").select("user_id", (k % 5).alias("row"), F.expr("event_id div 5 % (3 + user_id % 4)").alias("col"), F.col("value").cast("double").alias("number"))
    numbers = place.filter("row > 0 and col > 0").groupBy("user_id", "row", "col").agg(F.max("number").alias("number")).withColumn("text", F.lit(None).cast("string"))
    users = numbers.select("user_id").distinct()
    named = lambda n, row, col, label: users.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("i")).select("user_id", row.cast("long").alias("row"), col.cast("long").alias("col"), F.lit(None).cast("double").alias("number"), F.concat(F.lit(label), F.col("i").cast("string")).alias("text"))
    heads = named(9, F.lit(0), F.col("i"), "c").filter("col % 2 = 1")
    sides = named(4, F.col("i"), F.lit(0), "r")
    return charts.chart_series(numbers.unionByName(heads).unionByName(sides), "user_id")


@query("""with s as (select l_suppkey, count(distinct l_returnflag) as n, count(*) as c from lineitem group by l_suppkey), k as (select *, case when n = 1 and c > 1 then 'Pie' when l_suppkey % 5 = 0 then 'Line' when l_suppkey % 5 = 1 then 'Bar' when l_suppkey % 5 = 2 then 'Doughnut' else 'Column' end as kind from s)
select l_suppkey, kind, case when n = 2 then case when kind in ('Pie', 'Doughnut') then 'Bottom' else 'Right' end end as legend, case when kind in ('Pie', 'Doughnut') then null when kind = 'Bar' then 'Left' else 'Bottom' end as category_axis, case when n = 1 and l_suppkey % 2 = 0 then 'Net' end as value_title, l_suppkey % 3 = 0 as reversed from k""")
def chart_types(t: Tables) -> DataFrame:
    """The kind of chart by its series and its stream's name, its legend, axes and titles."""
    n = t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_returnflag").alias("n"), F.count(F.lit(1)).alias("c"))
    name = F.expr("concat('My', element_at(array('LineChart', 'BARs', 'donutChart', 'Chart', 'x'), int(l_suppkey % 5) + 1))")
    rows = n.withColumn("kind", charts.chart_kind(F.col("n"), F.col("c"), name))
    categories = F.expr("case l_suppkey % 3 when 0 then array('2003', '2002', '1999.5') when 1 then array('3', 'x', '1') else array('1', '2') end")
    made = charts.chart_layout(F.col("kind"), F.col("n"), F.lit(True), F.expr("if(l_suppkey % 2 = 0, 'Net', 'Series 1')"), categories, F.lit(" "))
    return rows.select("l_suppkey", "kind", *[made[c].alias(c) for c in ("legend", "category_axis", "value_title", "reversed")])


@query("""with k as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as i from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\s]+|\\s+') as p from documents)),
w as (select *, coalesce(sum(length(piece) - length(replace(piece, 'e', ''))) over b, 0) as run, coalesce(sum(case when regexp_matches(piece, '^\\s') then 1 else 0 end) over b, 0) as cell, coalesce(sum(length(piece)) over b, 0) as at_text,
max(case when contains(piece, 'e') then length(piece) - length(regexp_extract(piece, '[^e]*$')) end) over () as x from k window b as (partition by doc_id order by i rows between unbounded preceding and 1 preceding)),
e as (select doc_id, i, last_value(case when contains(piece, 'e') then at_text + length(piece) - length(regexp_extract(piece, '[^e]*$')) end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as last_e from w),
s as (select w.doc_id, cell, run, at_text - coalesce(last_e, 0) as first_offset, unnest(q) as part, generate_subscripts(q, 1) - 1 as j from (select *, regexp_extract_all(piece, '[^e]*e|[^e]+') as q from w where not regexp_matches(piece, '^\\s')) w join e on e.doc_id = w.doc_id and e.i = w.i)
select doc_id, cell::bigint as cell, (run + j)::bigint as run, case when j = 0 then first_offset else 0 end::bigint as "offset", length(part)::bigint as length from s""")
def cell_runs(t: Tables) -> DataFrame:
    """Words as cells, and runs that end at each e."""
    rows = t.documents.select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("cells"), F.split(F.coalesce("text", F.lit("")), r"(?<=e)").alias("runs"))
    return assign.cells_to_runs(rows, "doc_id")


@query()
def column_major_tables(t: Tables) -> DataFrame:
    """Order-dependent, so without SQL; tested against a plain loop."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.expr("transform(sequence(1, int(l_quantity % 4) + 1), i -> concat(l_linenumber, '.', i))").alias("r"), F.expr("array(0, int(l_partkey % 3), int(l_suppkey % 3))").alias("m"))
    whole = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "r", "m"))).alias("all"))
    return assign.column_major_tables(whole.select("l_orderkey", F.transform("all", lambda x: x["r"]).alias("rows"), F.transform("all", lambda x: x["m"]).alias("merged")), "l_orderkey")


@query(f"""with p as (select conv_id, turn, t, rows, turn % 5 < 3 as flat, case when conv_id % 3 = 0 then turn % 3 else 0 end as w from {_ROWS_SQL}),
i as (select *, sum(case when flat is distinct from pf then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as tab from (select *, lag(flat) over (partition by conv_id order by turn) as pf from p)),
g as (select conv_id, tab, max(greatest(w, {_HINT_SQL})) as hint, max(coalesce(list_max(list_transform(rows, lambda r: len(r))), 0)) as most, bool_or(len(list_filter(rows, lambda r: len(r) = 2)) > 0) as two, sum(len(list_filter(flatten(rows), lambda x: x like '%:%' or x like '%：%'))) as labels, sum(len(flatten(rows))) as cells from (select *, coalesce(list_max(list_transform(regexp_extract_all(t, '\\x07{{2,}}'), lambda m: length(m))), 0) as n from i where flat) group by all),
c as (select conv_id, tab, case when hint >= 2 then hint when most <= 4 then most when two or labels >= greatest(4, cells - 1) then 2 else most end as n from g),
r as (select i.conv_id, i.tab, turn, n, unnest(rows) as row, generate_subscripts(rows, 1) as ri from i join c on c.conv_id = i.conv_id and c.tab = i.tab where flat and n >= 2),
x as (select conv_id, tab, turn, n, ri, unnest(row) as text, generate_subscripts(row, 1) - 1 as at_cell from r),
y as (select *, dense_rank() over (partition by conv_id, tab order by turn, ri, at_cell // n) - 1 as row_idx, at_cell % n as col_idx from x), e as (select conv_id, tab, n, row_idx, max(col_idx) as m from y group by all)
select conv_id, tab::bigint as "table", row_idx, col_idx::bigint as col_idx, text from y union all select conv_id, tab::bigint, row_idx, k, null from e, lateral (select unnest(range(m + 1, n)) as k)""")
def recovered_cells(t: Tables) -> DataFrame:
    widths = F.expr("if(conv_id % 3 = 0 and turn % 3 > 0, sequence(1, int(turn % 3)), cast(array() as array<int>))")
    rows = _flat(t).withColumn("flat", F.col("turn") % 5 < 3).withColumn("w", widths)
    return tables.recovered_cells(rows, "conv_id", "turn", "flat", "t", "w").withColumn("table", F.col("table").cast("long"))


@query(f"""with b as (select user_id, event_id, event_id % 5 as k, case event_id % 5 when 0 then repeat(chr(7), (event_id % 9)::integer) when 1 then 'a' || chr(7) || 'b' || chr(13) || 'c' || chr(7) || 'd' || chr(13) || 'end' when 2 then 'x' || chr(7) || chr(7) || 'y' || chr(7) || chr(7) || chr(7) || 'z' when 3 then 'only' else 'p' || chr(7) || 'q' end as t from events)
select event_id, case k when 0 then case when event_id % 9 >= 2 then list_transform(case when n % c > 0 and n >= c then [n % c] when n < c then [n] else [] end || list_transform(range(0, n // c), lambda i: c), lambda r: list_transform(range(0, r), lambda j: '')) end when 1 then [['a', 'b'], ['c', 'd']] when 2 then [['x', ''], ['y', ''], ['z', '']] when 3 then null else [['p', 'q']] end as rows, case when k = 1 then 'end' end as trailing
from (select *, (event_id % 9)::integer as n, case when event_id % 9 = 6 or (event_id % 9 % 3 = 0 and event_id % 9 >= 6) then 3 when event_id % 9 % 2 = 0 then 2 else least(3, event_id % 9) end::integer as c from b) where not (k = 0 and (event_id % 9 in (2, 3) or n <= 1))""")
def compact_rows(t: Tables) -> DataFrame:
    """Paragraphs of marks, of rows with a trailing one, of single cells, and of none."""
    own = F.expr("case event_id % 5 when 0 then repeat(char(7), int(event_id % 9)) when 1 then concat('a', char(7), 'b', char(13), 'c', char(7), 'd', char(13), 'end') when 2 then concat('x', repeat(char(7), 2), 'y', repeat(char(7), 3), 'z') when 3 then 'only' else concat('p', char(7), 'q') end")
    rows = t.events.filter("not (event_id % 5 = 0 and event_id % 9 <= 3)").select("event_id", own.alias("t"))
    return rows.select("event_id", tables.compact_rows(F.col("t"), F.array().cast("array<int>")).alias("c")).select("event_id", "c.rows", "c.trailing")


@query(f"""with {_PARAS.replace('+ 1 as end_cp', 'as end_cp')}, r as (select user_id, event_id as s, event_id + 2 as e, case when event_id % 4 = 0 then 0 else event_id % 7 * 1000 + 5 end as score, event_id % 3 * 10 as height, event_id % 5 = 0 as header from events where event_type = 'purchase' and event_id % 3 = 0),
i as (select pa.user_id, para_idx, start_cp, end_cp, (select arg_max(s, (score, s)) from r where r.user_id = pa.user_id and s <= end_cp and e > start_cp) as best, (select arg_max(height, s) filter (where height > 0) from r where r.user_id = pa.user_id and s <= end_cp and e > start_cp) as h, (select bool_or(header) from r where r.user_id = pa.user_id and s <= end_cp and e > start_cp) as hd from pa),
n as (select i.*, (select min(s) from r where r.user_id = i.user_id and score > 0 and s > end_cp and s <= end_cp + 64) as nx, (select max(s) from r where r.user_id = i.user_id and e <= start_cp and start_cp - (e - 1) <= 16) as pv from i), c as (select *, coalesce(best, nx, pv) as b from n)
select c.user_id, para_idx, b as best, case when best is not null then h else (select case when height > 0 then height end from r where r.user_id = c.user_id and s = b) end as height, coalesce(case when best is not null then hd else (select header from r where r.user_id = c.user_id and s = b) end, false) as header from c""")
def resolved_rows(t: Tables) -> DataFrame:
    paragraphs = _paragraphs(t)[1].withColumn("end_cp", F.col("end_cp") - 1)
    k = F.col("event_id")
    score = F.when(k % 4 == 0, 0).otherwise(k % 7 * 1000 + 5).cast("long")
    ranges = t.events.filter("event_type = 'purchase' and event_id % 3 = 0").select("user_id", k.alias("start_cp"), (k + 2).alias("end_cp"), score.alias("score"), (k % 3 * 10 + F.lit(0)).alias("height"), (k % 5 == 0).alias("header"), F.lit(False).alias("cant_split"))
    return tables.resolved_rows(paragraphs, ranges, ["user_id"], "para_idx").select("user_id", "para_idx", "best", "height", "header")


@query("""with c as (select o_custkey, (row_number() over w - 1) // 4 as r, (row_number() over w - 1) % 4 as c, case when o_orderkey % 5 = 0 then 2 when o_orderkey % 7 = 0 then 8 else 0 end as g from orders window w as (partition by o_custkey order by o_orderkey)), e as (select o_custkey, r, max(c) as m from c group by all),
a as (select *, false as filler from c union all select o_custkey, r, k, 0, true from e, lateral (select unnest(range(m + 1, 5)) as k)), f as (select *, g = 2 and c > 0 as side, g = 8 and r > 0 as below from a),
h as (select *, sum(case when side then 0 else 1 end) over (partition by o_custkey, r order by c) as ga, sum(case when below then 0 else 1 end) over (partition by o_custkey, c order by r) as gd from f),
s as (select *, count(*) over (partition by o_custkey, r, ga) as cs, count(*) over (partition by o_custkey, c, gd) as rs from h) select o_custkey, r as row_idx, c as col_idx, rs as row_span, cs as col_span, filler from s where not side and not below""")
def finalised_cells(t: Tables) -> DataFrame:
    cells = sequences.chunked(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4).withColumn("columns", F.lit(5))
    cells = cells.withColumn("merges", F.expr("case when o_orderkey % 5 = 0 then 2 when o_orderkey % 7 = 0 then 8 else 0 end"))
    return tables.finalised_cells(cells, "o_custkey", "columns")

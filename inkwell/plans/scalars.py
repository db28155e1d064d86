"""Queries of scalar expressions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fields, formats, text
from inkwell.plans.registry import Tables, query

_CODE = """concat('  ', upper(event_type), ' "arg', user_id, '" \\\\@ "yyyy-MM-dd" \\\\* ', event_type, ' \\\\@ ''MM/dd'' ')"""
_CODE_SQL = """'  ' || upper(event_type) || ' "arg' || user_id || '" \\@ "yyyy-MM-dd" \\* ' || event_type || ' \\@ ''MM/dd'' '"""


@query("""select doc_id, md5(translate(regexp_replace(dirty, '[\\x00-\\x08\\x0A\\x0C-\\x1D\\x1F\\x7F]', '', 'g'), chr(11) || chr(30) || chr(160), chr(10) || '- ')) as cleaned
from (select doc_id, replace(replace(replace(text, ' th', chr(11) || 'th'), ' a', chr(160) || 'a'), ' e', chr(7) || chr(30) || 'e') as dirty from documents)""")
def control_char_clean(t: Tables) -> DataFrame:
    dirty = F.expr("replace(replace(replace(text, ' th', concat(char(11), 'th')), ' a', concat('\\u00a0', 'a')), ' e', concat(char(7), char(30), 'e'))")
    return t.documents.select("doc_id", F.md5(text.clean_controls(dirty)).alias("cleaned"))


@query("""select doc_id, md5(trim(replace(regexp_replace(dirty, '[\\x00-\\x08\\x0E-\\x1F]', '', 'g'), chr(11), chr(10)), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160))) as header,
md5(translate(regexp_replace(dirty, '[\\x01\\x13-\\x15\\x1F]', '', 'g'), chr(11) || chr(7) || chr(30), chr(10) || chr(9) || '-')) as textbox
from (select doc_id, replace(replace(replace(text, ' th', chr(11) || 'th'), ' a', chr(7) || 'a'), ' e', chr(19) || chr(30) || 'e') || '  ' as dirty from documents)""")
def story_text_clean(t: Tables) -> DataFrame:
    dirty = F.expr("concat(replace(replace(replace(text, ' th', concat(char(11), 'th')), ' a', concat(char(7), 'a')), ' e', concat(char(19), char(30), 'e')), '  ')")
    return t.documents.select("doc_id", F.md5(text.clean_header(dirty)).alias("header"), F.md5(text.clean_textbox(dirty)).alias("textbox"))


@query("""select doc_id, md5(regexp_replace(replace(dirty, chr(65533), ' '), '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) as cleaned
from (select doc_id, replace(replace(text, ' the', chr(65533) || 'the'), ' of', chr(2) || chr(11) || 'of') as dirty from documents)""")
def xml_sanitize(t: Tables) -> DataFrame:
    dirty = F.expr("replace(replace(text, ' the', concat('\\ufffd', 'the')), ' of', concat(char(2), char(11), 'of'))")
    return t.documents.select("doc_id", F.md5(text.xml_safe(dirty)).alias("cleaned"))


@query("""select doc_id, cast(-50 * (length(s) - length(regexp_replace(s, '\\x{FFFD}', '', 'g'))) + 6 * (length(s) - length(regexp_replace(s, '[\\x{4E00}-\\x{9FFF}]', '', 'g')))
 + 2 * (length(s) - length(regexp_replace(s, '[\\p{L}\\p{Nd} \\t\\r\\n]', '', 'g')) - (length(s) - length(regexp_replace(s, '[\\x{4E00}-\\x{9FFF}]', '', 'g'))))
 + (length(s) - length(regexp_replace(s, '[^\\p{L}\\p{Nd}\\p{Cc} \\x{FFFD}]', '', 'g'))) as integer) as quality
from (select doc_id, replace(replace(text, 'the', chr(20013) || chr(25991)), 'de', chr(65533)) as s from documents)""")
def decode_quality(t: Tables) -> DataFrame:
    marked = F.expr("replace(replace(text, 'the', '\\u4e2d\\u6587'), 'de', '\\ufffd')")
    return t.documents.select("doc_id", text.decode_quality(marked).cast("int").alias("quality"))


@query("""select doc_id, regexp_matches(s, '[A-Za-z0-9]') as latin, regexp_matches(s, '[\\x{4E00}-\\x{9FFF}]') as cjk, regexp_matches(s, '[\\x{AC00}-\\x{D7AF}]') as hangul,
regexp_matches(s, '[^\\s\\p{P}A-Za-z0-9\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]') as other,
length(regexp_replace(s, '\\s+', '', 'g')) between 1 and 256 and not (not regexp_matches(s, '[A-Za-z0-9]') and regexp_matches(s, '[\\x{4E00}-\\x{9FFF}]') and regexp_matches(s, '[\\x{AC00}-\\x{D7AF}]')) as usable
from (select doc_id, case when doc_id % 7 = 0 then chr(20013) || chr(44032) else text end as s from documents)""")
def script_classes(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.expr("case when doc_id % 7 = 0 then '\\u4e2d\\uac00' else text end").alias("s"))
    s = text.scripts(F.col("s"))
    return rows.select("doc_id", s["latin"].alias("latin"), s["cjk"].alias("cjk"), s["hangul"].alias("hangul"), s["other"].alias("other"), text.usable(F.col("s")).alias("usable"))


@query("""select doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) as key, cast(length(regexp_replace(text, '\\s+', '', 'g')) as integer) as visible from documents""")
def comparison_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.comparison_key(F.col("text"))).alias("key"), text.visible(F.col("text")).alias("visible"))


@query("""select doc_id, cast(len(regexp_extract_all(s, '[^\\t\\n\\x0B\\f]+|[\\t\\n\\x0B\\f]')) as integer) as n_tokens, cast(len(list_filter(regexp_extract_all(s, '[^\\t\\n\\x0B\\f]+|[\\t\\n\\x0B\\f]'), lambda x: x = chr(9))) as integer) as n_tabs
from (select doc_id, replace(text, ', ', chr(9)) as s from documents)""")
def run_text_tokens(t: Tables) -> DataFrame:
    found = text.tokens(F.replace("text", F.lit(", "), F.lit("\t")))
    return t.documents.select("doc_id", found.alias("k")).select("doc_id", F.size("k").alias("n_tokens"), F.size(F.filter("k", lambda x: x == "\t")).alias("n_tabs"))


@query("""select p_partkey, replace(replace(replace(s, chr(1), '%2'), chr(2), '%3'), chr(8), '%9') as level_text from (select p_partkey, chr(1) || '.' || chr(2) || '-' || p_name || chr(8) as s from part)""")
def level_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.level_text(F.expr("concat(char(1), '.', char(2), '-', p_name, char(8))")).alias("level_text"))


@query("""select doc_id, cast(length(s) + (doc_id % 3) as integer) as units from (select doc_id, text || repeat(chr(128512), (doc_id % 3)::integer) as s from documents)""")
def utf16_units(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.utf16_length(F.expr("concat(text, repeat('\\U0001F600', int(doc_id % 3)))")).alias("units"))


@query("""select doc_id, 2 * (length(s) - length(replace(s, '#', ''))) > length(s) or length(s) = 0 as garbled from (select doc_id, case doc_id % 4 when 0 then '' when 1 then '##' || substr(text, 1, 3) when 2 then '###' || substr(text, 1, 1) else text end as s from documents)""")
def garbled_text(t: Tables) -> DataFrame:
    s = F.expr("case doc_id % 4 when 0 then '' when 1 then concat('##', substr(text, 1, 3)) when 2 then concat('###', substr(text, 1, 1)) else text end")
    return t.documents.select("doc_id", text.garbled(F.regexp_replace(s, "#", "\x00")).alias("garbled"))


@query(f"""select event_id, upper(regexp_extract(trim(code), '^(\\w+)', 1)) as name, regexp_extract(trim(code), '^(\\w+)\\s*(.*)$', 2) as arguments from (select event_id, {_CODE_SQL} as code from events)""")
def field_parse(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.expr(_CODE).alias("code"))
    return rows.select("event_id", fields.field_name(F.col("code")).alias("name"), fields.field_arguments(F.col("code")).alias("arguments"))


@query("""select event_id, 'MM/dd' as date_format, event_type as general from events""")
def field_switches(t: Tables) -> DataFrame:
    found = fields.switches(fields.field_arguments(F.expr(_CODE)))
    return t.events.select("event_id", found.alias("m")).select("event_id", F.try_element_at("m", F.lit("@")).alias("date_format"), F.try_element_at("m", F.lit("*")).alias("general"))


@query("""select event_id, case event_id % 6 when 0 then 'PageNumber' when 1 then 'Hyperlink' when 2 then 'TableOfContents' when 3 then 'Formula' when 4 then 'UserName' else 'Unknown' end as field_type from events""")
def field_types(t: Tables) -> DataFrame:
    name = F.expr("element_at(array('page', 'HYPERLINK', 'Toc', 'EQ', 'USERNAME', 'nothing'), cast(event_id % 6 as int) + 1)")
    return t.events.select("event_id", fields.field_type(name).alias("field_type"))


@query("""select event_id, case event_id % 3 when 0 then 'r' || user_id when 1 then chr(19) || event_type || chr(20) || 'r' else event_type end as result, event_id % 3 < 2 as has_fields from events""")
def field_results(t: Tables) -> DataFrame:
    s = F.expr("case event_id % 3 when 0 then concat(char(19), event_type, char(20), 'r', user_id, char(21), 'x') when 1 then concat(char(19), event_type, char(20), 'r') else event_type end")
    return t.events.select("event_id", fields.field_result(s).alias("result"), fields.has_fields(s).alias("has_fields"))


@query("""select page_id, case page_id % 4 when 0 then split_part(url, '#', 1) when 1 then '' when 2 then split_part(url, '#', 1) else '' end as url,
case page_id % 4 when 0 then 'b' || page_id when 1 then 'b' || page_id when 2 then case when instr(url, '#') > 0 then substr(url, instr(url, '#') + 1) end else 'only' end as bookmark,
page_id % 4 in (0, 2) as external from pages""")
def hyperlink_parse(t: Tables) -> DataFrame:
    code = F.expr("""case page_id % 4 when 0 then concat(' HYPERLINK "', url, '" \\\\l "b', page_id, '"') when 1 then concat('hyperlink \\\\l "b', page_id, '" ')
        when 2 then concat('HYPERLINK ', url) else 'HYPERLINK "#only"' end""")
    made = fields.hyperlink(code)
    return t.pages.select("page_id", made.alias("h")).select("page_id", "h.url", "h.bookmark", "h.external")


_PLACES = "case page_id % 4 when 0 then url when 1 then url || '#sec1' when 2 then split_part(url, '#', 1) || '#' else '#a#b' end"


@query(f"""select page_id, split_part(u, '#', 1) as target, case when instr(u, '#') = 1 or (instr(u, '#') > 0 and instr(u, '#') < length(u)) then substr(u, instr(u, '#') + 1) end as bookmark,
regexp_matches(split_part(u, '#', 1), '^((https?|ftp|file)://|mailto:)') as external from (select page_id, {_PLACES} as u from pages)""")
def link_normalize(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.expr(_PLACES).alias("u"))
    u = F.col("u")
    return rows.select("page_id", fields.target_url(u).alias("target"), fields.target_bookmark(u).alias("bookmark"), fields.is_external(fields.target_url(u)).alias("external"))


@query("""select page_id, unnest(regexp_extract_all('see ' || url || ' and <' || url || '>', '(https?://|ftp://|mailto:)[^\\s<>"]+')) as url from pages""")
def url_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(fields.urls(F.expr("concat('see ', url, ' and <', url, '>')"))).alias("url"))


@query("""select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages""")
def href_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("""select page_id, case page_id % 3 when 0 then 'go there' when 1 then 'open' else null end as shown, case page_id % 3 when 0 then 'go there' when 1 then 'open HYPERLINK "' || url else ' ' end as stripped from pages""")
def link_text(t: Tables) -> DataFrame:
    s = F.expr("""case page_id % 3 when 0 then concat('go HYPERLINK "', url, '" there') when 1 then concat('open HYPERLINK "', url) else concat(' HYPERLINK "', url, '"') end""")
    rows = t.pages.select("page_id", s.alias("s"))
    return rows.select("page_id", fields.link_text(F.col("s")).alias("shown"), fields.without_link_codes(F.col("s")).alias("stripped"))


@query("""select o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') as shown from orders""")
def date_pictures(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.expr("date_format(o_orderdate, 'dd/MM/yyyy HH:mm')").alias("shown"))


_WORD = "(event_id * 7919 + 13) % 536870912"


@query(f"""select event_id, case when w <> 0 then make_timestamp(y, m, least(greatest(d, 1), day(last_day(make_date(y, m, 1)))), h, mi, 0) end as at from (
select event_id, w, least(2100, 1900 + ((w >> 20) & 511)) as y, greatest(1, least(12, (w >> 16) & 15)) as m, (w >> 11) & 31 as d, least(23, (w >> 6) & 31) as h, least(59, w & 63) as mi from (select event_id, {_WORD} as w from events))""")
def decode_dttm(t: Tables) -> DataFrame:
    return t.events.select("event_id", formats.dttm(F.expr(_WORD)).alias("at"))


_COLOUR = "case when l_partkey % 5 = 0 then l_partkey % 17 when l_partkey % 5 = 1 then 16777216 + l_partkey % 12 else (l_partkey * 7919) % 16777216 end"


@query(f"""select l_orderkey, l_linenumber, case when c = 0 or (c & 16777216) <> 0 then 'auto'
when c <= 16 then ['000000', '0000FF', '00FFFF', '00FF00', 'FF00FF', 'FF0000', 'FFFF00', 'FFFFFF', '00008B', '008B8B', '006400', '8B008B', '8B0000', '808000', 'A9A9A9', 'D3D3D3'][c::integer]
else printf('%02X%02X%02X', c & 255, (c >> 8) & 255, (c >> 16) & 255) end as colour from (select l_orderkey, l_linenumber, {_COLOUR} as c from lineitem)""")
def color_hex(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", formats.colour_hex(F.expr(_COLOUR)).alias("colour"))


@query(f"""select l_orderkey, l_linenumber, case when (c & 16777216) <> 0 then ['dark1', 'light1', 'dark2', 'light2', 'accent1', 'accent2', 'accent3', 'accent4', 'accent5', 'accent6', 'hyperlink', 'followedHyperlink'][(c & 255)::integer + 1] end as theme
from (select l_orderkey, l_linenumber, {_COLOUR} as c from lineitem)""")
def theme_colors(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", formats.theme_name(F.expr(_COLOUR)).alias("theme"))


@query("""select l_orderkey, l_linenumber, case when l_partkey % 2 = 0 then (l_partkey - 1000) * 1.0 else (l_partkey - 1000) / 100.0 end as value from lineitem""")
def decode_rk_int(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", formats.rk_int(F.expr("cast((l_partkey - 1000) * 4 + 2 + l_partkey % 2 as int)")).alias("value"))


@query("""select p_partkey, case p_size when 1 then 'UpperRoman' when 2 then 'LowerRoman' when 3 then 'UpperLetter' when 4 then 'LowerLetter' when 5 then 'OrdinalNumber' when 6 then 'CardinalText' when 7 then 'OrdinalText' when 10 then 'DecimalFullWidth' when 11 then 'DecimalHalfWidth' when 12 then 'JapaneseCounting' when 14 then 'DecimalEnclosedCircle' when 22 then 'DecimalZero' when 23 then 'Bullet' when 30 then 'TaiwaneseCountingThousand' when 31 then 'TaiwaneseDigital' when 33 then 'ChineseCounting' when 34 then 'ChineseCountingThousand' when 35 then 'KoreanDigital' when 38 then 'KoreanCounting' when 39 then 'Hebrew1' when 41 then 'ArabicAlpha' when 45 then 'Hebrew2' when 46 then 'ArabicAbjad' when 47 then 'HindiVowels'
else case when p_partkey % 2 = 0 and p_partkey % 9 = 0 then 'Bullet' else 'Decimal' end end as format from part""")
def number_formats(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", formats.number_format(F.col("p_size"), F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 9).alias("format"))


@query("""select p_partkey, case when c = 65535 then 'nil' when c <= 25 then ['clear', 'solid', 'pct5', 'pct10', 'pct20', 'pct25', 'pct30', 'pct40', 'pct50', 'pct60', 'pct70', 'pct75', 'pct80', 'pct90', 'horzStripe', 'vertStripe', 'reverseDiagStripe', 'diagStripe', 'horzCross', 'diagCross', 'thinHorzStripe', 'thinVertStripe', 'thinReverseDiagStripe', 'thinDiagStripe', 'thinHorzCross', 'thinDiagCross'][c + 1]
else case c when 37 then 'pct12' when 38 then 'pct15' when 43 then 'pct35' when 44 then 'pct37' when 46 then 'pct45' when 49 then 'pct55' when 51 then 'pct62' when 52 then 'pct65' when 57 then 'pct85' when 60 then 'pct95' else 'clear' end end as some from (select p_partkey, case when p_partkey % 66 = 65 then 65535 else p_partkey % 66 end as c from part)""")
def shading_patterns(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", formats.shading(F.expr("if(p_partkey % 66 = 65, 65535L, p_partkey % 66)")).alias("some"))


@query("""select p_partkey, case p_size when 0 then 'none' when 1 then 'black' when 2 then 'blue' when 3 then 'cyan' when 4 then 'green' when 5 then 'magenta' when 6 then 'red' when 7 then 'yellow' when 8 then 'white' when 9 then 'darkBlue' when 10 then 'darkCyan' when 11 then 'darkGreen' when 12 then 'darkMagenta' when 13 then 'darkRed' when 14 then 'darkYellow' when 15 then 'darkGray' when 16 then 'lightGray' else 'none' end as highlight from part""")
def highlight_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", formats.highlight(F.col("p_size")).alias("highlight"))


@query("""select l_orderkey, l_linenumber, cast(floor(abs(i) * case when s > 0 then s else 24 end * 10 / 100.0 + 0.5) as integer) as twips,
case when i = 0 then 7 else greatest(-20, least(30, i)) end as clamped, cast(case when i < 0 then -1 else 1 end * ((abs(i) * 103 + 128) // 256) as integer) as hundredths, cast((s * 240 + 50) // 100 as integer) as lines
from (select l_orderkey, l_linenumber, cast(l_partkey % 101 - 50 as integer) as i, l_linenumber * 3 - 3 as s from lineitem)""")
def unit_conversions(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.expr("cast(l_partkey % 101 - 50 as int)").alias("i"), F.expr("l_linenumber * 3 - 3").alias("s"))
    i, s = F.col("i"), F.col("s")
    return rows.select("l_orderkey", "l_linenumber", formats.character_indent_twips(i, s).alias("twips"), formats.clamped_twips(i, -20, 30, 7).alias("clamped"), formats.legacy_indent_hundredths(i).alias("hundredths"), formats.line_hundredths_twips(s).alias("lines"))


@query("""select l_orderkey, l_linenumber, w & 255 as width, (w >> 8) & 255 as style, (w >> 24) & 31 as space from (select l_orderkey, l_linenumber, (l_partkey * 1103515245) % 4294967296 as w from lineitem)""")
def border_words(t: Tables) -> DataFrame:
    made = formats.border(F.expr("(l_partkey * 1103515245) % 4294967296"), F.lit(0))
    return t.lineitem.select("l_orderkey", "l_linenumber", *[made[k].alias(k) for k in ("width", "style", "space")])


@query("""select p_partkey, case when p_size % 12 = 0 then 'Normal' when p_size % 12 <= 9 then 'Heading' || (p_size % 12) when p_partkey % 5 = 0 then 'Title' when p_partkey % 5 = 1 then 'Heading3' when p_partkey % 5 = 2 then 'ListParagraph' when p_partkey % 5 = 3 then replace(p_name, ' ', '') else 'Style' || (p_size % 12) end as style_id from part""")
def style_ids(t: Tables) -> DataFrame:
    name = F.expr("case p_partkey % 5 when 0 then 'TITLE' when 1 then 'Heading 3' when 2 then 'list paragraph' when 3 then p_name end")
    return t.part.select("p_partkey", formats.style_id(F.col("p_size") % 12, name).alias("style_id"))


@query("""select page_id, case when page_id % 2 = 0 then 'media/' || p else 'word/media/' || p end as target from (select page_id, 'p' || page_id as p from pages)""")
def resolve_target(t: Tables) -> DataFrame:
    relative = F.expr("concat(if(page_id % 2 = 0, '../', './x/../'), 'media/p', page_id)")
    return t.pages.select("page_id", formats.resolved_target(F.lit("word"), relative).alias("target"))


@query("""select event_id, case when event_id % 3 = 0 then event_id::integer end as number from events""")
def relationship_numbers(t: Tables) -> DataFrame:
    return t.events.select("event_id", formats.relationship_number(F.expr("case event_id % 3 when 0 then concat('rId', event_id) when 1 then 'rIdx' else 'x7' end")).alias("number"))


@query("""select doc_id, case when starts_with(hex(encode(text)), '504B0304') then 'docx' when starts_with(hex(encode(text)), 'D0CF11E0A1B11AE1') then 'doc' when source like '%.docx' then 'docx' when source like '%.doc' then 'doc' else 'unknown' end as kind from documents""")
def input_kind(t: Tables) -> DataFrame:
    from inkwell.sources.containers import input_kind as kind

    return t.documents.select("doc_id", kind(F.col("text").cast("binary"), F.col("source")).alias("kind"))

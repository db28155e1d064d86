"""Queries of what word files hold beside text: files are packed from rows by plans.fixtures, then decoded."""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import formats, text
from inkwell.operators import stories as story_rules
from inkwell.plans import fixtures as fx
from inkwell.plans.registry import Tables, query
from inkwell.sources import word


def _decoded(rows: DataFrame, key: str, make: Callable[[list], bytes], *only: str) -> DataFrame:
    """The relations (only those named, if any are) of one file per key, packed from its rows (a struct column named all, sorted)."""
    return word.decode(rows, key, "all", only=only or None, make=lambda some: make([tuple(x.values()) for x in some]))


def _gathered(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("all"))


#: Styles and lists of one packed file. Numbers of styles have twelve bits, of which the last is none; a multiple of three.
MOST_STYLES, MOST_LISTS = 3000, 1000


def _parted(gathered: DataFrame, key: str, most: int, before: int = 0) -> DataFrame:
    """Rows of _gathered(), parted into ones of at most so many, each with so many before them: the key is then of the key and first, the number of its first row."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(most))
    parts = gathered.select(key, "all", F.explode(starts).alias("at")).withColumn("first", F.greatest(F.col("at") - before, F.lit(0)))
    files = parts.select(F.struct(key, "first").alias("key"), F.slice("all", F.col("first") + 1, F.col("at") - F.col("first") + most).alias("all"))
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")  # few bytes make much work: not to be put together by size


def _of(values: str, name: str):
    return F.try_element_at(F.col(values), F.lit(name))


def _sheet_file(rows: list) -> bytes:
    entries = []
    for k, (_, size, name) in enumerate(rows):
        chpx = fx.modifier(0x4A43, struct.pack("<H", size)) + (fx.modifier(0x0835, b"\1") if size % 2 else b"")
        papx = struct.pack("<H", k) + fx.modifier(0x2403, bytes([size % 4]))
        entries.append(fx.style(100, 2, 0xFFF, name, [chpx]) if k % 3 == 2 else fx.style(100, 1, k - 1 if k else 0xFFF, name, [papx, chpx]))
    return fx.document("x", {fx.STYLES: fx.sheet(entries)})


@query("""select * replace (size::bigint as size, justify::bigint as justify) from (with p as (select p_brand, p_size, p_name, row_number() over (partition by p_brand order by p_partkey, p_size, p_name) - 1 as i from part)
select p_brand, i as style_id, case when i % 3 = 2 then 'character' else 'paragraph' end as kind, p_name as name, case when i > 0 and i % 3 < 2 then i - 1 end as based_on, p_size as size, p_size % 2 = 1 as bold, case when i % 3 < 2 then p_size % 4 end as justify from p)""")
def word_styles(t: Tables) -> DataFrame:
    """Styles of as many files as their number needs: all but the first begin with the last three of the file before, as a style may be based on one of these."""
    rows = _parted(_gathered(t.part, "p_brand", "p_partkey", "p_size", "p_name"), "p_brand", MOST_STYLES, 3)
    made = _decoded(rows, "key", _sheet_file, "styles").select("key.p_brand", "key.first", F.explode("styles").alias("s")).select("p_brand", "first", "s.*")
    made = made.filter("first = 0 or style_id >= 3").withColumn("style_id", F.col("style_id") + F.col("first")).withColumn("based_on", F.col("based_on") + F.col("first"))
    return made.select("p_brand", "style_id", "kind", "name", "based_on", _of("character", "size").alias("size"), (F.coalesce(_of("character", "bold"), F.lit(0)) == 1).alias("bold"), _of("paragraph", "justify").alias("justify"))


def _formatted_file(rows: list) -> bytes:
    """Text of seven characters a row, with runs and paragraphs of its own, ten to a page."""
    body, pages = "abcdef\r" * len(rows), {fx.CHARACTERS: [], fx.PARAGRAPHS: []}
    for at in range(0, len(rows), 10):
        some = rows[at : at + 10]
        fcs = [1024 + 14 * k for k in range(at, at + len(some) + 1)]
        chpx = [fx.modifier(0x4A43, struct.pack("<H", k % 200)) + (fx.modifier(0x0836, b"\1") if k % 3 == 0 else b"") for k, _ in some]
        papx = [struct.pack("<H", k % 30) + fx.modifier(0x840F, struct.pack("<h", k % 500 - 250)) + (fx.modifier(0x2416, b"\1") + fx.modifier(0x9407, struct.pack("<h", k % 300 + 1)) if k % 4 == 0 else b"") for k, _ in some]
        pages[fx.CHARACTERS].append(fx.page(fcs, chpx, False))
        pages[fx.PARAGRAPHS].append(fx.page(fcs, papx, True))
    return fx.document(body, {}, pages)


_ORDERS_SQL = "(select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders)"


@query(f"""select * replace (italic::bigint as italic) from (select o_custkey, i * 7 as cp_start, i * 7 + 7 as cp_end, o_orderkey % 200 as size, case when o_orderkey % 3 = 0 then 1 end as italic from {_ORDERS_SQL})""")
def word_runs(t: Tables) -> DataFrame:
    made = _decoded(_gathered(t.orders, "o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", _formatted_file)
    return made.select("o_custkey", F.explode("runs").alias("r")).select("o_custkey", "r.cp_start", "r.cp_end", _of("r.properties", "size").alias("size"), _of("r.properties", "italic").alias("italic"))


@query(f"""select o_custkey, i * 7 as cp_start, i * 7 + 7 as cp_end, o_orderkey % 30 as style, o_orderkey % 500 - 250 as "left", case when o_orderkey % 4 = 0 then 'TableCell' else 'Normal' end as kind, case when o_orderkey % 4 = 0 then o_orderkey % 300 + 1 end as height from {_ORDERS_SQL}""")
def word_paragraphs(t: Tables) -> DataFrame:
    made = _decoded(_gathered(t.orders, "o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", _formatted_file)
    rows = made.select("o_custkey", F.explode("paragraphs").alias("p")).select("o_custkey", "p.*")
    kind = text.paragraph_type(F.lit("abcdef"), _of("properties", "in_table") == 1, _of("properties", "nesting"))
    return rows.select("o_custkey", "cp_start", "cp_end", "style", _of("properties", "left").alias("left"), kind.alias("kind"), _of("row", "height").alias("height"))


def _table_file(rows: list) -> bytes:
    """A row of a table for each row: its cells' widths by way of boundaries, the first merged sideways where the number is even."""
    body, pages = "ab\x07\x07\r" * len(rows), []
    for at in range(0, len(rows), 4):
        some = rows[at : at + 4]
        bodies = []
        for k, n in some:
            bounds = [sum(100 * (j + 1) + k % 50 for j in range(i)) for i in range(n + 1)]
            cells = b"".join(struct.pack("<H", (1 if j == 0 else 2) if k % 2 == 0 and j < 2 else 0) + bytes(18) for j in range(n))
            bodies.append(b"\0\0" + fx.modifier(0xD608, bytes([n]) + struct.pack(f"<{n + 1}h", *bounds) + cells))
        pages.append(fx.page([1024 + 10 * j for j in range(at, at + len(some) + 1)], bodies, True))
    return fx.document(body, {}, {fx.PARAGRAPHS: pages})


@query(f"""select * replace ("row"::integer as "row", merges::bigint[] as merges) from (select o_custkey, i as row, list_transform(range(0, o_orderkey % 3 + 2), lambda j: 100 * (j + 1) + o_orderkey % 50) as widths, list_transform(range(0, o_orderkey % 3 + 2), lambda j: case when o_orderkey % 2 = 0 and j = 0 then 1 when o_orderkey % 2 = 0 and j = 1 then 2 else 0 end) as merges from {_ORDERS_SQL})""")
def word_tables(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3 + 2).cast("int").alias("n"))
    made = _decoded(_gathered(rows, "o_custkey", "o_orderkey", "n"), "o_custkey", _table_file)
    return made.select("o_custkey", F.posexplode("paragraphs").alias("row", "p")).select("o_custkey", "row", "p.widths", "p.merges")


def _list_file(rows: list) -> bytes:
    known = [(k + 1, 0, [fx.level(size, size % 6, f"({chr(0)})", fx.modifier(0x840F, struct.pack("<h", 10 * size)))]) for k, size in rows]
    over = [(k + 1, [fx.override(0, start=size + 1)] if size % 2 else []) for k, size in rows]
    return fx.document("x", {fx.LISTS: fx.lists(known), fx.OVERRIDES: fx.overrides(over)})


@query("""select * replace (start_at::bigint as start_at) from (select p_brand, p_partkey + 1 as list_id, level::bigint as level, case when level = 0 then ['Decimal', 'UpperRoman', 'LowerRoman', 'UpperLetter', 'LowerLetter', 'OrdinalNumber'][p_size % 6 + 1] else 'Decimal' end as format, case when level = 0 then '(%1)' else '%' || (level + 1) end as text, case when level = 0 then 10 * p_size else 720 * (level + 1) end as indent, case when level = 0 and p_size % 2 = 1 then p_size + 1 end as start_at from part, range(0, 9) r(level))""")
def word_lists(t: Tables) -> DataFrame:
    """Levels of lists, of as many files as their number needs, with the starts that overrides give them."""
    rows = _parted(_gathered(t.part, "p_brand", "p_partkey", "p_size"), "p_brand", MOST_LISTS)
    made = _decoded(rows, "key", _list_file, "lists", "overrides").select("key.p_brand", "lists", "overrides")
    levels = made.select("p_brand", F.explode("lists").alias("l")).select("p_brand", "l.list_id", F.explode("l.levels").alias("v")).select("p_brand", "list_id", "v.level", "v.format", "v.text", "v.indent")
    over = made.select("p_brand", F.explode("overrides").alias("o")).select("p_brand", "o.list_id", F.explode("o.levels").alias("v")).select("p_brand", "list_id", "v.level", "v.start_at")
    return levels.join(over, ["p_brand", "list_id", "level"], "left")


def _section_file(rows: list) -> bytes:
    body, grpprls = "abc\r" * len(rows), [fx.modifier(0xB00F, struct.pack("<h", 8000 + k % 9000)) + fx.modifier(0xB017, struct.pack("<h", 100)) for k, _ in rows]
    at, tail, seds = fx.tail_place(body), b"", []
    for g in grpprls:
        seds.append(struct.pack("<HI6s", 0, at + len(tail), bytes(6)))
        tail += struct.pack("<H", len(g)) + g
    flags = struct.pack("<HH", 0x0008 if rows[0][0] % 2 else 0, 0) + bytes(20)
    return fx.document(body, {fx.SECTIONS: fx.positions([4 * k for k in range(len(rows) + 1)], seds), fx.FLAGS: flags}, tail=tail)


@query(f"""select * replace (gutter::bigint as gutter) from (select o_custkey, i as section, i * 4 as start_cp, i * 4 + 4 as end_cp, 8000 + o_orderkey % 9000 as page_width, 8000 + o_orderkey % 9000 > 16838 as landscape, case when min(o_orderkey) over (partition by o_custkey) % 2 = 1 then 100 else 0 end as gutter from {_ORDERS_SQL})""")
def word_sections(t: Tables) -> DataFrame:
    made = _decoded(_gathered(t.orders, "o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", _section_file)
    rows = made.select("o_custkey", "flags", F.explode("sections").alias("s")).select("o_custkey", "flags", "s.*")
    set_flag = lambda name: F.coalesce(_of("flags", name), F.lit(0)) == 1
    page = story_rules.section_page(F.col("properties"), set_flag("mirror_margins"), set_flag("facing_pages"))
    return rows.select("o_custkey", "section", "start_cp", "end_cp", page.alias("p")).select("o_custkey", "section", "start_cp", "end_cp", "p.page_width", "p.landscape", "p.gutter")


def _remark_file(rows: list) -> bytes:
    """A footnote and a comment of a few characters for each row, of two authors."""
    body, notes, remarks = "x" * len(rows), "".join(f"n{k}\r" for k, _ in rows) + "\r", "".join(f"c{k}\r" for k, _ in rows)
    note_cps, remark_cps = [0], [0]
    for k, _ in rows:
        note_cps.append(note_cps[-1] + len(str(k)) + 2)
        remark_cps.append(remark_cps[-1] + len(str(k)) + 2)
    n = len(rows)
    refs = [struct.pack("<hhhIh18s", 0, 0, 0, k % 60 | 5 << 6 | 7 << 11 | 3 << 16 | 124 << 20, k % 3, bytes(18)) for k, _ in rows]
    tables = {
        fx.NOTE_TEXTS: fx.positions(note_cps, [b"\1\0"] * n), fx.COMMENT_REFS: fx.positions([*range(n), n], refs), fx.COMMENT_TEXTS: fx.positions(remark_cps), fx.AUTHORS: fx.xst("Ann") + fx.xst("Bob"),
        fx.COMMENT_ENDS: fx.positions([k + 1 for k in range(n)] + [n], [struct.pack("<h", k) for k in range(n)]),
    }
    return fx.document(body, tables, stories={4: notes, 7: remarks})


@query(f"select o_custkey, i + 1 as idx, 'n' || o_orderkey || chr(13) as text from {_ORDERS_SQL}")
def word_notes(t: Tables) -> DataFrame:
    made = _decoded(_gathered(t.orders, "o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", _remark_file)
    story = F.element_at(F.filter("stories", lambda s: s["story"] == "footnote"), 1)["text"]
    rows = made.select("o_custkey", story.alias("story"), F.explode("notes").alias("n"))
    own = F.substr("story", F.col("n.cp").cast("int") + 1, F.col("n.size").cast("int"))
    return rows.select("o_custkey", "n.idx", story_rules.note_text(own, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("text"))


@query(f"select o_custkey, i as idx, i as start_cp, i + 1 as end_cp, ['Ann', 'Bob', 'Unknown'][o_orderkey % 3 + 1] as author, timestamp '2024-03-07 05:00:00' + to_minutes(o_orderkey % 60) as at, 'c' || o_orderkey as text from {_ORDERS_SQL}")
def word_comments(t: Tables) -> DataFrame:
    made = _decoded(_gathered(t.orders, "o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", _remark_file)
    story = F.element_at(F.filter("stories", lambda s: s["story"] == "annotation"), 1)["text"]
    rows = made.select("o_custkey", story.alias("story"), F.explode("comments").alias("c")).select("o_custkey", "story", "c.*")
    own = F.substr("story", F.col("text_cp").cast("int") + 1, F.col("size").cast("int"))
    return rows.select("o_custkey", "idx", "start_cp", "end_cp", "author", formats.dttm(F.col("date")).alias("at"), story_rules.comment_text(own).alias("text"))

"""Table geometry from marks in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import bound

#: Fixed value: the cell mark.
CELL = "\x07"


def mark_columns(text: Column) -> Column:
    """Columns that the longest run of two or more cell marks stands for: its length less one, one at least; 0 without such a run."""
    runs = F.regexp_extract_all(text, F.lit(f"{CELL}{{2,}}"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.greatest(F.lit(1), F.length(r) - 1))), F.lit(0))


def compact_grid(text: Column) -> Column:
    """array<struct<row_idx, col_idx, token>> of a text whose tokens stand in a grid of cell-mark gaps; null if there is no such grid.

    The least gap is the base. A first gap of another length sets off a title, which is left out. Gaps of base length from there
    on make the columns of a row; then every gap moves on by its multiple of the base.
    """
    tokens = F.filter(F.split(text, f"{CELL}+"), lambda t: F.trim(t) != "")
    gaps = F.transform(F.regexp_extract_all(text, F.lit(f"{CELL}+"), F.lit(0)), F.length)

    def parsed(p: Column) -> Column:
        first = F.when(F.element_at(p["gaps"], 1) != p["base"], 1).otherwise(0)
        return bound(F.struct(p["tokens"].alias("tokens"), p["gaps"].alias("gaps"), p["base"].alias("base"), first.alias("first")), laid)

    def laid(p: Column) -> Column:
        inner = F.slice(p["gaps"], p["first"] + 1, F.size(p["gaps"]))
        other = F.filter(F.transform(inner, lambda g, i: F.when(g != p["base"], i)), lambda i: i.isNotNull())
        slots = F.coalesce(F.get(other, F.lit(0)), F.size(inner)) + 1
        steps = F.slice(inner, 1, F.size(p["tokens"]) - p["first"] - 1)
        start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all"))
        move = lambda acc, g: bound((acc["at"] + g / p["base"]).cast("int"), lambda n: F.struct(n.alias("at"), F.concat(acc["all"], F.array(n)).alias("all")))
        places = F.aggregate(steps, start, move, lambda acc: acc["all"])
        even = F.forall(steps, lambda g: g % p["base"] == 0)
        cell = lambda n, s, t: F.struct(F.floor(n / s).cast("int").alias("row_idx"), ((n % s) * p["base"]).cast("int").alias("col_idx"), t.alias("token"))
        kept = F.slice(p["tokens"], p["first"] + 1, F.size(p["tokens"]))
        return F.when((slots >= 2) & even, bound(slots, lambda s: F.zip_with(places, kept, lambda n, t: cell(n, s, t))))

    fit = (F.size(tokens) >= 4) & (F.size(gaps) >= F.size(tokens) - 1) & (F.array_min(gaps) > 1)
    return F.when(fit, bound(F.struct(tokens.alias("tokens"), gaps.alias("gaps"), F.array_min(gaps).alias("base")), parsed))


def marker_rows(markers: Column, columns: Column) -> Column:
    """Lengths of the rows that so many cell marks fill; what doesn't make a full row comes first, if there is more than one row."""
    rest = markers % columns
    full = F.when(markers >= columns, F.array_repeat(columns, F.floor(markers / columns).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when((markers <= 0) | (columns <= 0), F.array().cast("array<int>")).otherwise(F.concat(F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")), full))


def assembled_cells(runs: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, cell, row_idx, text: runs gathered into cells, each closed by its cell mark; a run of nothing but a mark ends the row.

    Running sums count the marks before a run; the cells of a key are then one aggregate.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marks = F.length(text) - F.length(F.replace(F.col(text), F.lit(CELL), F.lit("")))
    ends = (F.col(text) == CELL).cast("int")
    rows = runs.withColumn("cell", F.coalesce(F.sum(marks).over(w), F.lit(0))).withColumn("row_idx", F.coalesce(F.sum(ends).over(w), F.lit(0))).filter(F.col(text) != CELL)
    parts = rows.groupBy(key, "row_idx", "cell").agg(F.sort_array(F.collect_list(F.struct(order, F.replace(F.col(text), F.lit(CELL), F.lit("")).alias("t")))).alias("all"))
    return parts.select(key, "row_idx", "cell", F.array_join(F.transform("all", lambda x: x["t"]), "").alias("text"))


def covered(cells: DataFrame, key: str) -> DataFrame:
    """cells (row_idx, col_idx, row_span) with covered: whether a cell above in the same column spans over it."""
    w = Window.partitionBy(key, "col_idx").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("covered", F.coalesce(F.max(F.col("row_idx") + F.col("row_span")).over(w) > F.col("row_idx"), F.lit(False)))


def placeholder_columns(marks: Column) -> Column:
    """Columns that so many cell marks in a row stand for: three or two if they go into them evenly, else up to three."""
    return F.when((marks == 6) | ((marks % 3 == 0) & (marks >= 6)), F.lit(3)).when(marks % 2 == 0, F.lit(2)).otherwise(F.least(F.lit(3), marks))


def mark_hint(text: Column) -> Column:
    """Columns hinted at by the longest run of two or more cell marks; 0 without one."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"{CELL}{{2,}}"), F.lit(0)), F.length)), F.lit(0))
    return bound(longest, lambda n: F.when(n >= 2, placeholder_columns(n)).otherwise(F.lit(0)))


def row_candidates(text: Column) -> Column:
    """array<array<string>>: the rows of cells that a text may hold. Carriage returns and runs of cell marks part rows, single marks cells;
    blank cells at a row's end go, but for one behind a mark."""
    blank = lambda t: F.rlike(t, F.lit(r"^[\s\x85\xA0]*$"))
    clean = lambda t: F.trim(F.replace(t, F.lit("\r"), F.lit("\n")), F.lit("\r\n\t "))

    def kept(line: Column) -> Column:
        cells = F.transform(F.split(line, CELL), clean)
        ends = F.when(F.endswith(line, F.lit(CELL)), 1).otherwise(0)
        return bound(cells, lambda c: F.slice(c, 1, F.greatest(F.array_max(F.transform(c, lambda t, i: F.when(blank(t), 0).otherwise(i + 1))), ends)))

    return F.filter(F.transform(F.split(text, rf"\r+|{CELL}{{2,}}"), kept), lambda r: F.size(r) > 0)


def estimated_columns(paragraphs: DataFrame, key: str, text: str, widths: str) -> DataFrame:
    """key, columns: the columns of a flat table by its paragraphs' widths and runs of marks, if that makes two or more; else by its rows of cells:
    the longest row's if that is four or less, two if some row has two or nearly all cells are labels, else the longest row's."""
    cells = row_candidates(F.col(text))
    rows = paragraphs.select(key, F.greatest(F.coalesce(F.size(widths), F.lit(0)), mark_hint(F.col(text))).alias("__hint"), cells.alias("__rows"))
    sizes = F.transform("__rows", F.size)
    labels = F.size(F.filter(F.flatten("__rows"), lambda t: F.rlike(t, F.lit("[：:]"))))
    rows = rows.select(key, "__hint", F.coalesce(F.array_max(sizes), F.lit(0)).alias("__most"), F.exists(sizes, lambda n: n == 2).alias("__two"), labels.alias("__labels"), F.size(F.flatten("__rows")).alias("__all"))
    found = rows.groupBy(key).agg(F.max("__hint").alias("hint"), F.max("__most").alias("most"), F.bool_or("__two").alias("two"), F.sum("__labels").alias("labels"), F.sum("__all").alias("cells"))
    by_cells = F.when(F.col("most") <= 4, F.col("most")).when(F.col("two") | (F.col("labels") >= F.greatest(F.lit(4), F.col("cells") - 1)), F.lit(2)).otherwise(F.col("most"))
    return found.select(key, F.when(F.col("hint") >= 2, F.col("hint")).otherwise(by_cells).alias("columns"))


def needs_recovery(estimates: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """key, needed: whether a document's flat paragraphs (key, columns) still need to be made a table: two columns or more, and every table that it
    has (key, row_count, column_count, most_cells) of one row or narrower than that."""
    joined = estimates.join(tables, key, "left")
    narrow = F.col("row_count").isNull() | (F.col("row_count") <= 1) | (F.col("column_count") < F.col("columns")) | (F.col("most_cells") < F.col("columns"))
    return joined.groupBy(key).agg((F.first(F.col("columns") >= 2) & F.bool_and(narrow)).alias("needed"))


def is_white(has_rgb: Column, rgb: Column, colour: Column) -> Column:
    """Whether a run is white: by its own colour, else by that of the palette."""
    return F.when(has_rgb, rgb == 0xFFFFFF).otherwise(colour == 8)


def unshaded_headers(runs: DataFrame, keys: list[str], shaded: Column, text: Column, white: Column) -> DataFrame:
    """keys, needed of rows of tables: whether a row has no shading of its own, some visible run, and nothing but white ones."""
    visible = F.rlike(F.coalesce(text, F.lit("")), F.lit(r"[^\s\x85\xA0]"))
    return runs.groupBy(*keys).agg((~F.bool_or(shaded) & (F.count_if(visible) > 0) & (F.count_if(visible & white) == F.count_if(visible))).alias("needed"))


#: The shading of a header without any sign of colour, with a theme that has a first accent and without.
ACCENT, PLAIN_HEADER = 0x0100_0004, 0x00BD_814F


def header_colours(rows: DataFrame, borders: DataFrame, keys: list[str], accent: Column) -> DataFrame:
    """keys, colour: of rows the colour that most of their borders (keys, colour) have, of equally frequent ones the greatest; else the theme's accent, else a plain one."""
    from inkwell.operators.matching import mode

    found = mode(borders.filter("colour <> 0"), keys, "colour", "__colour")
    return rows.join(found.drop("n"), keys, "left").select(*keys, F.coalesce("__colour", F.when(accent, F.lit(ACCENT)).otherwise(F.lit(PLAIN_HEADER))).alias("colour"))


def table_needs(cells: DataFrame, key: str, explicit: Column, nested: Column, renderable: Column, text: Column) -> DataFrame:
    """key, nested, renderable, empty_cells, needs_borders of tables by their cells: borders are drawn around nested tables, and around content where the
    table says nothing itself or has empty cells."""
    some = cells.groupBy(key).agg(F.bool_or(nested).alias("nested"), F.bool_or(renderable).alias("renderable"), F.bool_or(~(text | renderable | nested)).alias("empty_cells"), F.bool_or(explicit).alias("__explicit"))
    return some.select(key, "nested", "renderable", "empty_cells", (F.col("nested") | (F.col("renderable") & (~F.col("__explicit") | F.col("empty_cells")))).alias("needs_borders"))


def rows_of_single_cells(cells: DataFrame, key: str, order: str, columns: str, lead_span: str) -> DataFrame:
    """key, row_idx, col_idx, span and order (null: an empty cell that fills up the last row): tables whose rows were single cells, laid out anew.

    Only tables of two columns or more with more cells than columns; a first cell that spans them all is a title row by itself. cells:
    all of single-celled rows, with the table's columns and the first cell's span.
    """
    w = Window.partitionBy(key)
    rows = cells.select(key, order, F.col(columns).alias("__c"), F.col(lead_span).alias("__lead"), (F.row_number().over(w.orderBy(order)) - 1).alias("__i"), F.count(F.lit(1)).over(w).alias("__n"))
    rows = rows.filter("__c >= 2 and __n > __c").withColumn("__title", F.when(F.col("__lead") == F.col("__c"), 1).otherwise(0))
    place = F.col("__i") - F.col("__title")
    is_title = place < 0
    row = F.when(is_title, F.lit(0)).otherwise(F.col("__title") + F.floor(place / F.col("__c")))
    laid = rows.select(key, row.cast("long").alias("row_idx"), F.when(is_title, F.lit(0)).otherwise(place % F.col("__c")).cast("long").alias("col_idx"), F.when(is_title, F.col("__c")).otherwise(F.lit(1)).cast("long").alias("span"), order, "__i", "__n", "__c", "__title")
    last = laid.filter(F.col("__i") == F.col("__n") - 1).filter("col_idx + 1 < __c and (__title = 0 or row_idx > 0)")
    filler = last.select(key, "row_idx", F.explode(F.sequence(F.col("col_idx") + 1, (F.col("__c") - 1).cast("long"))).alias("col_idx"), F.lit(1).cast("long").alias("span"), F.lit(None).cast(cells.schema[order].dataType).alias(order))
    return laid.select(key, "row_idx", "col_idx", "span", order).unionByName(filler)


#: Fixed value: the widths of a table of three columns whose last one is empty.
EMPTY_COLUMN_WIDTHS = (1242, 6378, 1621)


def trailing_columns(rows: DataFrame, key: str, text: str, cells: str, flat: str, most_width: str) -> DataFrame:
    """key, columns, widths of tables that get empty columns at their end, by one row per source paragraph: its text, its cells, whether it is flat, its widest cell.

    All paragraphs must be flat, and some end in two marks or more. Columns are those that marks hint at; in a table of single cells also the
    longest run of marks at a text's end. Three columns without widths of their own get fixed ones, if the third is empty throughout.
    """
    tail = F.length(F.regexp_extract(text, f"{CELL}+$", 0))
    found = rows.groupBy(key).agg(F.bool_and(flat).alias("__flat"), F.max(cells).alias("__now"), F.max(mark_hint(F.col(text))).alias("__hint"), F.max(tail).alias("__tail"), F.max(most_width).alias("__width"))
    columns = F.when(F.col("__now") == 1, F.greatest("__hint", "__tail")).otherwise(F.col("__hint"))
    grown = found.withColumn("columns", columns).filter("__flat and columns > __now and __tail >= 2")
    fixed = (F.col("columns") == 3) & (F.col("__now") < 3) & (F.col("__width") == 0)
    return grown.select(key, "columns", F.when(fixed, F.array(*[F.lit(w) for w in EMPTY_COLUMN_WIDTHS])).alias("widths"))


def trailing_paragraphs(rows: DataFrame, key: str, order: str, cells: str, text: str, columns: str) -> DataFrame:
    """rows with trailing: whether it is the last row of a table of several columns, of one cell that isn't blank, behind a full row: a paragraph that follows the table."""
    w = Window.partitionBy(key).orderBy(order)
    last = F.lead(order).over(w).isNull()
    full = F.coalesce(F.lag(cells).over(w) >= F.col(columns), F.lit(False))
    return rows.withColumn("trailing", last & full & (F.col(cells) == 1) & (F.col(columns) > 1) & F.rlike(F.coalesce(text, F.lit("")), F.lit(r"[^\s\x85\xA0]")))


def row_alignments(justifications: Column, rows: Column) -> Column:
    """Alignments of so many rows by the justification at each position of a paragraph: the first, then each change to one that isn't 0, the last one repeated to the end."""
    changes = lambda j: F.filter(j, lambda x, i: (i == 0) | (F.get(j, i - 1) != x))
    kept = bound(justifications, lambda j: bound(changes(j), lambda c: F.slice(F.filter(c, lambda x, i: (i == 0) | (x != 0)), 1, F.greatest(F.lit(2), rows))))
    padded = bound(kept, lambda k: F.concat(k, F.array_repeat(F.element_at(k, -1), F.greatest(F.lit(0), rows - F.size(k)))))
    return F.when((F.size(justifications) > 0) & (rows > 0), padded).otherwise(F.slice(justifications, 1, 0))


def filled_rows(cells: DataFrame, key: str, columns: str) -> DataFrame:
    """cells (key, row_idx, col_idx) with empty ones (filler) up to the table's columns in each row."""
    ends = cells.groupBy(key, "row_idx", columns).agg(F.max("col_idx").alias("__last"))
    missing = ends.filter(F.col("__last") + 1 < F.col(columns)).select(key, "row_idx", F.explode(F.sequence(F.col("__last") + 1, (F.col(columns) - 1).cast("long"))).alias("col_idx"), F.lit(True).alias("filler"))
    return cells.select(key, "row_idx", "col_idx", F.lit(False).alias("filler")).unionByName(missing)


def recovered_cells(paragraphs: DataFrame, key: str, order: str, flat: str, text: str, widths: str) -> DataFrame:
    """key, table, row_idx, col_idx, text (null: filled up): tables made of runs of flat paragraphs, their rows cut to the columns that the run has.

    Runs by islands, columns by estimated_columns(), rows by row_candidates(); a run of fewer than two columns is no table. Row and column are
    running numbers within a run: windows by document and run, no pairs.
    """
    from inkwell.operators.sequences import islands

    rows = islands(paragraphs.select(key, order, F.col(flat).alias("__flat"), F.col(text).alias("__text"), F.col(widths).alias("__widths")), [key], [order], F.col("__flat"), "table").filter("__flat")
    group = rows.withColumn("__g", F.struct(key, "table"))
    columns = estimated_columns(group, "__g", "__text", "__widths").filter("columns >= 2").select(F.col(f"__g.{key}").alias(key), F.col("__g.table").alias("table"), "columns")
    parts = rows.join(columns, [key, "table"]).select(key, "table", "columns", order, F.posexplode(row_candidates(F.col("__text"))).alias("__row", "__cells"))
    cells = parts.select(key, "table", "columns", order, "__row", F.posexplode("__cells").alias("__at", "text"))
    line = [order, "__row", F.floor(F.col("__at") / F.col("columns"))]
    numbered = cells.withColumn("row_idx", F.dense_rank().over(Window.partitionBy(key, "table").orderBy(*line)).cast("long") - 1).withColumn("col_idx", (F.col("__at") % F.col("columns")).cast("long"))
    ends = numbered.groupBy(key, "table", "columns", "row_idx").agg(F.max("col_idx").alias("__last"))
    filler = ends.filter("__last + 1 < columns").select(key, "table", "row_idx", F.explode(F.sequence(F.col("__last") + 1, (F.col("columns") - 1).cast("long"))).alias("col_idx"), F.lit(None).cast("string").alias("text"))
    return numbered.select(key, "table", "row_idx", "col_idx", "text").unionByName(filler)


def compact_rows(text: Column, widths: Column) -> Column:
    """struct<rows, trailing> of one paragraph that holds whole rows of a table; null if it doesn't.

    Its rows are row_candidates(); of nothing but marks, marker_rows() of the defined or hinted columns. Several cells there must be. A last row of
    one cell behind a full one is no row but a paragraph that follows. Rows of single cells are filled up to the columns that marks hint at.
    """
    only_marks = F.rlike(text, F.lit(f"^{CELL}+$"))
    columns = F.when(F.size(widths) > 0, F.size(widths)).otherwise(mark_hint(text))
    marked = F.when(only_marks & (columns >= 2), F.transform(marker_rows(F.length(text), columns), lambda n: F.array_repeat(F.lit(""), n.cast("int"))))

    def laid(rows: Column) -> Column:
        sizes = F.transform(rows, F.size)
        inferred = F.when(F.forall(sizes, lambda n: n == 1), mark_columns(text)).otherwise(F.lit(0))
        return bound(F.struct(rows.alias("rows"), inferred.alias("inferred"), F.greatest(inferred, F.array_max(sizes)).alias("columns")), cut)

    def cut(p: Column) -> Column:
        last, before = F.element_at(p["rows"], -1), F.get(p["rows"], F.size(p["rows"]) - 2)
        follows = (p["columns"] > 1) & (F.size(p["rows"]) >= 2) & (F.size(last) == 1) & F.rlike(F.element_at(last, 1), F.lit(r"[^\s\x85\xA0]")) & (F.size(before) >= p["columns"])
        kept = F.when(follows, F.slice(p["rows"], 1, F.size(p["rows"]) - 1)).otherwise(p["rows"])
        filled = F.transform(kept, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), p["inferred"] - F.size(r)))))
        return F.struct(filled.alias("rows"), F.when(follows, F.element_at(last, 1)).alias("trailing"))

    rows = bound(row_candidates(text), lambda r: F.when(F.size(r) > 0, r).otherwise(marked))
    return bound(rows, lambda r: F.when((F.size(r) > 1) | F.exists(r, lambda c: F.size(c) > 1), laid(r)))


def row_score(widths: Column, width: Column, indent: Column, spacing: Column, gap_half: Column, n_borders: Column) -> Column:
    """How much a row's properties say: cells above all, then width, indent, gaps and borders."""
    return F.size(widths) * 1000 + F.least(F.abs(width), F.lit(999)) + F.least(F.abs(indent), F.lit(99)) + F.when(spacing > 0, 50).otherwise(0) + F.when(gap_half > 0, 25).otherwise(0) + n_borders


def resolved_rows(paragraphs: DataFrame, ranges: DataFrame, keys: list[str], ident: str, ahead: int = 64, back: int = 16) -> DataFrame:
    """keys, ident, best (start of the range), height, header, cant_split of paragraphs (start_cp, end_cp) by the ranges (start_cp, end_cp, score, height, header, cant_split) of row properties.

    Of the ranges within a paragraph the best by score, the last of equals; heights of later ones hold, flags add up. A paragraph without any takes
    the next that says something, at most `ahead` behind it, else the last before, at most `back` away. Ranges don't overlap: segments and two look-ups, no pairs.
    """
    from inkwell.operators.matching import asof_ceiling, asof_floor
    from inkwell.operators.sequences import segments

    fields = [ident, "score", "height", "header", "cant_split", "__s"]
    own = paragraphs.select(*keys, "start_cp", (F.col("end_cp") + 1).alias("end_cp"), ident)
    known = ranges.withColumn("__s", F.col("start_cp"))
    blank = {f: F.lit(None).cast(known.schema[f].dataType) for f in fields[1:]}
    base = own.select(*keys, "start_cp", "end_cp", ident, *[c.alias(f) for f, c in blank.items()])
    over = known.select(*keys, "start_cp", "end_cp", F.lit(None).cast(paragraphs.schema[ident].dataType).alias(ident), *fields[1:])
    parts = segments(base, keys, "start_cp", "end_cp", fields, over=over)
    o = F.col("over")
    within = parts.groupBy(*keys, F.col(f"base.{ident}").alias(ident)).agg(
        F.max_by(o["__s"], F.struct(o["score"], o["__s"])).alias("best"), F.max_by(F.when(o["height"] > 0, o["height"]), F.when(o["height"] > 0, o["__s"])).alias("height"),
        F.bool_or(o["header"]).alias("header"), F.bool_or(o["cant_split"]).alias("cant_split"),
    )
    record = F.struct("start_cp", "end_cp", "score", "height", "header", "cant_split")
    # a range's places, behind a paragraph's end or before its start
    lone = own.join(within.filter("best is null").select(*keys, ident), [*keys, ident])
    starts = known.filter("score > 0").select(*keys, F.col("start_cp").alias("__s"), record.alias("__next"))
    rows = asof_ceiling(lone, starts, keys, "end_cp", "__s", "__next", fallback_last=False)
    rows = asof_floor(rows, known.select(*keys, F.col("start_cp").alias("__s"), record.alias("__last")), keys, "start_cp", "__s", "__last", fallback_first=False)
    n, p = F.col("__next"), F.col("__last")
    chosen = F.coalesce(F.when(n["start_cp"] <= F.col("end_cp") - 1 + ahead, n), F.when(F.col("start_cp") - (p["end_cp"] - 1) <= back, p))
    probed = rows.withColumn("__c", chosen).select(*keys, ident, F.col("__c.start_cp").alias("best"), F.when(F.col("__c.height") > 0, F.col("__c.height")).alias("height"), F.col("__c.header").alias("header"), F.col("__c.cant_split").alias("cant_split"))
    every = within.filter("best is not null").unionByName(probed)
    return every.select(*keys, ident, "best", "height", F.coalesce("header", F.lit(False)).alias("header"), F.coalesce("cant_split", F.lit(False)).alias("cant_split"))


def finalised_cells(cells: DataFrame, key: str, columns: str) -> DataFrame:
    """key, row_idx, col_idx, row_span, col_span, filler of a table's cells (row_idx, col_idx, merges: bits 2 merged sideways, 8 merged downwards): rows filled up to the table's
    columns, merged cells gone, their owners spanning them."""
    whole = filled_rows(cells, key, columns).join(cells.select(key, "row_idx", "col_idx", "merges"), [key, "row_idx", "col_idx"], "left").withColumn("merges", F.coalesce("merges", F.lit(0)))
    across, down = Window.partitionBy(key, "row_idx").orderBy("col_idx"), Window.partitionBy(key, "col_idx").orderBy("row_idx")
    side = (F.col("merges").bitwiseAND(2) != 0) & (F.col("col_idx") > 0)
    below = (F.col("merges").bitwiseAND(8) != 0) & (F.col("row_idx") > 0)
    whole = whole.withColumns({"__side": side, "__below": below})
    whole = whole.withColumn("__a", F.sum(F.when(F.col("__side"), 0).otherwise(1)).over(across)).withColumn("__d", F.sum(F.when(F.col("__below"), 0).otherwise(1)).over(down))
    spans = whole.withColumn("col_span", F.count(F.lit(1)).over(Window.partitionBy(key, "row_idx", "__a"))).withColumn("row_span", F.count(F.lit(1)).over(Window.partitionBy(key, "col_idx", "__d")))
    return spans.filter(~F.col("__side") & ~F.col("__below")).select(key, "row_idx", "col_idx", "row_span", "col_span", "filler")

"""Stories beside the body: headers, notes, comments, sections; and the mapping of bytes to positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import garbled
from inkwell.operators.matching import asof_floor

#: The six slots of a section, in order; a page's measures in twips, as a section has them unless it says otherwise.
SLOTS = ("HeaderEven", "HeaderOdd", "FooterEven", "FooterOdd", "HeaderFirst", "FooterFirst")
SECTION = {
    "page_width": 11906, "page_height": 16838, "left": 1440, "right": 1440, "top": 1440, "bottom": 1440, "header": 720, "footer": 720, "gutter": 0, "break_code": 0,
    "columns": 1, "column_gap": 0, "grid_pitch": 0, "vertical": 0,
}


def header_slots(cps: Column, length: Column) -> Column:
    """array<struct<section, kind, cp, size>> of an array of positions: six to a section, each up to the next; clamped to the story's length,
    empty ones and those that begin outside left out, and so is a section that isn't whole."""
    n = F.floor((F.size(cps) - 1) / len(SLOTS)).cast("int") * len(SLOTS)

    def slot(i: Column) -> Column:
        begin, end = F.get(cps, i), F.get(cps, i + 1)
        size = F.when(begin.between(0, length - 1) & (end >= 0), F.least(end, length) - begin)
        kind = F.element_at(F.array(*[F.lit(s) for s in SLOTS]), i % len(SLOTS) + 1)
        return F.struct(F.floor(i / len(SLOTS)).cast("int").alias("section"), kind.alias("kind"), begin.alias("cp"), size.alias("size"))

    made = F.transform(F.sequence(F.lit(0), n - 1), slot)
    return F.when(n > 0, F.filter(made, lambda s: s["size"] > 0)).otherwise(F.array().cast("array<struct<section:int,kind:string,cp:bigint,size:bigint>>"))


def header_settings(parts: DataFrame, key: str, kind: Column, usable: Column, facing: Column) -> DataFrame:
    """key, n_headers, n_footers, even_and_odd of header and footer parts: how many are usable, and whether even pages differ: facing pages, or a usable even part."""
    count = lambda side: F.count_if(usable & F.startswith(kind, F.lit(side)))
    even = F.bool_or(facing) | F.bool_or(usable & F.endswith(kind, F.lit("Even")))
    return parts.groupBy(key).agg(count("Header").alias("n_headers"), count("Footer").alias("n_footers"), even.alias("even_and_odd"))


def repaired_length(length: Column, cps: Column) -> Column:
    """A story's length; where it is 0 the last of its positions, if there are any."""
    return F.coalesce(F.nullif(length, F.lit(0)), F.when(F.size(cps) > 0, F.nullif(F.element_at(cps, -1), F.lit(0))), F.lit(0))


def note_text(text: Column, again: Column, table: Column) -> Column:
    """A note's text; where it looks garbled what decoding its bytes anew gives, else what the table stream gives, garbled or not, else the text itself."""
    fine = lambda t: F.when(~garbled(t), t)
    return F.coalesce(fine(text), fine(again), F.nullif(table, F.lit("")), text)


def comment_text(text: Column) -> Column:
    """A comment's text: carriage returns become line feeds, and marks at its end go."""
    return F.regexp_replace(F.translate(text, "\r", "\n"), r"[\n\x05\r\x00]+$", "")


def refined_comments(comments: DataFrame, starts: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """comments (key, idx, cp) with start_cp and end_cp: where ranges (key, idx, cp) know better, of several the last, else the anchor."""
    last = lambda df, name: df.groupBy(key, "idx").agg(F.max_by("cp", "ord").alias(name))
    found = comments.join(last(starts, "start_cp"), [key, "idx"], "left").join(last(ends, "end_cp"), [key, "idx"], "left")
    return found.withColumns({"start_cp": F.coalesce("start_cp", "cp"), "end_cp": F.coalesce("end_cp", "cp")})


def comment_paragraphs(comments: DataFrame, paragraphs: DataFrame, key: str) -> DataFrame:
    """comments (key, idx, start_cp, end_cp) with start_para and end_para.

    paragraphs: key, para_idx, start_cp, end_cp, both null in one without runs, which stands where the greatest end before it is. A place
    belongs to the last paragraph that begins at or before it, else to the first; an end that isn't behind its start to the start's.
    """
    before = Window.partitionBy(key).orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)
    begins = paragraphs.select(key, "para_idx", F.coalesce("start_cp", F.max("end_cp").over(before), F.lit(0)).alias("__begin"))
    rows = asof_floor(comments, begins.withColumnRenamed("para_idx", "start_para"), [key], "start_cp", "__begin", "start_para")
    rows = asof_floor(rows, begins.withColumnRenamed("para_idx", "__end_para"), [key], "end_cp", "__begin", "__end_para")
    return rows.withColumn("end_para", F.when(F.col("end_cp") > F.col("start_cp"), F.col("__end_para")).otherwise(F.col("start_para"))).drop("__end_para")


def section_page(properties: Column, mirrored: Column, facing: Column) -> Column:
    """struct of a section's page: its properties (map<string, bigint>) over the defaults; landscape if wider than high; a gutter only with mirrored or facing pages."""
    value = lambda name: F.coalesce(F.try_element_at(properties, F.lit(name)), F.lit(SECTION[name]).cast("long"))
    gutter = F.when(mirrored | facing, value("gutter")).otherwise(F.lit(0).cast("long"))
    fields = [value(n).alias(n) for n in SECTION if n != "gutter"]
    return F.struct(*fields, gutter.alias("gutter"), (F.coalesce(F.try_element_at(properties, F.lit("title_page")), F.lit(0)) != 0).alias("title_page"), (value("page_width") > value("page_height")).alias("landscape"))


def document_page(sections: DataFrame, key: str, order: str, page: str) -> DataFrame:
    """key and the measures of the first section, which are the document's."""
    names = ("page_width", "page_height", "left", "right", "top", "bottom")
    return sections.groupBy(key).agg(F.min_by(page, order).alias("__p")).select(key, *[F.col(f"__p.{n}").alias(n) for n in names])


def field_faults(stories: DataFrame, key: str) -> DataFrame:
    """key, story of the stories (key, story, text, cps) whose list of field places marks no whole field: begin and end, each at a place of the list."""
    marks = F.transform(F.filter("cps", lambda c: c.between(0, F.length("text") - 1)), lambda c: F.substr("text", c + 1, F.lit(1)))
    depth = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("open"), F.lit(0).alias("whole")),
        lambda acc, m: F.when(m == "\x13", F.struct((acc["open"] + 1).alias("open"), acc["whole"].alias("whole"))).when((m == "\x15") & (acc["open"] > 0), F.struct((acc["open"] - 1).alias("open"), (acc["whole"] + 1).alias("whole"))).otherwise(acc),
        lambda acc: acc["whole"],
    )
    return stories.filter((F.size("cps") > 0) & (F.length("text") > 0) & (depth == 0)).select(key, "story")


def positions_of_bytes(points: DataFrame, pieces: DataFrame, keys: Sequence[str], fc: str, length: Column) -> DataFrame:
    """points with cp and clamped: byte offsets as character positions by way of the pieces (piece_no, cp_start, cp_end, offset, raw, wide).

    The first piece whose bytes hold the offset, or whose raw offsets, two to a character, do; the exact end of the last piece is its
    last position; else the offset itself, brought into 0 to length. Pieces of a document are few: an equi-join by key with the bytes as residual.
    """
    size = F.col("cp_end") - F.col("cp_start")
    step = F.when(F.col("wide"), 2).otherwise(1)
    ways = pieces.select(*[F.col(k).alias(f"__{k}") for k in keys], "piece_no", F.col("cp_start").alias("__from"), F.col("cp_end").alias("__end"), F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("offset").alias("at"), step.alias("step"), size.alias("n")), F.struct(F.lit(1).alias("way"), F.col("raw").alias("at"), F.lit(2).alias("step"), size.alias("n")))).alias("w"))
    ways = ways.select("*", (F.col("w.at") + F.col("w.n") * F.col("w.step")).alias("__stop"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    inside = same & (F.col("w.at") <= F.col(fc)) & (F.col(fc) < F.col("__stop"))
    distinct = points.select(*keys, fc).distinct()
    held = F.min(F.struct("piece_no", "w.way", (F.col("__from") + F.floor((F.col(fc) - F.col("w.at")) / F.col("w.step"))).alias("cp")))
    found = distinct.join(ways, inside).groupBy(*keys, fc).agg(held.alias("__h")).select(*keys, fc, F.col("__h.cp").alias("__cp"))
    ends = ways.groupBy(*[F.col(f"__{k}").alias(k) for k in keys]).agg(F.max_by(F.struct("__end", "__stop"), F.struct("piece_no", -F.col("w.way"))).alias("__one"), F.max_by(F.struct("__end", "__stop"), F.struct("piece_no", F.col("w.way"))).alias("__two"))
    rows = points.join(found, [*keys, fc], "left").join(ends, list(keys), "left")
    at_end = F.when(F.col(fc) == F.col("__one.__stop"), F.col("__one.__end")).when(F.col(fc) == F.col("__two.__stop"), F.col("__two.__end"))
    clamped = F.greatest(F.lit(0).cast("long"), F.least(F.col(fc), length))
    return rows.withColumn("cp", F.coalesce("__cp", at_end, clamped)).withColumn("clamped", F.coalesce("__cp", at_end).isNull()).drop("__cp", "__one", "__two")


def picture_sizes(runs: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """runs (key, run_idx, image, width, height) with the size that the shapes (key, shape_id, para, z, image, width, height) give them.

    The k-th run of an image goes with its k-th shape, in order of paragraph, depth and id. Where a document has as many picture shapes as
    runs, the k-th of all gives a size to the k-th run that has none yet.
    """
    place = [F.when(F.col("para") >= 0, F.col("para")).otherwise(F.lit(1 << 31)), "z", "shape_id"]
    number = lambda df, keys, order, name: df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    sized = lambda w, h: F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))
    own = number(runs, [key, "image"], ["run_idx"], "__k")
    by_image = number(shapes.filter("image is not null"), [key, "image"], place, "__k").select(key, "image", "__k", sized(F.col("width"), F.col("height")).alias("__first"))
    all_shapes = number(shapes, [key], place, "__n").select(key, "__n", sized(F.col("width"), F.col("height")).alias("__second"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("__m"))
    own = number(own, [key], ["run_idx"], "__n").withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(key)))
    rows = own.join(by_image, [key, "image", "__k"], "left").join(all_shapes, [key, "__n", "__m"], "left")
    rows = rows.withColumn("__size", F.coalesce("__first", sized(F.col("width"), F.col("height")), "__second"))
    return rows.select(key, "run_idx", "image", F.coalesce("__size.width", F.lit(0)).alias("width"), F.coalesce("__size.height", F.lit(0)).alias("height"))


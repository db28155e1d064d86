"""Properties of runs, paragraphs, tables and styles: how styles, pieces and direct formatting lie over each other.

A field is unset where it is null, or, in files, where it holds its default; `defaults` maps names of fields to these. A field whose
default is False is a flag: set anywhere, it stays set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators.sequences import segments

Defaults = Mapping[str, int | str | bool | None]
#: The defaults of fields in files.
RUN_DEFAULTS: Defaults = {
    "font": -1, "size": 24, "size_cs": 24, "bold": False, "bold_cs": False, "italic": False, "italic_cs": False, "underline": 0, "strike": False, "double_strike": False,
    "small_caps": False, "caps": False, "hidden": False, "colour_index": 0, "highlight": 0, "kerning": 0, "position": 0, "scale": 100, "language": 0, "spacing": 0,
}
PARAGRAPH_DEFAULTS: Defaults = {
    "justify": 0, "left": 0, "left_chars": 0, "right": 0, "right_chars": 0, "first_line": 0, "first_line_chars": 0, "keep": False, "keep_next": False, "page_break": False,
    "outline_level": 9, "list": 0, "level": 0,
}
TABLE_DEFAULTS: Defaults = {"style": -1, "spacing": 0, "indent": 0, "justify": 0, "width": 0, "border_top": None, "border_left": None, "border_bottom": None, "border_right": None, "border_inside_h": None, "border_inside_v": None, "shading": None}
#: The single border that a table without any gets, eighths of a point wide; the fonts of a file without a font table.
FALLBACK_BORDER = ("Single", 4, 0, 0)
DEFAULT_FONTS = ("Times New Roman", "Arial", "Courier New", "Symbol", "Wingdings", "Calibri", "Cambria", "宋体", "Tahoma", "Verdana")


def _set(value: Column, default: int | str | bool | None) -> Column:
    return value if default is None else F.nullif(value, F.lit(default))


def overlay(base: Column, over: Column, defaults: Defaults, explicit: Sequence[str] = ()) -> list[Column]:
    """The fields of base with those of over laid over them: set values win, flags add up. A flag named in explicit has a second one,
    explicit_<name>, that makes over's value hold, set or not."""
    out = []
    for name, default in defaults.items():
        if default is False:
            either = F.coalesce(base[name], F.lit(False)) | F.coalesce(over[name], F.lit(False))
            value = F.when(F.coalesce(over[f"explicit_{name}"], F.lit(False)), F.coalesce(over[name], F.lit(False))).otherwise(either) if name in explicit else either
        else:
            value = F.coalesce(_set(over[name], default), base[name])
        out.append(value.alias(name))
    return out


def filled(own: Column, base: Column, defaults: Defaults) -> list[Column]:
    """The fields of own, those that are unset taken from base; base may be null. What overlay() is from the other side, but flags."""
    return [F.coalesce(_set(own[n], d) if d is not False else F.nullif(own[n], F.lit(False)), base[n], own[n]).alias(n) for n, d in defaults.items()]


def effective_run(paragraph_style: Column, character_style: Column, direct: Column, defaults: Defaults) -> Column:
    """struct of a run's fields: its paragraph's style, over it its character style, over it its direct formatting; an explicit italic holds."""
    explicit = [n for n in ("italic", "italic_cs") if n in defaults]
    plain = F.struct(*[F.lit(d).alias(n) for n, d in defaults.items()])
    styled = F.when(character_style.isNull(), F.coalesce(paragraph_style, plain)).otherwise(F.struct(*overlay(F.coalesce(paragraph_style, plain), character_style, defaults)))
    return F.when(direct.isNull(), styled).otherwise(F.struct(*overlay(styled, direct, defaults, explicit)))


def paragraph_with_style(own: Column, style: Column) -> Column:
    """struct of a paragraph's fields, those unset taken from its style. Space before and after: in points, else in lines, of one side together;
    a list with its level; line spacing with its multiple, unless the paragraph sets it. style may be null."""
    fields = filled(own, style, {k: v for k, v in PARAGRAPH_DEFAULTS.items() if k not in ("list", "level", "outline_level")})
    unset = lambda name: F.coalesce(own[name], F.lit(0)) == 0
    for side in ("before", "after"):
        fields.append(F.when(unset(f"space_{side}"), F.coalesce(style[f"space_{side}"], own[f"space_{side}"])).otherwise(own[f"space_{side}"]).alias(f"space_{side}"))
        free = unset(f"space_{side}") & (F.coalesce(style[f"space_{side}"], F.lit(0)) == 0) & unset(f"lines_{side}")
        fields.append(F.when(free, F.coalesce(style[f"lines_{side}"], own[f"lines_{side}"])).otherwise(own[f"lines_{side}"]).alias(f"lines_{side}"))
    listed = unset("list") & (F.coalesce(style["list"], F.lit(0)) != 0)
    same = ~unset("list") & unset("level") & (style["list"] == own["list"])
    fields += [F.when(listed, style["list"]).otherwise(own["list"]).alias("list"), F.when(F.coalesce(listed | same, F.lit(False)), style["level"]).otherwise(own["level"]).alias("level")]
    explicit, theirs = F.coalesce(own["explicit_line"], F.lit(False)), F.coalesce(style["explicit_line"], F.lit(False))
    taken = ~explicit & (theirs | ((own["line"] == 240) & F.coalesce(style["line"] != 240, F.lit(False))))
    fields += [F.when(taken, style[n]).otherwise(own[n]).alias(n) for n in ("line", "line_multiple")]
    return F.struct(*fields, (explicit | theirs).alias("explicit_line"))


def overlaid_runs(base: DataFrame, over: DataFrame, keys: Sequence[str], start: str, end: str, defaults: Defaults, explicit: Sequence[str] = ()) -> DataFrame:
    """keys, start, end and the fields of the elementary segments of base, with the ranges of over laid over them. One shuffle, no pairs."""
    fields = [*defaults, *(f"explicit_{n}" for n in explicit)]
    parts = segments(base, keys, start, end, fields, over=over)
    return parts.select(*keys, start, end, F.when(F.col("over").isNull(), F.struct(*[F.col("base")[n].alias(n) for n in defaults])).otherwise(F.struct(*overlay(F.col("base"), F.col("over"), defaults, explicit))).alias("p")).select(*keys, start, end, "p.*")


def overlaid_in_order(paragraphs: DataFrame, ranges: DataFrame, keys: Sequence[str], start: str, end: str, ident: str, defaults: Defaults) -> DataFrame:
    """keys, ident and the fields of paragraphs under all ranges that they meet, one after another: of each field the last range's that sets it, else the paragraph's own.

    Neither paragraphs nor ranges overlap, so that the segments of both are as many as these together; the rest is one aggregate.
    """
    fields = [ident, *defaults]
    sides = [paragraphs.select(*keys, start, end, *fields), ranges.withColumn(ident, F.lit(None).cast(paragraphs.schema[ident].dataType)).select(*keys, start, end, *fields)]
    parts = segments(sides[0], keys, start, end, fields, over=sides[1])

    def folded(name: str, default: int | str | bool | None) -> Column:
        own = F.first(F.col("base")[name])
        if default is False:
            return (F.coalesce(own, F.lit(False)) | F.coalesce(F.bool_or(F.col("over")[name]), F.lit(False))).alias(name)
        value = _set(F.col("over")[name], default)
        return F.coalesce(F.max_by(value, F.when(value.isNotNull(), F.col(start))), own).alias(name)

    return parts.groupBy(*keys, F.col("base")[ident].alias(ident)).agg(*[folded(n, d) for n, d in defaults.items()])


def effective_table(own: Column, style: Column, needs_borders: Column, defaults: Defaults = TABLE_DEFAULTS) -> Column:
    """struct of a table's fields: its own, filled from its style; six single borders where it has none and needs them; null where nothing is set and none are needed."""
    borders = [n for n in defaults if n.startswith("border_")]
    merged = F.when(style.isNull(), F.struct(*[own[n].alias(n) for n in defaults])).otherwise(F.struct(*filled(own, style, defaults)))
    bare = F.struct(*[F.lit(d).alias(n) if n not in borders and n != "shading" else F.lit(None).alias(n) for n, d in defaults.items()])
    known = F.when(own.isNotNull(), merged).otherwise(bare)
    framed = F.lit(False)
    for n in borders:
        framed = framed | F.coalesce(own[n], style[n]).isNotNull()
    line = F.struct(*[F.lit(v).alias(k) for k, v in zip(("style", "width", "space", "colour"), FALLBACK_BORDER, strict=True)])
    drawn = F.struct(*[(line if n in borders else known[n]).alias(n) for n in defaults])
    return F.when(own.isNull() & ~needs_borders, F.lit(None)).when(needs_borders & ~F.coalesce(F.when(own.isNotNull(), framed), F.lit(False)), drawn).otherwise(known)


def default_styles(spark: SparkSession) -> DataFrame:
    """style_id, kind, name, based_on, space_before, space_after, size, bold: the sheet of a file that has none."""
    rows = [(0, "paragraph", "Normal", None, 0, 0, 24, False)]
    rows += [(k, "paragraph", f"heading {k}", 0, (10 - k) * 60, 60, (18 - 2 * k) * 2, True) for k in range(1, 10)]
    rows.append((10, "character", "Default Paragraph Font", None, 0, 0, 24, False))
    return spark.createDataFrame(rows, "style_id int, kind string, name string, based_on int, space_before int, space_after int, size int, bold boolean")


def with_default_styles(styles: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """styles (key, style_id, kind and more) with the default ones that a document doesn't define; defaults: of a few rows, the same columns but key."""
    own = styles.select(key, "style_id", "kind")
    missing = styles.select(key).distinct().crossJoin(F.broadcast(defaults)).join(own, [key, "style_id", "kind"], "left_anti")
    return styles.unionByName(missing.select(*styles.columns))


def built_in_title(kind: Column, sti: Column, name: Column, n_blocks: Column, justify: Column, size: Column) -> tuple[Column, Column, Column]:
    """justify, bold, size of a title style without property blocks of its own: centred, bold, 28 points; nulls for other styles."""
    title = (kind == "paragraph") & (n_blocks == 0) & ((sti == 15) | (F.lower(name) == "title"))
    return F.when(title & (justify == 0), F.lit(1)), F.when(title, F.lit(True)), F.when(title & (size == 24), F.lit(56))


def unchanged(df: DataFrame, keys: Sequence[str], order: Sequence[str], record: Sequence[str], name: str = "unchanged") -> DataFrame:
    """df with whether a row's record, field by field and nulls equal, is that of the row before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    record_of = F.struct(*record)
    return df.withColumn(name, F.coalesce((F.row_number().over(w) > 1) & F.lag(record_of).over(w).eqNullSafe(record_of), F.lit(False)))

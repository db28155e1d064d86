"""Charts from sheets: the grid of cells as categories and series, and what kind of chart that makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds by what a stream's name holds, in the order in which they are tried.
NAMED_KINDS = (("pie", "Pie"), ("doughnut", "Doughnut"), ("donut", "Doughnut"), ("line", "Line"), ("bar", "Bar"), ("area", "Area"), ("radar", "Radar"), ("scatter", "Scatter"))


def chart_series(cells: DataFrame, key: str) -> DataFrame:
    """key, series, name, categories, values of cells (key, row, col, number, text), row and col from 0; number or text null.

    Categories stand in the first row and series below; if there are more rows than columns, nothing stands in the first row and something in the
    first column, they stand there and series beside. A name is the cell's text, else its number, else its kind and place. A missing
    value is 0; a series without any value is left out. Greatest places are those of cells with numbers.
    """
    top = cells.groupBy(key).agg(
        F.max(F.when(F.col("number").isNotNull(), F.col("row"))).alias("__rows"), F.max(F.when(F.col("number").isNotNull(), F.col("col"))).alias("__cols"),
        F.collect_set(F.when((F.col("row") == 0) & (F.col("col") > 0), F.col("col"))).alias("__in_row"), F.collect_set(F.when((F.col("col") == 0) & (F.col("row") > 0), F.col("row"))).alias("__in_col"),
    ).filter("__rows is not null")
    down = (F.col("__rows") > F.col("__cols")) & ~F.exists("__in_row", lambda c: c <= F.col("__cols")) & F.exists("__in_col", lambda r: r <= F.col("__rows"))
    top = top.select(key, down.alias("__down"), F.when(down, F.col("__rows")).otherwise(F.col("__cols")).alias("__n"))
    # laid so that series are rows and categories columns
    laid = cells.join(top, key).select(key, "__n", F.when(F.col("__down"), F.col("col")).otherwise(F.col("row")).alias("series"), F.when(F.col("__down"), F.col("row")).otherwise(F.col("col")).alias("at"), "number", F.coalesce("text", _shown(F.col("number"))).alias("__label"))
    by_place = lambda v: F.map_from_entries(F.collect_list(F.when(v.isNotNull(), F.struct("at", v))))
    rows = laid.groupBy(key, "__n", "series").agg(by_place(F.col("__label")).alias("__labels"), by_place(F.when(F.col("at") > 0, F.col("number"))).alias("__numbers"))
    places = F.when(F.col("__n") > 0, F.sequence(F.lit(1), F.col("__n").cast("int"))).otherwise(F.array().cast("array<int>"))
    at = lambda m, i: F.try_element_at(m, i.cast("long"))
    rows = rows.withColumn("categories", F.transform(places, lambda i: F.coalesce(at(F.col("__labels"), i), F.concat(F.lit("Category "), i.cast("string")))))
    heads = rows.filter("series = 0").select(key, F.col("categories").alias("__heads"))
    made = rows.filter("series > 0 and size(__numbers) > 0").join(heads, key, "left")
    name = F.coalesce(at(F.col("__labels"), F.lit(0)), F.concat(F.lit("Series "), F.col("series").cast("string")))
    plain = F.transform(places, lambda i: F.concat(F.lit("Category "), i.cast("string")))
    return made.select(key, "series", name.alias("name"), F.coalesce("__heads", plain).alias("categories"), F.transform(places, lambda i: F.coalesce(at(F.col("__numbers"), i), F.lit(0.0))).alias("values"))


def _shown(number: Column) -> Column:
    """A number as a label: whole ones without a point."""
    return F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))


def chart_kind(n_series: Column, n_categories: Column, name: Column) -> Column:
    """Pie for one series over several categories, else what the stream's name tells, else Column."""
    case = F.when((n_series == 1) & (n_categories > 1), F.lit("Pie"))
    for part, kind in NAMED_KINDS:
        case = case.when(F.contains(F.lower(name), F.lit(part)), F.lit(kind))
    return case.otherwise(F.lit("Column"))


def chart_layout(kind: Column, n_series: Column, legend: Column, series_name: Column, categories: Column, value_title: Column) -> dict[str, Column]:
    """Legend, axes and titles of a chart.

    One series or none has no legend, and names the value axis unless it has a title or the name is a made one. With one or two series a legend
    stands below pies, else to the right. A bar chart's categories stand to the left. Categories that are numbers and fall
    strictly run in reverse.
    """
    shown = legend & (n_series > 1)
    pies = kind.isin("Pie", "Doughnut")
    numbers = F.transform(categories, lambda c: F.try_to_number(F.trim(c), F.lit("S9999999999.999999")).cast("double"))
    falls = (F.size(categories) >= 2) & F.forall(numbers, lambda x: x.isNotNull()) & F.forall(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(categories))), lambda i: F.coalesce(F.get(numbers, i - 1) < F.get(numbers, i - 2), F.lit(False)))
    own_name = F.when((n_series == 1) & (F.trim(series_name) != "") & ~F.startswith(F.lower(series_name), F.lit("series ")), series_name)
    return {
        "legend": F.when(shown & (n_series <= 2), F.when(pies, F.lit("Bottom")).otherwise(F.lit("Right"))),
        "category_axis": F.when(pies, F.lit(None).cast("string")).when(kind == "Bar", F.lit("Left")).otherwise(F.lit("Bottom")),
        "value_axis": F.when(pies, F.lit(None).cast("string")).when(kind == "Bar", F.lit("Bottom")).otherwise(F.lit("Left")),
        "value_title": F.coalesce(F.nullif(F.trim(value_title), F.lit("")), own_name),
        "reversed": falls,
    }

"""Assignments whose outcome depends on the order in which they are made: one group of rows at a time, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a paragraph's distance weighs, and what an unknown side costs.
PARAGRAPH_WEIGHT, UNKNOWN = 100, 10_000


def _cogrouped(left: DataFrame, right: DataFrame, key: str, pick: Callable[[pd.DataFrame, pd.DataFrame], list[tuple]], columns: str) -> DataFrame:
    kind = left.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in columns.split(", "))]

    def run(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k[0], *row) for row in pick(a, b)], columns=names)

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(run, f"{key} {kind}, {columns}")


def textboxes_to_shapes(boxes: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """key, idx, shape_id, score: each textbox (idx, para) in order of idx takes the free shape (shape_id, para) of least score, of equal ones the first.

    A score is 100 per paragraph between both, 10 000 if just one side's paragraph is known (-1: unknown), plus how far idx is
    from the shape's id modulo 1000. Objects of one document are few; documents are spread by key.
    """

    def pick(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
        free = list(b.sort_values("shape_id")[["shape_id", "para"]].itertuples(index=False, name=None))
        out = []
        for idx, para in a.sort_values("idx")[["idx", "para"]].itertuples(index=False, name=None):
            best = None
            for shape, at in free:
                apart = abs(para - at) * PARAGRAPH_WEIGHT if para >= 0 and at >= 0 else UNKNOWN if para >= 0 or at >= 0 else 0
                score = apart + abs(idx - shape % 1000)
                if best is None or score < best[0]:
                    best = (score, shape, at)
            if best is not None:
                free.remove(best[1:])
                out.append((int(idx), int(best[1]), int(best[0])))
        return out

    return _cogrouped(boxes, shapes, key, pick, "idx long, shape_id long, score long")


def runs_to_images(runs: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """key, run_idx, image_idx: picture runs (run_idx, offset) in order each take the free image (image_idx, offset) nearest by offset.

    Offset 0 is unknown on either side; a run without a choice takes the next free image in order, 0 when there is none.
    """

    def pick(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
        order = list(b.sort_values("image_idx")[["image_idx", "offset"]].itertuples(index=False, name=None))
        taken: set = set()
        out = []
        for run, offset in a.sort_values("run_idx")[["run_idx", "offset"]].itertuples(index=False, name=None):
            near = [(abs(at - offset), image) for image, at in order if image not in taken and at] if offset else []
            chosen = min(near)[1] if near else next((image for image, _ in order if image not in taken), 0)
            taken.add(chosen)
            out.append((int(run), int(chosen)))
        return out

    return _cogrouped(runs, images, key, pick, "run_idx long, image_idx long")


def column_widths(cells: DataFrame, keys: Sequence[str], columns: int) -> DataFrame:
    """keys, widths: of each table's cells (row_idx, col_idx, span, width). Single columns take the widest cell; what spanning cells have left is
    then shared out over their columns of unknown width, in order of rows and columns.

    The first step is an aggregate that shrinks a table to its columns before the second, which goes one table at a time over
    spanning cells only.
    """
    single = cells.filter("span <= 1 and width > 0").filter(f"col_idx between 0 and {columns - 1}").groupBy(*keys, "col_idx").agg(F.max("width").alias("width"))
    single = single.withColumn("row_idx", F.lit(-1)).withColumn("span", F.lit(1))
    wide = cells.filter("span > 1 and width > 0").filter(f"col_idx between 0 and {columns - 1}")
    names = ["row_idx", "col_idx", "span", "width"]
    both = single.select(*keys, *[F.col(c).cast("long").alias(c) for c in names]).unionByName(wide.select(*keys, *[F.col(c).cast("long").alias(c) for c in names]))

    whole = both.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("all"))

    def run(batches):
        for batch in batches:
            solved = []
            for cells_of in batch.column("all").to_pylist():
                widths = [0] * columns
                for x in cells_of:
                    mine = range(x["col_idx"], min(columns, x["col_idx"] + x["span"]))
                    if x["span"] == 1:
                        widths[x["col_idx"]] = x["width"]
                        continue
                    unknown = [c for c in mine if not widths[c]]
                    left = x["width"] - sum(widths[c] for c in mine)
                    if unknown and left > 0:
                        for n, c in enumerate(unknown):
                            widths[c] = max(1, left // len(unknown)) + (n < left % len(unknown))
                solved.append(widths)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(solved, pa.list_(pa.int64()))], [*keys, "widths"])

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    return whole.mapInArrow(run, f"{kinds}, widths array<long>")


def prefix_runs(cells: Sequence[str], runs: Sequence[str]) -> list[tuple[int, int, int, int]]:
    """(cell, run, offset, length): each cell's text taken from the runs' text, in order, as far as both agree.

    Blanks and cell marks in the runs that a cell doesn't begin with are stepped over; at anything else a cell ends.
    """
    out, run, at = [], 0, 0
    for k, cell in enumerate(cells):
        rest = cell.strip()
        while rest and run < len(runs):
            text = runs[run]
            if at >= len(text):
                run, at = run + 1, 0
                continue
            most = min(len(rest), len(text) - at)
            n = most if rest[:most] == text[at : at + most] else next(i for i in range(most) if rest[i] != text[at + i])
            if n:
                out.append((k, run, at, n))
                at, rest = at + n, rest[n:]
            elif text[at].isspace() or text[at] == "\x07":
                at += 1
            else:
                break
    return out


#: Rows of a batch of runs.
MOST_ROWS = 50_000


def run_batches(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The runs of each row's cells, in batches of MOST_ROWS and what the last row of each adds."""
    names = ["cell", "run", "offset", "length"]
    for batch in batches:
        at, found = [], [[] for _ in names]
        for i, (cells, runs) in enumerate(zip(batch.column("cells"), batch.column("runs"), strict=True)):
            rows = prefix_runs(cells.as_py() or [], runs.as_py() or [])
            at += [i] * len(rows)
            for column, values in zip(found, zip(*rows, strict=True), strict=bool(rows)):
                column += values
            if len(at) >= MOST_ROWS or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in found)], [key, *names])
                at, found = [], [[] for _ in names]


def cells_to_runs(paragraphs: DataFrame, key: str) -> DataFrame:
    """key, cell, run, offset, length of paragraphs (key, cells array<string>, runs array<string>), each by itself, in Arrow batches."""
    kind = paragraphs.schema[key].dataType.simpleString()
    return paragraphs.select(key, "cells", "runs").mapInArrow(lambda batches: run_batches(batches, key), f"{key} {kind}, cell long, run long, offset long, length long")


def column_major(rows: Sequence[Sequence[str]], merged: Sequence[Sequence[int]]) -> list[tuple[int, int, int, list[str]]] | None:
    """(row, column, row span, paragraphs) of a nested table whose rows were single cells of several paragraphs, dealt to columns; None if they don't go evenly.

    merged: by row and column 1 for a cell merged into the one above, 2 for one merged into the one to its left. Columns are gone through one by one,
    each row giving its next paragraph. A cell merged upwards, or one of a row that has fewer paragraphs left than columns while a row
    above has more, adds the owner's next paragraph to the owner instead, which then spans down to here.
    """
    total = sum(map(len, rows))
    if len(rows) < 2 or total <= len(rows) or total % len(rows):
        return None
    n = total // len(rows)
    queues, left = [list(r) for r in rows], [n] * len(rows)
    cells: list[list[list[str]]] = [[[] for _ in range(n)] for _ in rows]
    spans = [[1] * n for _ in rows]
    flag = lambda r, c: merged[r][c] if r < len(merged) and c < len(merged[r]) else 0
    for c in range(n):
        for r, queue in enumerate(queues):
            owner = -1
            if flag(r, c) == 1:
                owner = next((k for k in range(r - 1, -1, -1) if spans[k][c] >= r - k or cells[k][c]), -1)
            elif r and len(queue) < left[r]:
                owner = next((k for k in range(r - 1, -1, -1) if len(queues[k]) > left[k]), -1)
            if owner >= 0:
                if queues[owner]:
                    cells[owner][c].append(queues[owner].pop(0))
                spans[owner][c] = max(spans[owner][c], r - owner + 1)
            elif queue:
                part = queue.pop(0)
                if flag(r, c) == 2 and c:
                    cells[r][c - 1].append(part)
                else:
                    cells[r][c] = [part]
            left[r] -= 1
    return [(r, c, spans[r][c], cells[r][c]) for r in range(len(rows)) for c in range(n)]


def column_major_tables(tables: DataFrame, key: str) -> DataFrame:
    """key, row_idx, col_idx, row_span, texts of tables (key, rows array<array<string>>, merged array<array<int>>) that column_major() can deal; the others have no rows."""
    kind = tables.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [(k.as_py(), *x) for k, r, m in zip(batch.column(key), batch.column("rows"), batch.column("merged"), strict=True) for x in column_major(r.as_py() or [], m.as_py() or []) or ()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [batch.schema.field(key).type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "row_idx", "col_idx", "row_span", "texts"])

    return tables.select(key, "rows", "merged").mapInArrow(run, f"{key} {kind}, row_idx long, col_idx long, row_span long, texts array<string>")

"""Shapes, images, borders and floating tables as Column expressions."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.formats import bits, named
from inkwell.functions.text import NUMBERED, bound

#: Shape kinds by code, frames of reference by code, wraps by code, image types with extension and content type.
SHAPE_KINDS = {
    **dict.fromkeys([0x01, 0x02, 0x04, 0x07, 0x08, 0x15, 0x41, 0x54, 0x6D, 0x72, 0x74, 0xB0, 0xB1], "Rectangle"),
    **dict.fromkeys([0x03, 0x3F], "Ellipse"),
    0xCA: "Textbox",
    0x4B: "Picture",
}
HORIZONTAL, VERTICAL = ["Page", "Margin", "Column", "Column"], ["Page", "Margin", "Paragraph", "Paragraph"]
WRAPS = {1: "Tight", 2: "Through", 3: "Square", 4: "TopBottom"}
TEXTBOX_WRAPS = {"Square": "Square", "Tight": "Tight", "Through": "Through", "TopBottom": "TopBottom", "BehindText": "Behind", "InFrontOfText": "InFront"}
IMAGES = {
    "Png": ("png", "image/png"), "Jpeg": ("jpg", "image/jpeg"), "Gif": ("gif", "image/gif"), "Emf": ("emf", "image/x-emf"), "Wmf": ("wmf", "image/x-wmf"),
    "Dib": ("bmp", "image/bmp"), "Tiff": ("tiff", "image/tiff"),
}
GRID = 21600


def _table(key: Column, pairs: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key), F.lit(other))


def shape_kind(code: Column) -> Column:
    return named(code, SHAPE_KINDS, "Unknown")


def anchor(flags: Column) -> dict[str, Column]:
    """Frames of reference and wrap of an anchor's flags."""
    wrap = bits(flags, 5, 3)
    return {
        "horizontal": named(bits(flags, 1, 2), HORIZONTAL),
        "vertical": named(bits(flags, 3, 2), VERTICAL),
        "wrap": F.when(wrap == 0, F.when(flags.bitwiseAND(0x2000) != 0, F.lit("BehindText")).otherwise(F.lit("InFrontOfText"))).otherwise(named(wrap, WRAPS, "Square")),
    }


def textbox_wrap(wrap: Column) -> Column:
    return _table(wrap, TEXTBOX_WRAPS, "Inline")


def image_extension(kind: Column) -> Column:
    return _table(kind, {k: v[0] for k, v in IMAGES.items()}, "bin")


def image_content_type(kind: Column) -> Column:
    return _table(kind, {k: v[1] for k, v in IMAGES.items()}, "application/octet-stream")


def wrap_polygon(vertices: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """array<struct<x, y>> of a view's vertices on a grid of 21600, clamped, without repeats one after another; null with fewer than three, or in an empty view."""
    place = lambda v, low, high: F.least(F.lit(GRID), F.greatest(F.lit(0), F.bround((v - low) * float(GRID) / (high - low)).cast("int")))
    points = F.transform(vertices, lambda v: F.struct(place(v["x"], left, right).alias("x"), place(v["y"], top, bottom).alias("y")))
    changed = bound(points, lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x)))
    fit = (F.size(vertices) >= 3) & (right > left) & (bottom > top)
    return F.when(fit, bound(changed, lambda p: F.when(F.size(p) >= 3, p)))


def merged_border(old: Column, new: Column) -> Column:
    """Of two borders (style, colour) the one that stays: a style over none, a direct colour over the palette's, a colour over none."""
    wins = ((old["style"] == "None") & (new["style"] != "None")) | ((new["colour"] > 16) & old["colour"].between(0, 16)) | ((old["colour"] == 0) & (new["colour"] != 0))
    return F.when(new.isNull(), old).when(old.isNull(), new).when(wins, new).otherwise(old)


def malformed_border(width: Column, colour: Column) -> Column:
    return (width > 96) & (colour == 255)


def merged_floating(old: Column, new: Column, positions: list[str]) -> Column:
    """Positions that are zero take the new ones; overlap is allowed only where both allow it."""
    parts = [F.coalesce(F.nullif(old[p], F.lit(0)), new[p]).alias(p) for p in positions]
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.struct(*parts, (old["overlap"] & new["overlap"]).alias("overlap")))


def section_heading(text: Column) -> Column:
    return F.rlike(text, F.lit(NUMBERED))


def metadata_cell(text: Column) -> Column:
    """A short text with a colon that isn't a section heading."""
    return (F.length(text) <= 40) & F.rlike(text, F.lit("[：:]")) & ~section_heading(text)


def metadata_pair(first: Column, second: Column) -> Column:
    """array of both texts; of two with the same label the longer one first."""
    label = lambda s: bound(F.regexp_instr(s, F.lit("[：:]")), lambda at: F.when(at > 1, F.substr(s, F.lit(1), at - 1)).otherwise(s))
    return F.when((label(first) == label(second)) & (F.length(second) > F.length(first)), F.array(second, first)).otherwise(F.array(first, second))


def plausible_header(extracted: Column, parsed: Column) -> Column:
    """Whether parsed paragraphs fit the text taken as a whole: neither far longer nor another text."""
    from inkwell.functions.text import comparison_key

    a, b = comparison_key(extracted), comparison_key(parsed)
    fits = (F.length(b) <= F.greatest(F.lit(96), 4 * F.length(a))) & (F.contains(b, a) | F.contains(a, b))
    return (F.length(b) > 0) & F.when(F.length(a) == 0, F.length(b) <= 64).otherwise(fits)


def picture_size(goal_width: Column, goal_height: Column, scale_x: Column, scale_y: Column, most_width: Column) -> Column:
    """struct<width, height, flip_x, flip_y> of a picture's header: goals scaled by thousandths, a negative scale turns it over, the width cut to the page; null without a goal."""
    scaled = lambda goal, scale: F.when((scale != 0) & (F.abs(scale) != 1000), goal * F.abs(scale) / F.lit(1000.0)).otherwise(goal.cast("double"))
    width = scaled(goal_width, scale_x)
    width = F.when((most_width > 0) & (width > most_width), most_width.cast("double")).otherwise(width)
    made = F.struct(F.round(width).cast("int").alias("width"), F.round(scaled(goal_height, scale_y)).cast("int").alias("height"), (scale_x < 0).alias("flip_x"), (scale_y < 0).alias("flip_y"))
    return bound(made, lambda m: F.when((goal_width > 0) & (goal_height > 0) & (m["width"] > 0) & (m["height"] > 0), m))


def _pixel() -> bytes:
    """A PNG of one transparent pixel."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(5))) + chunk(b"IEND", b"")


#: What stands for an image without bytes.
PLACEHOLDER = _pixel()


def image_bytes(data: Column) -> Column:
    """An image's bytes, the placeholder where there are none."""
    return F.when(F.octet_length(data) > 0, data).otherwise(F.lit(bytearray(PLACEHOLDER)))

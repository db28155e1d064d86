"""Numbers, colours, dates and tokens of the binary format as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import xml_safe

#: Palette colours 0 to 16, highlight names 0 to 16, theme colour names and their scheme names 0 to 11.
PALETTE = ["000000", "000000", "0000FF", "00FFFF", "00FF00", "FF00FF", "FF0000", "FFFF00", "FFFFFF", "00008B", "008B8B", "006400", "8B008B", "8B0000", "808000", "A9A9A9", "D3D3D3"]
HIGHLIGHTS = ["none", "black", "blue", "cyan", "green", "magenta", "red", "yellow", "white", "darkBlue", "darkCyan", "darkGreen", "darkMagenta", "darkRed", "darkYellow", "darkGray", "lightGray"]
THEME_NAMES = ["dark1", "light1", "dark2", "light2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hyperlink", "followedHyperlink"]
SCHEME_NAMES = ["dk1", "lt1", "dk2", "lt2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink"]
#: The number formats by code.
NUMBER_FORMATS = {
    0: "Decimal", 1: "UpperRoman", 2: "LowerRoman", 3: "UpperLetter", 4: "LowerLetter", 5: "OrdinalNumber", 6: "CardinalText", 7: "OrdinalText",
    10: "DecimalFullWidth", 11: "DecimalHalfWidth", 12: "JapaneseCounting", 14: "DecimalEnclosedCircle", 22: "DecimalZero", 23: "Bullet",
    30: "TaiwaneseCountingThousand", 31: "TaiwaneseDigital", 33: "ChineseCounting", 34: "ChineseCountingThousand", 35: "KoreanDigital",
    38: "KoreanCounting", 39: "Hebrew1", 41: "ArabicAlpha", 45: "Hebrew2", 46: "ArabicAbjad", 47: "HindiVowels",
}
#: The shading patterns by code; others are clear, FFFF is nil.
SHADINGS = {
    0: "clear", 1: "solid", 2: "pct5", 3: "pct10", 4: "pct20", 5: "pct25", 6: "pct30", 7: "pct40", 8: "pct50", 9: "pct60", 10: "pct70",
    11: "pct75", 12: "pct80", 13: "pct90", 14: "horzStripe", 15: "vertStripe", 16: "reverseDiagStripe", 17: "diagStripe", 18: "horzCross",
    19: "diagCross", 20: "thinHorzStripe", 21: "thinVertStripe", 22: "thinReverseDiagStripe", 23: "thinDiagStripe", 24: "thinHorzCross",
    25: "thinDiagCross", 37: "pct12", 38: "pct15", 43: "pct35", 44: "pct37", 46: "pct45", 49: "pct55", 51: "pct62", 52: "pct65", 57: "pct85", 60: "pct95",
}
#: Border styles by code (others are single) with the tokens that name them, alignments, underlines, alignments of numbering levels.
BORDERS = [
    "None", "Single", "Thick", "Double", None, "Dotted", "Dashed", "DotDash", "DotDotDash", "Triple", "ThinThickSmallGap", "ThickThinSmallGap",
    "ThinThickThinSmallGap", "ThinThickMediumGap", "ThickThinMediumGap", "ThinThickThinMediumGap", "ThinThickLargeGap", "ThickThinLargeGap",
    "ThinThickThinLargeGap", "Wave",
]
ALIGNMENTS = ["left", "center", "right", "both", "distribute", "thaiDistribute"]
UNDERLINES = ["none", "single", "word", "double", "dotted", "thick", "dash", "dotDash", "dotDotDash", "wave", "thickWave"]
LEVEL_ALIGNMENTS = {1: "center", 2: "right"}
THEME_BIT = 0x0100_0000


def named(code: Column, names: dict[int, str] | list[str], other: str | None = None) -> Column:
    """The name of a code, by a literal map; other for codes without one."""
    pairs = enumerate(names) if isinstance(names, list) else names.items()
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    found = F.try_element_at(table, code.cast("int"))
    return found if other is None else F.coalesce(found, F.lit(other))


def bits(word: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(word, low).bitwiseAND((1 << width) - 1)


def rgb_hex(colour: Column) -> Column:
    """RRGGBB of a 0x00BBGGRR colour."""
    part = lambda k: F.lpad(F.hex(bits(colour, k, 8).cast("long")), 2, "0")
    return F.concat(part(0), part(8), part(16))


def colour_hex(colour: Column) -> Column:
    """auto for 0 and for theme colours, a palette colour up to 16, else RRGGBB."""
    theme = colour.bitwiseAND(THEME_BIT) != 0
    return F.when((colour == 0) | theme, F.lit("auto")).when(colour.between(1, 16), named(colour, PALETTE)).otherwise(rgb_hex(colour))


def theme_name(colour: Column, names: list[str] = THEME_NAMES) -> Column:
    """The theme colour's name; null for other colours."""
    return F.when(colour.bitwiseAND(THEME_BIT) != 0, named(bits(colour, 0, 8), names))


def resolved_colour(colour: Column, theme_hex: Column, fallback: str = "000000") -> Column:
    """The theme's colour where there is one, else the literal one, the fallback for auto."""
    return F.coalesce(F.nullif(theme_hex, F.lit("")), F.nullif(colour_hex(colour), F.lit("auto")), F.lit(fallback))


def dttm(word: Column) -> Column:
    """A packed minute: minute 0-5, hour 6-10, day 11-15, month 16-19, year from 1900 20-28, each brought into its range; 0 has none."""
    year = F.least(F.lit(2100), bits(word, 20, 9).cast("int") + 1900)
    month = F.greatest(F.lit(1), F.least(F.lit(12), bits(word, 16, 4).cast("int")))
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    day = F.greatest(F.lit(1), F.least(last, bits(word, 11, 5).cast("int")))
    hour, minute = F.least(F.lit(23), bits(word, 6, 5).cast("int")), F.least(F.lit(59), bits(word, 0, 6).cast("int"))
    return F.when(word != 0, F.make_timestamp_ntz(year, month, day, hour, minute, F.lit(0)))


def rk_int(word: Column) -> Column:
    """The integer form of a packed number: 30 signed bits, divided by 100 where bit 0 says so; null for the float form."""
    value = F.shiftright(word.cast("int"), 2)
    return F.when(word.bitwiseAND(2) != 0, F.when(word.bitwiseAND(1) != 0, value / F.lit(100.0)).otherwise(value.cast("double")))


def number_format(code: Column, bullet_list: Column, level: Column) -> Column:
    return F.coalesce(named(code, NUMBER_FORMATS), F.when(bullet_list & (level == 0), F.lit("Bullet")).otherwise(F.lit("Decimal")))


def shading(code: Column) -> Column:
    return F.when(code == 0xFFFF, F.lit("nil")).otherwise(named(code, SHADINGS, "clear"))


def border_style(code: Column) -> Column:
    return F.coalesce(named(code, {k: n for k, n in enumerate(BORDERS) if n}), F.lit("Single"))


def border_token(style: Column) -> Column:
    """A border style's token: its name with a small first letter; dashed is dash."""
    return F.when(style == "Dashed", F.lit("dash")).otherwise(F.concat(F.lower(F.substring(style, 1, 1)), F.substr(style, F.lit(2))))


def alignment_token(code: Column) -> Column:
    return named(code, ALIGNMENTS, "left")


def underline_token(code: Column) -> Column:
    return named(code, UNDERLINES, "none")


def level_alignment(code: Column) -> Column:
    return named(code, LEVEL_ALIGNMENTS, "left")


def legacy_widths(widths: Column) -> Column:
    """Widths of a legacy table definition: one more on each that is positive, two more on the first."""
    return F.transform(widths, lambda w, i: F.when(w > 0, w + F.when(i == 0, 3).otherwise(1)).otherwise(w))


def number_at(data: Column, at: int, size: int) -> Column:
    """The little-endian number in bytes at (from 0) of binary data; null beyond its end."""
    digits = F.concat(*[F.hex(F.substring(data, at + k + 1, 1)) for k in reversed(range(size))])
    return F.when(F.octet_length(data) >= at + size, F.conv(digits, 16, 10).cast("long"))


def big_number_at(data: Column, at: int, size: int, signed: bool = False) -> Column:
    """The big-endian number in bytes at (from 0) of binary data, of up to seven bytes; null beyond its end."""
    value = F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")
    if signed:
        value = F.when(value >= 1 << 8 * size - 1, value - (1 << 8 * size)).otherwise(value)
    return F.when(F.octet_length(data) >= at + size, value)


def counted_text(data: Column, at: int, width: int, charset: str = "UTF-8") -> Column:
    """The text in binary data at, behind its length in bytes, a little-endian number of width bytes; a width of 1 makes a Pascal string."""
    return F.decode(F.substr(data, F.lit(at + width + 1), number_at(data, at, width).cast("int")), charset)


def file_time(ticks: Column) -> Column:
    """A time in ticks of a ten-millionth of a second since 1601, without zone; 0 has none."""
    return F.when(ticks != 0, F.timestamp_micros((ticks / 10).cast("long") - 11_644_473_600_000_000).cast("timestamp_ntz"))


def shading_operand(data: Column) -> Column:
    """struct<fore, back, pattern> of a shading: ten bytes of two colours and a pattern, a length of ten before them or not, else four of two palette colours; null if shorter."""

    def direct(at: int) -> Column:
        return F.struct(number_at(data, at, 4).alias("fore"), number_at(data, at + 4, 4).alias("back"), shading(number_at(data, at + 8, 2)).alias("pattern"))

    legacy = F.struct(number_at(data, 0, 2).alias("fore"), number_at(data, 2, 2).alias("back"), F.lit("clear").alias("pattern"))
    size = F.octet_length(data)
    return F.when((size == 11) & (number_at(data, 0, 1) == 10), direct(1)).when(size >= 10, direct(0)).when(size >= 4, legacy)


def highlight(code: Column) -> Column:
    return named(code, HIGHLIGHTS, "none")


def character_indent_twips(indent: Column, half_points: Column) -> Column:
    """|indent| hundredths of a character at a font size; size 24 where none is set."""
    size = F.when(half_points > 0, half_points).otherwise(24)
    return F.round(F.abs(indent) * size * 10 / 100).cast("int")


def clamped_twips(value: Column, low: int, high: int, fallback: int) -> Column:
    return F.when(value == 0, F.lit(fallback)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), value)))


def legacy_indent_hundredths(value: Column) -> Column:
    return F.signum(value).cast("int") * F.floor((F.abs(value) * 103 + 128) / 256).cast("int")


def line_hundredths_twips(value: Column) -> Column:
    return F.floor((value * 240 + 50) / 100).cast("int")


def border(word: Column, colour: Column) -> dict[str, Column]:
    """Width, style, palette, space and colour of a border; the direct colour wins unless it is 0 or white."""
    palette = bits(word, 16, 8)
    return {
        "width": bits(word, 0, 8),
        "style": bits(word, 8, 8),
        "palette": palette,
        "space": bits(word, 24, 5),
        "colour": F.when((colour != 0) & (colour != 0xFFFFFF), rgb_hex(colour)).otherwise(named(palette, PALETTE, "000000")),
    }


def _safe_id(name: Column, fallback: Column) -> Column:
    """A name as an id: what XML allows, without spaces; the fallback where nothing is left."""
    return F.coalesce(F.nullif(F.replace(xml_safe(F.coalesce(name, F.lit(""))), F.lit(" "), F.lit("")), F.lit("")), fallback)


def style_name(name: Column, fallback: Column) -> Column:
    """A style's name as XML may hold it, without white space at its ends; the fallback where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(xml_safe(F.coalesce(name, F.lit(""))), r"^[\s\x85\xA0]+|[\s\x85\xA0]+$", ""), F.lit("")), fallback)


def style_id(index: Column, name: Column) -> Column:
    """The id of a paragraph style: by index 0 to 9, by known name, by "heading n", else the name without spaces and what XML forbids."""
    low = F.lower(name)
    level = F.regexp_extract(low, r"^heading ([1-9])$", 1)
    return (
        F.when((index == 0) | (low == "normal"), F.lit("Normal"))
        .when(index.between(1, 9), F.concat(F.lit("Heading"), index.cast("string")))
        .when(low.isin("title", "subtitle", "quote", "header", "footer"), F.initcap(low))
        .when(low == "list paragraph", F.lit("ListParagraph"))
        .when(low == "no spacing", F.lit("NoSpacing"))
        .when(level != "", F.concat(F.lit("Heading"), level))
        .otherwise(_safe_id(name, F.concat(F.lit("Style"), index.cast("string"))))
    )


def table_style_id(index: Column, name: Column) -> Column:
    low, own = F.lower(name), _safe_id(name, F.concat(F.lit("TableGrid"), index.cast("string")))
    return F.when((index == 0) | (low == "normal table"), F.lit("TableNormal")).when((index == 1) | (low == "table grid"), F.lit("TableGrid")).otherwise(own)


def character_style_id(index: Column, name: Column) -> Column:
    own = _safe_id(name, F.concat(F.lit("CharStyle"), index.cast("string")))
    return F.when(F.lower(name) == "default paragraph font", F.lit("DefaultParagraphFont")).otherwise(own)


def resolved_target(source_dir: Column, target: Column) -> Column:
    """A relative target against a folder: "." and empty parts go, ".." takes back one part."""
    parts = F.when(F.startswith(target, F.lit("/")), F.split(target, "/")).otherwise(F.split(F.concat_ws("/", source_dir, target), "/"))
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def relationship_number(rid: Column) -> Column:
    """The number of an id like rId7; null for others."""
    return F.when(F.startswith(rid, F.lit("rId")), F.try_to_number(F.nullif(F.regexp_extract(rid, r"^rId([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int"))


def padded(values: Column, n: Column) -> Column:
    """An array brought to n items: zeros behind, or cut."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.try_element_at(values, i), F.lit(0.0)))).otherwise(F.array().cast("array<double>"))

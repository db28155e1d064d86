"""Text as Column expressions: cleaning, scoring, classes of script. A null text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of characters, as parts of a Java pattern.
CJK, KANA, HANGUL, CJK_MARKS = r"\u4E00-\u9FFF\u3400-\u4DBF", r"\u3040-\u30FF", r"\uAC00-\uD7AF", r"\u3000-\u303F"
MOJIBAKE, ENCLOSED, ARROWS = r"\u0B80-\u0BFF", r"\u24B6-\u24FF", r"\u27F0-\u27FF"
WIDE_CJK, WIDE_HANGUL, WIDE_KANA = r"\u4E00-\u9FFF\u3400-\u4DBF\uF900-\uFAFF", r"\uAC00-\uD7AF\u1100-\u11FF\u3130-\u318F", r"\u3040-\u30FF\u31F0-\u31FF"
#: Fixed value: visible characters that a header or a short text may have.
MOST_VISIBLE = 256


def bound(value: Column, body) -> Column:
    """body(value) with value evaluated once, and in code of its own."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(values: Column, block: int = 64) -> Column:
    """array<int>: for each of an array's numbers the sum of those before it.

    Sums grow within blocks, and blocks are joined at the end, so that appending never copies more than a block or the list of
    blocks: time grows in proportion to the array, up to millions of items.
    """

    def summed(v: Column) -> Column:
        def one(acc: Column, b: Column) -> Column:
            start = F.struct(acc["at"].alias("at"), F.array().cast("array<int>").alias("all"))
            items = F.sequence(b * block, F.least(F.size(v), (b + 1) * block) - 1)
            inner = F.aggregate(items, start, lambda a, k: F.struct((a["at"] + F.get(v, k)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))
            return bound(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["all"], F.array(x["all"])).alias("all")))

        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all"))
        return F.when(F.size(v) > 0, F.flatten(F.aggregate(blocks, start, one)["all"])).otherwise(F.array().cast("array<int>"))

    return bound(values.cast("array<int>"), summed)


def count_class(text: Column, inside: str) -> Column:
    """How many characters are in a class."""
    return F.regexp_count(text, F.lit(f"[{inside}]"))


def clean_controls(text: Column) -> Column:
    """Marks and controls go, except tabs; a vertical tab becomes a line feed, 1E a hyphen, A0 a space."""
    kept = F.regexp_replace(text, r"[\x00-\x08\x0A\x0C-\x1D\x1F\x7F-\x9F]", "")
    return F.translate(kept, "\x0b\x1e\xa0", "\n- ")


def clean_header(text: Column) -> Column:
    """Controls go, except 09 to 0D; a vertical tab becomes a line feed; white space at the ends goes.

    Codes below 09 and above 0D go before any of them could be replaced, so cell marks don't become tabs here.
    """
    return F.regexp_replace(F.translate(F.regexp_replace(text, r"[\x00-\x08\x0E-\x1F]", ""), "\x0b", "\n"), r"^[\s\x85\xA0]+|[\s\x85\xA0]+$", "")


def clean_textbox(text: Column) -> Column:
    """Marks go; a vertical tab becomes a line feed, a cell mark a tab, 1E a hyphen."""
    return F.translate(F.regexp_replace(text, r"[\x01\x13-\x15\x1F]", ""), "\x0b\x07\x1e", "\n\t-")


def xml_safe(text: Column) -> Column:
    """What XML allows; U+FFFD becomes a space. Strings here hold whole code points, so no halves of pairs."""
    return F.regexp_replace(F.translate(text, "\ufffd", " "), r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def comparison_key(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, r"[\s\x85\xA0]+", "")


def visible(text: Column) -> Column:
    """How many characters aren't white space."""
    return F.length(comparison_key(text))


def decode_quality(text: Column) -> Column:
    """How right a decoded text looks: letters and CJK count for it, replacement characters and what wrong decoding makes against it.

    Accented Latin letters are letters; of the accented range only the two signs in it lose by standing behind CJK. Characters
    beyond the basic plane count as the two UTF-16 units that they are.
    """
    cjk, kana, marks = count_class(text, CJK), count_class(text, KANA + HANGUL), count_class(text, CJK_MARKS)
    bad = count_class(text, "\\uFFFD")
    special = CJK + KANA + HANGUL + CJK_MARKS + "\\uFFFD"
    plain = F.regexp_count(text, F.lit(rf"[\p{{L}}\p{{Nd}} \t\r\n&&[^{special}]]"))
    odd = lambda c: F.regexp_count(text, F.lit(rf"[{c}&&[^\p{{L}}\p{{Nd}}]]"))
    other = F.regexp_count(text, F.lit(rf"[^\p{{L}}\p{{Nd}}\p{{Cc}} {special}{MOJIBAKE}{ENCLOSED}{ARROWS}]"))
    far = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}&&[^\p{L}\p{Nd}]]"))
    behind = F.regexp_replace(text, rf"(?s)^[^{CJK}{KANA}{HANGUL}]*", "")
    wide = 6 * cjk + 5 * kana + 4 * marks - 50 * bad + 2 * plain - 8 * odd(MOJIBAKE) - 5 * odd(ENCLOSED + ARROWS) + other + far - 4 * F.regexp_count(behind, F.lit("[×÷]"))
    # a text of Latin letters alone has neither of the rest
    letters, signs = F.regexp_count(text, F.lit(r"[\p{L}\p{Nd} \t\r\n]")), F.regexp_count(text, F.lit(r"[^\p{L}\p{Nd}\p{Cc} ]"))
    return F.when(F.rlike(text, F.lit(r"[^\x00-\xFF]")), wide).otherwise(2 * letters + signs)


def scripts(text: Column) -> dict[str, Column]:
    """Which scripts a text has, punctuation and white space left aside."""
    has = lambda c: F.rlike(text, F.lit(f"[{c}]"))
    known = r"A-Za-z0-9" + WIDE_CJK + WIDE_HANGUL + WIDE_KANA
    return {"latin": has("A-Za-z0-9"), "cjk": has(WIDE_CJK), "hangul": has(WIDE_HANGUL), "kana": has(WIDE_KANA), "other": F.rlike(text, F.lit(rf"[^\s\x85\xA0\p{{P}}{known}]"))}


def mixed_script_noise(text: Column) -> Column:
    """No Latin letter or digit, and Chinese beside Korean, or three scripts."""
    s = scripts(text)
    n = sum((s[k].cast("int") for k in ("cjk", "hangul", "kana", "other")), F.lit(0))
    return ~s["latin"] & ((s["cjk"] & s["hangul"]) | (n >= 3))


def usable(text: Column) -> Column:
    return visible(text).between(1, MOST_VISIBLE) & ~mixed_script_noise(text)


def east_asian(text: Column) -> Column:
    return F.rlike(text, F.lit(f"[{WIDE_CJK}{WIDE_HANGUL}{WIDE_KANA}]"))


def garbled(text: Column) -> Column:
    """Empty, or NULs for more than half of it."""
    return (F.length(text) == 0) | (2 * F.regexp_count(text, F.lit(r"\x00")) > F.length(text))


def tokens(text: Column) -> Column:
    """Text, tab, break and page-break tokens in order."""
    return F.regexp_extract_all(text, F.lit(r"[^\t\n\x0B\f]+|[\t\n\x0B\f]"), F.lit(0))


def level_text(text: Column) -> Column:
    """The code points 0 to 8 of a numbering level as %1 to %9."""
    for k in range(9):
        text = F.replace(text, F.lit(chr(k)), F.lit(f"%{k + 1}"))
    return text


def utf16_length(text: Column) -> Column:
    """The length in UTF-16 units, in which character positions count."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


#: Fixed value: the marks that stand in runs of their own.
SPECIAL = r"\x01\x08\x13\x14\x15"
#: Headings of articles, chapters and sections of a contract; headings that begin with a number.
ARTICLE, NUMBERED = r"^第[一二三四五六七八九十百0-9]+[条章节][：:、]", r"^(第[一二三四五六七八九十百0-9]+条[：:].*|[0-9]+\.[0-9].*)$"
#: The numbers of the heading styles, and of the title's.
HEADINGS, TITLE = (1, 9), 15


def special_parts(text: Column) -> Column:
    """The text cut so that each special mark stands alone."""
    return F.regexp_extract_all(text, F.lit(f"[{SPECIAL}]|[^{SPECIAL}]+"), F.lit(0))


def paragraph_type(text: Column, in_table: Column, nesting: Column) -> Column:
    """TableCell by a cell mark or by properties, PageBreak by a page break, else Normal."""
    cell = text.contains("\x07") | F.coalesce(in_table, F.lit(False)) | (F.coalesce(nesting, F.lit(0)) > 0)
    return F.when(cell, F.lit("TableCell")).when(text.contains("\x0c"), F.lit("PageBreak")).otherwise(F.lit("Normal"))


def is_heading(style: Column, name: Column) -> Column:
    """Whether a paragraph is a heading or title, by the number of its style or by its name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (style == TITLE) | style.between(*HEADINGS) | F.startswith(low, F.lit("heading")) | (low == "title")


def flat_table_paragraph(kind: Column, text: Column) -> Column:
    return (kind == "TableCell") & F.coalesce(text.contains("\x07"), F.lit(False))


def article_heading(text: Column) -> Column:
    return F.rlike(text, F.lit(ARTICLE))


def nested_title(text: Column) -> Column:
    """Whether a title announces a nested table."""
    return F.contains(text, F.lit("嵌套")) | F.contains(F.lower(text), F.lit("nested"))


def splittable(picture: Column, field: Column, embedded: Column, text: Column, size: Column) -> Column:
    """Whether a run may be cut: of text alone, as long as the positions that it covers."""
    return ~picture & ~field & ~embedded & (size > 0) & (utf16_length(text) == size)


def narrative_indent(heading_before: Column, normal: Column, listed: Column, indents: Column, text: Column) -> Column:
    """Whether a paragraph gets the indent of narrative text: behind a heading, normal, no list, no indent of its own, long enough."""
    body = F.regexp_replace(text, r"^[\s\x85\xA0]+|[\s\x85\xA0]+$", "")
    words = F.size(F.array_remove(F.split(body, "[ \t]"), ""))
    return heading_before & normal & ~listed & (indents == 0) & (F.length(body) >= 60) & (words >= 8)


def east_asian_font(font: Column, text: Column, language: Column, minor: Column, major: Column) -> Column:
    """The font of a run: its own, else for East Asian text (or language 0804) the theme's, else SimSun; null where none is wanted."""
    wanted = east_asian(text) | (language == 0x0804)
    return F.coalesce(F.nullif(font, F.lit("")), F.when(wanted, F.coalesce(minor, major, F.lit("SimSun"))))


def message(level: Column, text: Column, kind: Column, detail: Column, at: Column | None = None) -> Column:
    """A diagnostic as a line: time if given, level, text; the kind and detail of an exception on a line of their own."""
    head = F.concat(F.lit("["), F.upper(level), F.lit("] "), text)
    if at is not None:
        head = F.concat(F.lit("["), F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("] "), head)
    return F.when(kind.isNull(), head).otherwise(F.concat(head, F.lit("\n  Exception: "), kind, F.lit(": "), F.coalesce(detail, F.lit(""))))

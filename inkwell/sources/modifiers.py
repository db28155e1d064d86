"""What runs of property modifiers say about characters, paragraphs, table rows and sections.

An opcode is looked up whole first, then, in the groups of its target, by its nine low bits. Of a property given twice the last value
holds; opcodes without a rule are left aside. Values are numbers: flags 0 or 1; a border makes four, a shading three.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from inkwell.sources.structures import modifiers

Values = dict[str, int]
_Apply = Callable[[Values, str, int, bytes], None]


def _number(operand: bytes, size: int, signed: bool = False) -> int:
    return int.from_bytes(operand[:size], "little", signed=signed)


def _flag(out: Values, name: str, value: int, operand: bytes) -> None:
    out[name] = int(value != 0)


def _explicit_flag(out: Values, name: str, value: int, operand: bytes) -> None:
    out[name], out[f"explicit_{name}"] = int(value != 0), 1


def _byte(out: Values, name: str, value: int, operand: bytes) -> None:
    out[name] = value & 0xFF


def _word(out: Values, name: str, value: int, operand: bytes) -> None:
    out[name] = value & 0xFFFF


def _signed(out: Values, name: str, value: int, operand: bytes) -> None:
    out[name] = (value & 0xFFFF ^ 0x8000) - 0x8000


def _long(out: Values, name: str, value: int, operand: bytes) -> None:
    out[name] = value & 0xFFFF_FFFF


def _underline(out: Values, name: str, value: int, operand: bytes) -> None:
    out["underline"], out["underlined"] = value & 0xFF, int(value & 0xFF != 0)


def _raised(out: Values, name: str, value: int, operand: bytes) -> None:
    out["superscript"], out["subscript"] = int(value == 1), int(value == 2)


def _rgb(out: Values, name: str, value: int, operand: bytes) -> None:
    out["rgb"], out["has_rgb"] = value & 0xFFFF_FFFF, 1


def _lines(name: str) -> _Apply:
    def apply(out: Values, _: str, value: int, operand: bytes) -> None:
        _signed(out, f"lines_{name}", value, operand)
        out[f"space_{name}"] = 0

    return apply


def _line_spacing(out: Values, name: str, value: int, operand: bytes) -> None:
    _signed(out, "line", value, operand)
    out["line_multiple"], out["explicit_line"] = value >> 16 & 1, 1


def _first_line_chars(out: Values, name: str, value: int, operand: bytes) -> None:
    v = (value & 0xFFFF ^ 0x8000) - 0x8000
    size = (abs(v) * 103 + 128) // 256
    out["first_line_chars"] = -size if v < 0 else size


def border(word: int, colour: int | None = None) -> Values:
    """style, width, space, colour of a border word; a direct colour wins unless it is 0 or white."""
    direct = (colour or 0) & 0xFF_FFFF
    return {"style": word >> 8 & 0xFF, "width": word & 0xFF, "space": word >> 24 & 0x1F, "colour": direct if direct not in (0, 0xFF_FFFF) else word >> 16 & 0xFF}


def _put(out: Values, name: str, one: Values) -> None:
    out.update({f"{name}_{k}": v for k, v in one.items()})


def _border(out: Values, name: str, value: int, operand: bytes) -> None:
    _put(out, name, border(value & 0xFFFF_FFFF))


def _character_border(out: Values, name: str, value: int, operand: bytes) -> None:
    if len(operand) >= 4:
        one = border(_number(operand, 4))
        if not one["style"] and len(operand) >= 8:
            one = border(_number(operand[-4:], 4))
        _put(out, name, one)


def _paragraph_border(out: Values, name: str, value: int, operand: bytes) -> None:
    if len(operand) >= 8 and (operand[:4] != bytes(4) or any(operand[4:7])):
        direct = _number(operand, 4) & 0xFF_FFFF
        _put(out, name, {"style": operand[5], "width": operand[4], "space": operand[6], "colour": 0 if direct == 0xFF_FFFF else direct})


def shading(operand: bytes) -> Values:
    """fore, back, pattern of a shading: ten bytes of two colours and a pattern, a length of ten before them or not, else four of two palette colours (pattern 0)."""
    at = 1 if len(operand) == 11 and operand[0] == 10 else 0
    if len(operand) >= at + 10:
        return dict(zip(("fore", "back", "pattern"), struct.unpack_from("<IIH", operand, at), strict=True))
    return dict(zip(("fore", "back"), struct.unpack_from("<HH", operand, at), strict=True)) | {"pattern": 0} if len(operand) >= at + 4 else {}


def _shading(out: Values, name: str, value: int, operand: bytes) -> None:
    _put(out, name, shading(operand))


def _east_asian(out: Values, name: str, value: int, operand: bytes) -> None:
    if len(operand) >= 2:
        layout = _number(operand, 2)
        out["east_asian_layout"], out["vertical"] = layout & 0xFF, int(layout != 0)
        if len(operand) >= 3:
            out["vertical_compressed"] = int(operand[2] & 0x10 != 0)


def _nothing(out: Values, name: str, value: int, operand: bytes) -> None:
    """Known, and without meaning here."""


def _channels(colour: int) -> int:
    return sum(colour >> shift & 0xFF != 0 for shift in (0, 8, 16))


def extended_border(operand: bytes) -> Values | None:
    """The likeliest border of an operand whose layout isn't known: of all pairs of words at even places, taken either way round, the one of most signs of
    one (a style, a width, colour channels, a colour that isn't just a tinge). A colour of one channel gives way to a richer one among the bytes."""
    best, top = None, -1
    for at in range(0, len(operand) - 7, 2):
        a, b = struct.unpack_from("<II", operand, at)
        for one in (border(b, a), border(a, b)):
            colour = one["colour"] & 0xFF_FFFF
            score = 100 + 10 * (one["width"] > 0) + 5 * _channels(one["colour"]) + 20 * (colour not in (0, 0x59))
            if one["style"] and score > top:
                best, top = one, score
    if best and _channels(best["colour"] & 0xFF_FFFF) == 1:
        triples = [t for t in zip(operand, operand[1:], operand[2:], strict=False) if all(t)]
        rated = [({1: 0, 2: 2, 3: 3}[len(set(t))] - 2 * (0xFF in t) - (min(t) < 0x20), t) for t in triples]
        score, rich = max(rated, key=lambda x: x[0], default=(0, ()))
        if score >= 2:
            best = best | {"colour": int.from_bytes(bytes(rich), "little")}
    return best


#: The modifiers of characters by whole opcode.
CHARACTER: dict[int, tuple[str, _Apply]] = {
    0x6A03: ("picture", _long), 0x0800: ("deleted", _flag), 0x0801: ("inserted", _flag), 0x4804: ("insert_author", _word), 0x6805: ("insert_date", _long),
    0x4863: ("delete_author", _word), 0x6864: ("delete_date", _long), 0x0835: ("bold", _flag), 0x0836: ("italic", _explicit_flag), 0x0837: ("strike", _flag),
    0x0838: ("outline", _flag), 0x0839: ("shadow", _flag), 0x083A: ("small_caps", _flag), 0x083B: ("caps", _flag), 0x083C: ("hidden", _flag), 0x0854: ("imprint", _flag),
    0x0858: ("emboss", _flag), 0x085C: ("bold_cs", _flag), 0x085D: ("italic_cs", _explicit_flag), 0x2A0C: ("highlight", _byte), 0x2A3E: ("", _underline),
    0x2A42: ("colour_index", _byte), 0x2A48: ("", _raised), 0x2A53: ("double_strike", _flag), 0x6865: ("border", _border), 0xCA72: ("border", _character_border),
    0xCA78: ("", _east_asian), 0x4845: ("position", _signed), 0x484B: ("kerning", _signed), 0x4852: ("scale", _word), 0x4A43: ("size", _byte), 0x4A61: ("size_cs", _byte),
    0x4A4F: ("font", _signed), 0x4A50: ("font", _signed), 0x4A51: ("font", _signed), 0x4A5E: ("font_cs", _signed), 0x4A30: ("style", _word), 0x6870: ("", _rgb),
    **{code: ("language", _word) for code in (0x485F, 0x486D, 0x486E, 0x4873, 0x4874)},
    **{code: ("", _nothing) for code in (0x0802, 0x0806, 0x080A, 0x0811, 0x0818, 0x0855, 0x0856, 0x085A, 0x0875, 0x0882, 0x4807, 0x4867, 0x6A09, 0xC81A, 0xCA57, 0xCA62, 0xCA89, 0x6815, 0x6816, 0x6817)},
}
#: The modifiers of characters by their nine low bits, of two generations.
CHARACTER_LOW: dict[int, tuple[str, _Apply]] = {
    0x35: ("bold", _flag), 0x36: ("italic", _explicit_flag), 0x37: ("strike", _flag), 0x38: ("outline", _flag), 0x39: ("shadow", _flag), 0x3A: ("small_caps", _flag),
    0x3B: ("caps", _flag), 0x3C: ("hidden", _flag), 0x3E: ("underline", _byte), 0x43: ("size", _byte), 0x45: ("position", _signed), 0x4B: ("kerning", _signed),
    0x4F: ("font", _signed), 0x5C: ("bold_cs", _flag), 0x5D: ("italic_cs", _explicit_flag), 0x61: ("size_cs", _byte), 0x70: ("", _rgb), 0x42: ("colour_index", _byte),
    0x0C: ("highlight", _byte), 0x5E: ("font_cs", _signed),
    0x02: ("bold", _flag), 0x03: ("italic", _explicit_flag), 0x04: ("strike", _flag), 0x05: ("underlined", _flag), 0x06: ("outline", _flag), 0x07: ("small_caps", _flag),
    0x08: ("caps", _flag), 0x09: ("hidden", _flag), 0x0A: ("font", _signed), 0x0B: ("underline", _byte), 0x0D: ("position", _signed), 0x0E: ("scale", _word),
    0x11: ("colour_index", _byte), 0x12: ("size", _byte), 0x13: ("highlight", _byte), 0x16: ("shadow", _flag), 0x17: ("emboss", _flag), 0x18: ("imprint", _flag),
    0x2E: ("font_cs", _signed), 0x30: ("size_cs", _byte), 0x31: ("bold_cs", _flag), 0x32: ("italic_cs", _flag), 0x40: ("", _raised), 0x41: ("double_strike", _flag),
    0x44: ("spacing", _long),
}
#: The modifiers of paragraphs, by whole opcode and by low bits.
PARAGRAPH: dict[int, tuple[str, _Apply]] = {
    0x2403: ("justify", _byte), 0x2461: ("justify", _byte), 0x2405: ("keep", _flag), 0x2406: ("keep_next", _flag), 0x2407: ("page_break", _flag), 0x840E: ("right", _signed),
    0x840F: ("left", _signed), 0x8411: ("first_line", _signed), 0x4458: ("", _lines("before")), 0x4459: ("", _lines("after")), 0x442D: ("", _first_line_chars),
    0x6467: ("", _nothing), 0xC64D: ("shading", _shading), 0x2600: ("first_line_chars", _byte), 0x2601: ("left_chars", _byte), 0x2602: ("right_chars", _byte),
    0x6424: ("border_top", _border), 0x6425: ("border_left", _border), 0x6426: ("border_bottom", _border), 0x6427: ("border_right", _border),
    0xC64E: ("border_top", _paragraph_border), 0xC64F: ("border_left", _paragraph_border), 0xC650: ("border_bottom", _paragraph_border), 0xC651: ("border_right", _paragraph_border),
}
PARAGRAPH_LOW: dict[int, tuple[str, _Apply]] = {
    0x00: ("style", _word), 0x02: ("style", _word), 0x05: ("page_break", _flag), 0x0A: ("level", _byte), 0x0B: ("list", _signed), 0x0C: ("shading", _shading), 0x0E: ("right", _signed),
    0x0F: ("left", _signed), 0x11: ("first_line", _signed), 0x12: ("", _line_spacing), 0x13: ("space_before", _signed), 0x14: ("space_after", _signed), 0x16: ("in_table", _flag),
    0x40: ("outline_level", _byte), 0x49: ("nesting", _signed),
}


def _gap(out: Values, name: str, value: int, operand: bytes) -> None:
    _signed(out, "gap_half", value, operand)
    if not out.get("spacing"):
        out["spacing"] = 2 * out["gap_half"]


def _height(always: bool) -> _Apply:
    def apply(out: Values, _: str, value: int, operand: bytes) -> None:
        v = (value & 0xFFFF ^ 0x8000) - 0x8000
        if v or not always:
            out["height"] = abs(v)
        if v < 0 or (always and v):
            out["exact"] = 1

    return apply


_SIDES = ("top", "left", "bottom", "right", "inside_h", "inside_v")


def _six_borders(out: Values, name: str, value: int, operand: bytes) -> None:
    if len(operand) >= 24:
        step = 8 if len(operand) >= 48 and len(operand) % 8 == 0 else 4
        for k, side in enumerate(_SIDES):
            colour = _number(operand[step * k + 4 : step * k + 8], 4) if step == 8 else None
            _put(out, f"border_{side}", border(_number(operand[step * k : step * k + 4], 4), colour))


def _six_colours_first(out: Values, name: str, value: int, operand: bytes) -> None:
    if len(operand) >= 48:
        for k, side in enumerate(_SIDES):
            _put(out, f"border_{side}", border(_number(operand[8 * k + 4 : 8 * k + 8], 4), _number(operand[8 * k : 8 * k + 4], 4)))


def _guessed_border(out: Values, name: str, value: int, operand: bytes) -> None:
    if found := extended_border(operand):
        _put(out, "border_top", found)


def _overlap(out: Values, name: str, value: int, operand: bytes) -> None:
    out["overlap"] = int(value == 0)


#: The modifiers of table rows, by whole opcode and by low bits; those of sections by low bits.
TABLE: dict[int, tuple[str, _Apply]] = {
    0x940E: ("x", _signed), 0x940F: ("y", _signed), 0x9410: ("from_left", _signed), 0x9411: ("from_top", _signed), 0x941E: ("from_right", _signed), 0x941F: ("from_bottom", _signed),
    0x3465: ("", _overlap), 0x3466: ("cant_split", _flag), 0xD612: ("", _guessed_border), 0xD613: ("", _six_colours_first),
}
TABLE_LOW: dict[int, tuple[str, _Apply]] = {
    0x01: ("indent", _signed), 0x02: ("", _gap), 0x03: ("cant_split", _flag), 0x04: ("header", _flag), 0x05: ("", _six_borders), 0x06: ("justify", _byte), 0x07: ("", _height(True)),
    0x0D: ("shading", _shading), 0x10: ("", _height(False)), 0x11: ("exact", _flag), 0x13: ("spacing", _signed), 0x14: ("width", _signed),
}
SECTION_LOW: dict[int, tuple[str, _Apply]] = {
    0x00: ("break_code", _byte), 0x01: ("title_page", _flag), 0x03: ("column_gap", _signed), 0x0F: ("page_width", _signed), 0x10: ("page_height", _signed), 0x11: ("left", _signed),
    0x12: ("right", _signed), 0x13: ("top", _signed), 0x14: ("bottom", _signed), 0x15: ("header", _signed), 0x16: ("footer", _signed), 0x17: ("gutter", _signed),
    0x2A: ("vertical", _byte), 0x31: ("grid_pitch", _signed), 0x02: ("columns", lambda out, name, value, operand: out.__setitem__("columns", value + 1)),
}
#: The definition of a table row's cells, borders of single cells, the bytes of a cell's descriptor.
DEFINITION, CELL_BORDERS, DESCRIPTOR = 0x08, {0x5603: "top", 0x5604: "left", 0x5605: "bottom", 0x5606: "right"}, 20


def _applied(data: bytes, full: dict, low: dict, allowed: Callable[[int, int], bool]) -> Values:
    out: Values = {}
    for code, operand in modifiers(data):
        rule = full.get(code) or (low.get(code & 0x1FF) if allowed(code, code >> 10 & 7) else None)
        if rule:
            rule[1](out, rule[0], _number(operand, 4), operand)
    return out


def character(data: bytes) -> Values:
    return _applied(data, CHARACTER, CHARACTER_LOW, lambda _, group: group in (1, 2))


def paragraph(data: bytes) -> Values:
    return _applied(data, PARAGRAPH, PARAGRAPH_LOW, lambda code, group: group in (1, 2) or code in (0x6649, 0x2416))


def section(data: bytes) -> Values:
    return _applied(data, {}, SECTION_LOW, lambda _, group: group == 4)


def table(data: bytes) -> tuple[Values, list[dict]]:
    """A row's properties, and its cells: width, merges (bits: first and merged sideways, first and merged downwards), borders by side."""
    out: Values = {}
    cells: list[dict] = []
    for code, operand in modifiers(data):
        if code >> 10 & 7 not in (3, 5):
            continue
        if code in CELL_BORDERS and len(operand) >= 6:
            first, end = operand[0], max(operand[1], operand[0] + 1)
            one = border(_number(operand[2:], 4), _number(operand[6:], 4) if len(operand) >= 10 else None)
            cells += [{"width": 0, "merges": 0, "borders": {}} for _ in range(end - len(cells))]
            for k in range(first, end):
                cells[k]["borders"][CELL_BORDERS[code]] = one
        elif code in TABLE:
            TABLE[code][1](out, TABLE[code][0], _number(operand, 4), operand)
        elif code & 0x1FF == DEFINITION:
            cells = _definition(operand) or cells
        elif code & 0x1FF in TABLE_LOW:
            name, apply = TABLE_LOW[code & 0x1FF]
            apply(out, name, _number(operand, 4), operand)
    return out, cells


def _definition(operand: bytes) -> list[dict]:
    """The cells of a definition: their number in the first byte, or in the second of a legacy one, their boundaries, their descriptors as far as they go."""
    head = 1 if operand[:1] != b"\0" else 2
    n = operand[head - 1] if len(operand) >= head else 0
    if not n or len(operand) < head + 2 * (n + 1):
        return []
    places = struct.unpack_from(f"<{n + 1}h", operand, head)
    widths = [abs(b - a) for a, b in zip(places, places[1:], strict=False)]
    if head == 2:
        widths = [w + (3 if k == 0 else 1) if w > 0 else w for k, w in enumerate(widths)]
    out = [{"width": w, "merges": 0, "borders": {}} for w in widths]
    at = head + 2 * (n + 1)
    for cell in out:
        if at + 2 > len(operand):
            break
        cell["merges"] = _number(operand[at:], 2) & 0xF
        if at + DESCRIPTOR > len(operand):
            at += 2
            continue
        for k, side in enumerate(("top", "left", "bottom", "right")):
            one = border(_number(operand[at + 4 + 4 * k :], 4))
            if one["style"]:
                cell["borders"][side] = one
        at += DESCRIPTOR
    return out

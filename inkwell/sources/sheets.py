"""Style sheets, fonts and numbering of a binary word file. What can't be read is left out, with a warning; defaults fill what files leave out."""

from __future__ import annotations

import struct

from inkwell.functions.formats import NUMBER_FORMATS
from inkwell.operators.properties import DEFAULT_FONTS
from inkwell.sources import modifiers
from inkwell.sources.structures import Warned, inside

#: Kinds of styles by code, names of built-in styles by number, no style, the largest entry of a sheet.
KINDS = {1: "paragraph", 2: "character", 3: "table", 4: "numbering"}
BUILT_IN = {0: "Normal", 1: "Normal", **{k + 1: f"heading {k}" for k in range(1, 10)}, 15: "Title", 16: "Subtitle", 29: "Header", 30: "Footer"}
NONE, MOST_ENTRY = 0xFFF, 0x4000
#: What of a style's property blocks comes in which order.
BLOCKS = {"paragraph": ("paragraph", "character"), "character": ("character",), "table": ("table", "paragraph", "character")}
LEVELS, MOST_LISTS, LISTS_IF_ODD = 9, 1000, 64


def _word(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 2], "little")


def _style(data: bytes, at: int, end: int, index: int, base: int) -> dict | None:
    """The style that begins at, after its length; None for one without meaning."""
    sti, kind, blocks = _word(data, at) & 0xFFF, _word(data, at + 2), _word(data, at + 4)
    flags = _word(data, at + 8)
    place = min(end, at + max(10, base))
    name = ""
    if place + 2 <= end:
        n = min(256, _word(data, place))
        raw = data[place + 2 : min(end, place + 2 + 2 * n)]
        name = raw.decode("utf-16-le", "replace").rstrip("\0")
        place += 2 + len(raw)
        if len(raw) == 2 * n and place + 2 <= end and not _word(data, place):
            place += 2
    out = {
        "style_id": index, "sti": sti, "kind": KINDS.get(kind & 0xF, "paragraph"), "name": name if name.strip() else BUILT_IN.get(sti, f"Style{index}"),
        "based_on": kind >> 4 if kind >> 4 < NONE else None, "next": blocks >> 4 if blocks >> 4 < NONE else None, "hidden": bool(flags & 2), "n_blocks": blocks & 0xF,
        "paragraph": {}, "character": {}, "table": {},
    }
    for k in range(blocks & 0xF):
        if place + 2 > end:
            break
        size = _word(data, place)
        place += 2
        if not size:
            continue
        if place + size > end:
            break
        which = BLOCKS.get(out["kind"], ())
        if k < len(which):
            out[which[k]] = _block(which[k], data[place : place + size], out["kind"], index)
        place += size + size % 2
    return out


def _block(which: str, body: bytes, kind: str, index: int) -> dict:
    """The properties of a block. Paragraph blocks, and those of tables behind the first, begin with a style's number, if that is the style's own or what follows it reads better."""
    if which == "table":
        return modifiers.table(body)[0]
    read = modifiers.paragraph if which == "paragraph" else modifiers.character
    if kind == "character" or len(body) <= 2:
        return read(body)
    if which == "paragraph" and _word(body, 0) == index:
        return read(body[2:])
    whole, rest = read(body), read(body[2:])
    return rest if kind == "table" or len(rest) >= len(whole) else whole


def style_sheet(data: bytes, at: int, size: int) -> Warned:
    """The styles of a sheet; of two with one number and kind the last. An entry that can't be read is stepped over by its length."""
    if not size:
        return Warned([], [])
    if not inside(data, at, size) or size < 12:
        return Warned([], [f"style sheet {at}+{size} lies outside of {len(data)} bytes"])
    end, head = at + size, _word(data, at)
    count, base = _word(data, at + 2), _word(data, at + 4)
    place = max(at + 2 + head, at + 6)
    if count & 0x8000:
        count, place = count & 0x7FFF | _word(data, at + 6) << 15, max(place, at + 8)
    found: dict[tuple[int, str], dict] = {}
    warnings = []
    for k in range(count):
        if place + 2 > end:
            break
        n = _word(data, place)
        if n > MOST_ENTRY or place + 2 + n > end:
            warnings.append(f"style {k} is cut short")
            if place + 2 + n > end:
                break
        elif n >= 10:
            style = _style(data, place + 2, place + 2 + n, k, base)
            found.pop((k, style["kind"]), None)
            found[k, style["kind"]] = style
        elif n:
            warnings.append(f"style {k} has no base")
        place += 2 + n
    return Warned(list(found.values()), warnings)


def fonts(data: bytes, at: int, size: int) -> Warned:
    """idx, name, other name, family, charset, pitch, scalable of a font table; the default fonts where there is none."""
    plain = [{"idx": k, "name": n, "other": None, "family": k if k < 4 else 1, "charset": 1, "pitch": 2, "scalable": False} for k, n in enumerate(DEFAULT_FONTS)]
    if not at or not size:
        return Warned(plain, [])
    if not inside(data, at, size):
        return Warned(plain, [f"font table {at}+{size} lies outside of {len(data)} bytes"])
    end, wide = at + size, _word(data, at) == 0xFFFF
    count, place = (_word(data, at + 2), at + 6) if wide else (_word(data, at), at + 4)
    out = []
    for k in range(count):
        if place >= end:
            break
        n = data[place] + 1
        entry = data[place : place + n]
        place += n
        if n < 40 or len(entry) < n:
            continue
        names = entry[40 : 40 + (n - 40) // 2 * 2].decode("utf-16-le", "replace")
        pick = lambda i: names[i:].split("\0", 1)[0] if i < len(names) else ""
        packed = entry[1]
        out.append({"idx": k, "name": pick(0) or f"Font{k}", "other": (pick(entry[5]) or None) if entry[5] else None, "family": packed >> 4 & 7, "charset": entry[4], "pitch": packed & 3, "scalable": bool(packed & 4)})
    return Warned(out, [])


def number_format(code: int, bullets: bool, level: int) -> str:
    return NUMBER_FORMATS.get(code) or ("Bullet" if bullets and level == 0 else "Decimal")


def _level_text(raw: bytes) -> str:
    return "".join(f"%{ord(c) + 1}" if ord(c) < LEVELS else c for c in raw.decode("utf-16-le", "replace"))


def _level(data: bytes, at: int, end: int, level: int, bullets: bool) -> tuple[dict, int]:
    """A level's format that begins at, and where it ends."""
    start, code, align = struct.unpack_from("<iBB", data, at)
    chpx, papx = data[at + 24], data[at + 25]
    place = at + 28
    out = {"level": level, "start_at": start, "format": number_format(code, bullets, level), "align": align & 3, "text": "", "paragraph": {}, "character": {}}
    if papx and place + papx <= end:
        out["paragraph"] = modifiers.paragraph(data[place : place + papx])
        place += papx
    if chpx and place + chpx <= end:
        out["character"] = modifiers.character(data[place : place + chpx])
        place += chpx
    if place + 2 <= end:
        n = _word(data, place)
        place += 2
        if 0 < n < 256 and place + 2 * n <= end:
            out["text"] = _level_text(data[place : place + 2 * n])
            place += 2 * n
    return out, place


def _filled_level(level: dict) -> dict:
    """A level with a text and an indent."""
    k = level["level"]
    return level | {"text": level["text"] or ("·" if level["format"] == "Bullet" else f"%{k + 1}"), "indent": level["paragraph"].get("left") or 720 * (k + 1)}


def _default_level(k: int, bullets: bool) -> dict:
    kind = "Bullet" if bullets else "Decimal"
    return _filled_level({"level": k, "start_at": 1, "format": kind, "align": 0, "text": "", "paragraph": {}, "character": {}})


def lists(data: bytes, at: int, size: int) -> Warned:
    """list_id, kind, levels (nine) of the lists of a table: their heads first, then their levels' formats. Simple lists have one level of their own."""
    if not size:
        return Warned([], [])
    if not inside(data, at, size) or size < 2:
        return Warned([], [f"list table {at}+{size} lies outside of {len(data)} bytes"])
    end, n = at + size, _word(data, at)
    if not 0 < n <= max(MOST_LISTS, (size - 2) // 56):  # more only where each can have its head and a level
        n = LISTS_IF_ODD
    heads, place = [], at + 2
    while len(heads) < n and place + 28 <= end:
        heads.append((int.from_bytes(data[place : place + 4], "little", signed=True), _word(data, place + 26) & 3))
        place += 28
    out, warnings = [], []
    for list_id, kind in heads:
        if not list_id:
            continue
        levels = []
        for k in range(1 if kind == 0 else LEVELS):
            if place + 28 > end:
                warnings.append(f"list {list_id} lacks level {k}")
                break
            level, place = _level(data, place, end, k, kind == 2)
            levels.append(_filled_level(level))
        levels += [_default_level(k, kind == 2) for k in range(len(levels), LEVELS)]
        out.append({"list_id": list_id, "kind": kind, "levels": levels})
    return Warned(out, warnings)


def overrides(data: bytes, at: int, size: int, known: list[dict]) -> Warned:
    """override_id, list_id, levels (level, start_at, has_start, has_format, format, text) of the overrides of lists. A list that isn't known gives way to the one of the same place."""
    if not at or size < 4:
        return Warned([], [])
    if not inside(data, at, size):
        return Warned([], [f"override table {at}+{size} lies outside of {len(data)} bytes"])
    end, n = at + size, int.from_bytes(data[at : at + 4], "little", signed=True)
    if n <= 0 or at + 4 + 16 * n > end:
        return Warned([], [f"override table of {n} entries in {size} bytes"] if n > 0 else [])
    kinds = {x["list_id"]: x["kind"] for x in known}
    heads = []
    for k in range(n):
        list_id, count = struct.unpack_from("<i8xB", data, at + 4 + 16 * k)
        if list_id <= 0 or list_id not in kinds:
            list_id = known[k]["list_id"] if k < len(known) else 0
        heads.append((k + 1, list_id, count))
    out, warnings, place = [], [], at + 4 + 16 * n
    for override_id, list_id, count in heads:
        levels = []
        for _ in range(count):
            if place + 8 > end:
                break
            start, flags = struct.unpack_from("<iB", data, place)
            place += 8
            one = {"level": flags & 0xF, "start_at": start if flags & 0x10 and start > 0 else 0, "has_start": bool(flags & 0x10) and start > 0, "has_format": False, "format": None, "text": None}
            if flags & 0x20:
                if place + 28 > end:
                    warnings.append(f"override {override_id} is cut short at level {flags & 0xF}")
                    place = end
                else:
                    level, place = _level(data, place, end, flags & 0xF, kinds.get(list_id) == 2)
                    one |= {"has_format": True, "format": level["format"], "text": level["text"]}
            if one["has_start"] or one["has_format"]:
                levels.append(one)
        if list_id > 0:
            out.append({"override_id": override_id, "list_id": list_id, "levels": levels})
    return Warned(out, warnings)

"""What stands beside the body of a binary word file: sections, notes, comments, headers, textboxes, anchors, flags, and the property groups of pieces."""

from __future__ import annotations

import struct

from inkwell.sources import modifiers
from inkwell.sources.structures import Warned, inside, plc

#: The flags of a document by bit, in two words.
FLAGS = (
    ("widow_control", 0, 1), ("paginated", 0, 2), ("facing_pages", 0, 3), ("breaks", 0, 4), ("auto_hyphenate", 0, 5), ("hyphenate", 0, 6), ("east_asian_layout", 0, 7),
    ("layout_like_95", 0, 8), ("print_body_first", 0, 9), ("suppress_bottom_spacing", 0, 10), ("wrap_auto", 0, 11), ("print_paper_first", 0, 12), ("suppress_spacings", 0, 13),
    ("mirror_margins", 0, 14), ("printer_metrics", 1, 0), ("no_paragraph_gap", 1, 1), ("shrink_to_fit", 1, 2), ("print_forms_data", 1, 3), ("position_on_only", 1, 4),
    ("display_background", 1, 5), ("display_line_numbers", 1, 6), ("print_micros", 1, 7), ("save_forms_data", 1, 8), ("display_column_break", 1, 9), ("display_page_end", 1, 10),
    ("display_units", 1, 11), ("protect_forms", 1, 12), ("protect_sparse", 1, 13), ("consecutive_hyphens", 1, 14), ("letter_final", 1, 15),
)
NO_PROPERTIES = 0xFFFF_FFFF
ANCHOR = 26


def sections(table: bytes, at: int, size: int, main: bytes) -> Warned:
    """section, start_cp, end_cp, properties of the sections; one whose properties can't be read has none."""
    if not size:
        return Warned([], [])
    found = plc(table, at, size, 12)
    out, warnings = [], list(found.warnings)
    for k, (begin, end, raw) in enumerate(found.value):
        place, values = int.from_bytes(raw[2:6], "little"), {}
        if place != NO_PROPERTIES:
            n = int.from_bytes(main[place : place + 2], "little")
            if inside(main, place, 2 + n):
                values = modifiers.section(main[place + 2 : place + 2 + n])
            else:
                warnings.append(f"section {k}: properties at {place} lie outside of {len(main)} bytes")
        out.append({"section": k, "start_cp": begin, "end_cp": end, "properties": values})
    return Warned(out, warnings)


def notes(table: bytes, at: int, size: int, kind: str) -> Warned:
    """kind, idx, cp, size of notes, within their story; empty ones left out."""
    found = plc(table, at, size, 2) if size >= 10 else Warned([], [])
    return Warned([{"kind": kind, "idx": k + 1, "cp": a, "size": b - a} for k, (a, b, _) in enumerate(found.value) if b > a], found.warnings)


def comments(table: bytes, refs: tuple[int, int], texts: tuple[int, int], authors: list[str], starts: tuple[int, int], ends: tuple[int, int]) -> Warned:
    """idx, cp, start_cp, end_cp, text_cp, size, date (packed), author of comments: their places in the body and their texts in their story."""
    n = texts[1] // 4 - 1
    if texts[1] < 8 or texts[1] % 4 or not inside(table, *texts):
        return Warned([], ["comment texts are no list of positions"] if texts[1] else [])
    step = (refs[1] - 4 * (n + 1)) // n
    if step < 10 or not inside(table, *refs):
        return Warned([], [f"comment references are {refs[1]} bytes for {n}"])
    cps, places = struct.unpack_from(f"<{n + 1}i", table, texts[0]), struct.unpack_from(f"<{n + 1}i", table, refs[0])
    out = []
    for k in range(n):
        date, who = struct.unpack_from("<Ih", table, refs[0] + 4 * (n + 1) + step * k + 6)
        out.append({"idx": k, "cp": places[k], "start_cp": places[k], "end_cp": places[k], "text_cp": cps[k], "size": cps[k + 1] - cps[k], "date": date, "author": authors[who] if 0 <= who < len(authors) else "Unknown"})
    warnings = []
    for name, where in (("start_cp", starts), ("end_cp", ends)):
        found = plc(table, *where, 2) if where[1] >= 10 else Warned([], [])
        warnings += found.warnings
        for cp, _, raw in found.value:
            which = int.from_bytes(raw, "little", signed=True)
            if 0 <= which < n:
                out[which][name] = cp
    return Warned(out, warnings)


def authors(table: bytes, at: int, size: int) -> Warned:
    """Names, each with its length in front, one after another."""
    if not size:
        return Warned([], [])
    if not inside(table, at, size):
        return Warned([], [f"range {at}+{size} lies outside of {len(table)} bytes"])
    out, end = [], at + size
    while at + 2 <= end:
        n = int.from_bytes(table[at : at + 2], "little")
        if at + 2 + 2 * n > end:
            return Warned(out, [f"author {len(out)} is cut short"])
        out.append(table[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace"))
        at += 2 + 2 * n
    return Warned(out, [])


def positions(table: bytes, at: int, size: int) -> Warned:
    """A list of positions without anything else, such as headers have."""
    if not size:
        return Warned([], [])
    if not inside(table, at, size):
        return Warned([], [f"range {at}+{size} lies outside of {len(table)} bytes"])
    return Warned(list(struct.unpack_from(f"<{size // 4}i", table, at)), [])


def textboxes(table: bytes, at: int, size: int) -> Warned:
    """idx, cp, size of textboxes within their story; empty ones left out, with a warning."""
    found = plc(table, at, size, 8) if size >= 16 else Warned([], [])
    odd = [f"textbox {k} is empty or reversed" for k, (a, b, _) in enumerate(found.value) if b <= a]
    return Warned([{"idx": k + 1, "cp": a, "size": b - a} for k, (a, b, _) in enumerate(found.value) if b > a], [*found.warnings, *odd])


def anchors(table: bytes, at: int, size: int) -> Warned:
    """shape_id, cp, left, top, right, bottom, flags of shapes."""
    found = plc(table, at, size, ANCHOR)
    names = ("shape_id", "left", "top", "right", "bottom")
    return Warned([{"cp": cp, **dict(zip(names, struct.unpack_from("<5i", raw), strict=True)), "flags": int.from_bytes(raw[22:24], "little")} for cp, _, raw in found.value], found.warnings)


def document_flags(table: bytes, at: int, size: int) -> dict[str, int]:
    """The set flags of a document, by name; with the default tab, the width of columns and the wrap, where the block is long enough."""
    body = table[at : at + min(size, 500)] if at else b""
    if len(body) < 20:
        return {}
    words = struct.unpack_from("<HH", body)
    out = {name: 1 for name, word, bit in FLAGS if words[word] >> bit & 1}
    out["tab"], out["column_width"] = struct.unpack_from("<hh", body, 14)
    if len(body) >= 30:
        out["text_wrap"] = int.from_bytes(body[28:30], "little", signed=True)
    return out


def piece_groups(table: bytes, at: int, size: int) -> dict[int, bytes]:
    """The property groups in front of the piece table by every number that a piece may know them by: the places of a group's length and of its bytes,
    from the beginning of the table and from that of all groups, each also halved."""
    out: dict[int, bytes] = {}
    place, end, pool = at, min(len(table), at + size), 0
    while place + 3 <= end and table[place] == 1:
        n = int.from_bytes(table[place + 1 : place + 3], "little", signed=True)
        place += 3
        if n <= 0:
            continue
        stop = min(end, place + n)
        inner = place
        while inner + 2 <= stop:
            m = int.from_bytes(table[inner : inner + 2], "little", signed=True)
            if m <= 0:
                break
            body = table[inner + 2 : inner + 2 + m]
            for key in (inner - at, inner + 2 - at, pool, pool + 2):
                out[key & 0xFFFF] = body
                out[(key & 0xFFFF) >> 1] = body
            pool = pool + m + 2 & 0xFFFF
            inner += 2 + m
        place = stop
    return out


def field_places(table: bytes, at: int, size: int) -> Warned:
    """The places of field marks within a story."""
    found = plc(table, at, size, 2) if size >= 10 else Warned([], [])
    return Warned([cp for cp, _, _ in found.value], found.warnings)

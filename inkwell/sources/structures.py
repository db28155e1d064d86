"""The small structures of a binary word file: positions with payloads, string tables, property modifiers, formatting pages."""

from __future__ import annotations

import struct
from typing import NamedTuple


class Warned(NamedTuple):
    """A value, and what was wrong with its bytes."""

    value: list
    warnings: list[str]


def inside(data: bytes, at: int, size: int) -> bool:
    return at >= 0 and size >= 0 and at + size <= len(data)


def plc(data: bytes, at: int, size: int, payload: int) -> Warned:
    """(start, end, payload bytes) of n + 1 positions with n payloads behind them. A range outside the stream gives nothing and a warning."""
    if not size:
        return Warned([], [])
    if not inside(data, at, size) or size < 4:
        return Warned([], [f"range {at}+{size} lies outside of {len(data)} bytes"])
    n = (size - 4) // (4 + payload)
    cps = struct.unpack_from(f"<{n + 1}I", data, at)
    base = at + 4 * (n + 1)
    return Warned([(cps[i], cps[i + 1], data[base + i * payload : base + (i + 1) * payload]) for i in range(n)], [])


def string_table(data: bytes, at: int, size: int) -> Warned:
    """Strings of a table: two-byte characters behind FFFF, else one-byte ones. What a cut table still holds is given, with a warning."""
    if not size:
        return Warned([], [])
    if not inside(data, at, size) or size < 4:
        return Warned([], [f"range {at}+{size} lies outside of {len(data)} bytes"])
    end, wide = at + size, data[at : at + 2] == b"\xff\xff"
    at += 2 * wide
    if at + 4 > end:
        return Warned([], ["string table without its counts"])
    count, extra = struct.unpack_from("<HH", data, at)
    at += 4
    out: list[str] = []
    for k in range(count):
        head = 2 if wide else 1
        if at + head > end:
            return Warned(out, [f"string {k} of {count} is missing"])
        n = int.from_bytes(data[at : at + head], "little")
        at += head
        if at + n * head > end:
            return Warned(out, [f"string {k} of {count} is cut short"])
        out.append(data[at : at + n * head].decode("utf-16-le" if wide else "cp1252", "replace"))
        at += n * head + extra
    return Warned(out, [])


#: Operand bytes by the three top bits of an opcode; 6 has its length in front.
OPERANDS = {0: 1, 1: 1, 2: 2, 3: 4, 4: 2, 5: 2, 7: 3}


def modifiers(data: bytes) -> list[tuple[int, bytes]]:
    """(opcode, operand) of a run of property modifiers; ends at the first that is cut short."""
    out, at = [], 0
    while at + 2 <= len(data):
        code = int.from_bytes(data[at : at + 2], "little")
        at += 2
        kind = code >> 13
        if kind == 6:
            if at >= len(data):
                break
            n, at = data[at], at + 1
        else:
            n = OPERANDS[kind]
        if at + n > len(data):
            break
        out.append((code, data[at : at + n]))
        at += n
    return out


def formatting_page(page: bytes, paragraphs: bool) -> list[tuple[int, int, int, bytes]]:
    """(first byte, end, style, modifiers) of the runs of a 512-byte page; at most 101 of characters, 29 of paragraphs fit."""
    if len(page) < 512 or not 0 < page[511] <= (29 if paragraphs else 101):
        return []
    n, step = page[511], 13 if paragraphs else 1
    fcs = struct.unpack_from(f"<{n + 1}I", page, 0)
    out = []
    for k in range(n):
        at = 2 * page[4 * (n + 1) + k * step]
        style, body = 0, b""
        if at and not paragraphs:
            body = page[at + 1 : at + 1 + page[at]]
        elif at:
            size = 2 * page[at] - 1 if page[at] else 2 * page[at + 1]
            at += 1 if page[at] else 2
            style, body = int.from_bytes(page[at : at + 2], "little"), page[at + 2 : at + size]
        out.append((fcs[k], fcs[k + 1], style, body))
    return out

"""Cells of a spreadsheet stream, and charts from them."""

from __future__ import annotations

import struct

from inkwell.sources.structures import Warned

#: Record types.
BOF, EOF, FORMULA, STRING, NUMBER, LABEL, BOOL_ERROR, RK, MULTI_RK, STRINGS, STRING_CELL = 0x0809, 0x000A, 0x0006, 0x0207, 0x0203, 0x0204, 0x0205, 0x027E, 0x00BD, 0x00FC, 0x00FD


def packed_number(word: int) -> float:
    """30 bits of an integer or of a float's high end, divided by 100 where bit 0 says so."""
    if word & 2:
        value = float((word >> 2) - (1 << 30 if word & 0x8000_0000 else 0))
    else:
        value = struct.unpack("<d", struct.pack("<II", 0, word & 0xFFFF_FFFC))[0]
    return value / 100 if word & 1 else value


def _string(data: bytes, at: int, n: int) -> tuple[str, int]:
    wide = data[at] & 1
    at += 1
    raw = data[at : at + n * (1 + wide)]
    if len(raw) < n * (1 + wide):
        raise ValueError("string is cut short")
    return raw.decode("utf-16-le" if wide else "latin-1"), at + len(raw)


def cells(stream: bytes) -> Warned:
    """(row, column, number or string) of a stream's cells; of several records of a cell the last holds. What can't be read gives a warning."""
    found: dict[tuple[int, int], float | str] = {}
    shared: list[str] = []
    notes: list[str] = []
    waiting, at = None, 0
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        try:
            if kind == NUMBER:
                r, c = struct.unpack_from("<HH", body)
                found[r, c] = struct.unpack_from("<d", body, 6)[0]
            elif kind == LABEL:
                r, c, _, n = struct.unpack_from("<HHHH", body)
                found[r, c] = _string(body, 8, n)[0]
            elif kind == RK:
                r, c, _, word = struct.unpack_from("<HHHI", body)
                found[r, c] = packed_number(word)
            elif kind == MULTI_RK:
                r, c = struct.unpack_from("<HH", body)
                for k in range((size - 6) // 6):
                    found[r, c + k] = packed_number(struct.unpack_from("<I", body, 6 + 6 * k)[0])
            elif kind == STRINGS:
                count, place = struct.unpack_from("<I", body, 4)[0], 8
                for _ in range(count):
                    n, options = struct.unpack_from("<HB", body, place)
                    head = 3 + 2 * bool(options & 8) + 4 * bool(options & 4)
                    runs = struct.unpack_from("<H", body, place + 3)[0] if options & 8 else 0
                    more = struct.unpack_from("<I", body, place + 3 + 2 * bool(options & 8))[0] if options & 4 else 0
                    text, _ = _string(bytes([options & 1]) + body[place + head :], 0, n)
                    shared.append(text)
                    place += head + n * (1 + (options & 1)) + 4 * runs + more
            elif kind == STRING_CELL:
                r, c, _, k = struct.unpack_from("<HHHI", body)
                found[r, c] = shared[k]
            elif kind == FORMULA:
                r, c = struct.unpack_from("<HH", body)
                waiting = None
                if body[12:14] != b"\xff\xff":
                    found[r, c] = struct.unpack_from("<d", body, 6)[0]
                elif body[6] == 0:
                    waiting = (r, c)
            elif kind == STRING and waiting:
                found[waiting] = _string(body, 2, struct.unpack_from("<H", body)[0])[0]
                waiting = None
            elif kind == BOOL_ERROR:
                r, c, _, value, error = struct.unpack_from("<HHHBB", body)
                if not error:
                    found[r, c] = float(value)
        except (struct.error, IndexError, ValueError) as e:
            notes.append(f"record {kind:04X} of {size} bytes: {e}")
    return Warned([(r, c, v) for (r, c), v in sorted(found.items())], notes)


def chart(grid: list[tuple[int, int, float | str]]) -> dict:
    """Kind, categories and series of a sheet's cells: labels in the first row name categories, labels in the first column series.

    Missing numbers are zero, series without any are left out; one series of several categories is a pie.
    """
    if not grid:
        return {"kind": None, "categories": [], "series": []}
    by = {(r, c): v for r, c, v in grid}
    rows, columns = sorted({r for r, _ in by}), sorted({c for _, c in by})
    top, left = rows[0], columns[0]
    head_row = any(isinstance(by.get((top, c)), str) for c in columns[1:])
    head_column = any(isinstance(by.get((r, left)), str) for r in rows[1:])
    inner_columns, inner_rows = columns[head_column:], rows[head_row:]
    categories = [str(by.get((top, c), "")) if head_row else str(k + 1) for k, c in enumerate(inner_columns)]
    series = []
    for k, r in enumerate(inner_rows):
        values = [by.get((r, c)) for c in inner_columns]
        if any(isinstance(v, float) for v in values):
            name = by.get((r, left)) if head_column else None
            series.append({"name": str(name) if name is not None else f"Series {k + 1}", "values": [v if isinstance(v, float) else 0.0 for v in values]})
    return {"kind": "pie" if len(series) == 1 and len(categories) > 1 else "column", "categories": categories, "series": series}


def encode(cells: list[tuple[int, int, float | str]]) -> bytes:
    """A stream of number and label records."""
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    out = record(BOF, struct.pack("<HHHHII", 0x0600, 0x0010, 0, 0, 0, 0))
    for r, c, v in cells:
        if isinstance(v, str):
            out += record(LABEL, struct.pack("<HHHHB", r, c, 0, len(v), 1) + v.encode("utf-16-le"))
        else:
            out += record(NUMBER, struct.pack("<HHHd", r, c, 0, v))
    return out + record(EOF, b"")

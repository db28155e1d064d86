"""Pictures at the places that runs name, and shapes from drawing records."""

from __future__ import annotations

import struct

from inkwell.functions.shapes import SHAPE_KINDS
from inkwell.sources import parts

#: A picture's header, how far behind a place a picture may begin, and the map mode with a name behind the header.
HEADER, NEAR, NAMED_MODE = 68, 512, 0x66
#: Records of groups, shapes and options; options by number; what segments of a path do, and how many vertices they use.
GROUP, SHAPE, SHAPE_HEAD, OPTIONS = 0xF003, 0xF004, 0xF00A, (0xF00B, 0xF122)
VERTICES, SEGMENTS, STOPS, TEXTS = 321, 322, 1001, (192, 896)
STEPS = {0x0003: ("MoveTo", 1), 0x0001: ("LineTo", 1), 0x0002: ("CurveTo", 3), 0x00BE: ("CurveTo", 3), 0x00AA: ("End", 0)}


def picture_at(data: bytes, place: int) -> dict | None:
    """The image whose header or signature stands at a place, or shortly behind it."""
    if not 0 <= place < len(data):
        return None
    begin = place
    if place + HEADER <= len(data):
        _, size, mode = struct.unpack_from("<IHH", data, place)
        if size == HEADER:
            begin = place + HEADER + (1 + data[place + HEADER] if mode == NAMED_MODE and place + HEADER < len(data) else 0)
    found = parts.images(data[begin : begin + NEAR + (8 << 20)])
    return next((x | {"offset": begin + x["offset"]} for x in found if x["offset"] <= NEAR), None)


def located(data: bytes, places: list[int]) -> list[dict]:
    """The images that places name, each as it is, twice or half of it; then those found by their signatures in the rest of the data, in order."""
    out, taken = [], []
    for place in places:
        found = next((x for at in (place, 2 * place, place // 2) if (x := picture_at(data, at))), None)
        if found and not any(a <= found["offset"] < b for a, b in taken):
            taken.append((found["offset"], found["offset"] + len(found["data"])))
            out.append(found)
    return out + parts.images(data, sorted(taken))


def vertices(body: bytes) -> list[dict]:
    """x, y of an array of points behind a head of six bytes."""
    n = int.from_bytes(body[:2], "little") if len(body) >= 6 else 0
    return [dict(zip("xy", struct.unpack_from("<ii", body, 6 + 8 * k), strict=True)) for k in range(n) if 14 + 8 * k <= len(body)]


def segments(body: bytes) -> list[dict]:
    """kind and first vertex of a path's segments; a code of the upper half closes, an unknown one draws a line."""
    n, at, out = (int.from_bytes(body[:2], "little") if len(body) >= 6 else 0), 0, []
    for k in range(n):
        if 8 + 2 * k > len(body):
            break
        code = int.from_bytes(body[6 + 2 * k : 8 + 2 * k], "little")
        kind, step = STEPS.get(code) or (("Close", 0) if code & 0x8000 else ("LineTo", 1))
        out.append({"kind": kind, "vertex": at})
        at += step
    return out


def gradient(body: bytes) -> list[dict]:
    """colour and place of a gradient's stops."""
    n = int.from_bytes(body[:2], "little") if len(body) >= 2 else 0
    return [dict(zip(("colour", "place"), struct.unpack_from("<if", body, 2 + 8 * k), strict=True)) for k in range(n) if 10 + 8 * k <= len(body)]


def shapes(records: list[dict]) -> list[dict]:
    """shape_no, parent (-1: none), shape_id, kind, flips, text, options and geometry of shapes and groups among drawing records (as parts.drawing_records gives them), in order."""
    children: dict[int, list[dict]] = {}
    for r in records:
        children.setdefault(r["parent_no"], []).append(r)
    out: list[dict] = []
    blank = {"shape_id": None, "flip_x": False, "flip_y": False, "text": None, "options": [], "vertices": [], "segments": [], "stops": []}

    def take(record: dict, parent: int) -> None:
        if record["type"] == SHAPE:
            if one := _shape(children.get(record["rec_no"], [])):
                out.append({"shape_no": len(out), "parent": parent, **blank, **one})
            return
        if record["type"] == GROUP:
            out.append({"shape_no": len(out), "parent": parent, **blank, "kind": "Group"})
            parent = len(out) - 1
        for child in children.get(record["rec_no"], []):
            take(child, parent)

    for root in children.get(-1, []):
        take(root, -1)
    return out


def _shape(inner: list[dict]) -> dict | None:
    head = next((r for r in inner if r["type"] == SHAPE_HEAD and len(r["body"]) >= 4), None)
    if not head:
        return None
    out = {"shape_id": int.from_bytes(head["body"][:4], "little", signed=True), "kind": SHAPE_KINDS.get(head["instance"], "Unknown")}
    if len(head["body"]) >= 8:
        flags = int.from_bytes(head["body"][4:8], "little")
        out |= {"flip_x": bool(flags & 0x40), "flip_y": bool(flags & 0x80)}
    values: dict[str, int] = {}
    for r in inner:
        if r["type"] not in OPTIONS:
            continue
        for code, value in parts.shape_options(r["body"], min(r["instance"], len(r["body"]) // 6)).items():
            if isinstance(value, int):
                values[str(code)] = value
            elif code == VERTICES:
                out |= {"vertices": vertices(value), "kind": "Custom"}
            elif code == SEGMENTS:
                out |= {"segments": segments(value), "kind": "Custom"}
            elif code == STOPS:
                out["stops"] = gradient(value)
            elif code in TEXTS:
                out["text"] = value.decode("utf-16-le" if len(value) % 2 == 0 else "cp1252", "replace").rstrip("\0\r\n ") or None
                if out["text"] and out["kind"] == "Unknown":
                    out["kind"] = "SmartArt"
    return out | {"options": sorted(values.items())}

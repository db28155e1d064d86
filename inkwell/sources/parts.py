"""What else a word file holds: themes, drawing records, embedded objects, macros, charts, images."""

from __future__ import annotations

import re
import struct
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources import biff
from inkwell.sources.compound import STORAGE, BadFile, Compound, build

_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_HEX = re.compile(r"[0-9A-Fa-f]{6}\Z")


def _theme_colour(entry: ElementTree.Element) -> str | None:
    for tag, key in (("srgbClr", "val"), ("sysClr", "lastClr"), ("sysClr", "val")):
        found = entry.find(f"{_A}{tag}")
        if found is not None and _HEX.match(found.get(key, "")):
            return found.get(key).upper()
    share = entry.find(f"{_A}scrgbClr")
    try:
        return "".join(f"{round(min(100_000, max(0, int(share.get(c)))) * 255 / 100_000):02X}" for c in "rgb")
    except (AttributeError, TypeError, ValueError):
        return None


def theme(xml: bytes) -> dict:
    """colours (scheme name to RRGGBB) and fonts (major_latin, minor_east_asian and so on) of a theme; empty for what isn't one."""
    try:
        if b"<!DOCTYPE" in xml:
            raise ElementTree.ParseError("declares a document type")
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return {"colours": {}, "fonts": {}}
    scheme = next(root.iter(f"{_A}clrScheme"), [])
    colours = {e.tag.rpartition("}")[2]: c for e in scheme if (c := _theme_colour(e))}
    fonts = {}
    for size in ("major", "minor"):
        for tag, name in (("latin", "latin"), ("ea", "east_asian"), ("cs", "bidi")):
            found = next(root.iter(f"{_A}{size}Font"), None)
            face = found.find(f"{_A}{tag}") if found is not None else None
            if face is not None and face.get("typeface", "").strip():
                fonts[f"{size}_{name}"] = face.get("typeface")
    return {"colours": colours, "fonts": fonts}


#: Types of drawing records, and which hold other records.
FIRST_TYPE, LAST_TYPE, HOLDS = 0xF000, 0xF122, 0xF


def drawing_records(data: bytes) -> list[dict]:
    """rec_no, parent_no (-1: none), type, instance, version, body of drawing records, in order; bytes that begin no record are stepped over."""
    out: list[dict] = []

    def take(at: int, end: int, parent: int, resync: bool) -> None:
        while at + 8 <= end:
            head, kind, size = struct.unpack_from("<HHI", data, at)
            if FIRST_TYPE <= kind <= LAST_TYPE and at + 8 + size <= end and (size or not resync):
                number = len(out)
                holds = head & 15 == HOLDS
                out.append({"rec_no": number, "parent_no": parent, "type": kind, "instance": head >> 4, "version": head & 15, "body": b"" if holds else data[at + 8 : at + 8 + size]})
                if holds:
                    take(at + 8, at + 8 + size, number, False)
                at += 8 + size
            elif resync:
                at += 1
            else:
                return

    take(0, len(data), -1, True)
    return out


def shape_options(body: bytes, count: int) -> dict[int, int | bytes]:
    """The option table of a shape: id to value, or to the bytes behind the table for those that have some."""
    out: dict[int, int | bytes] = {}
    at = 6 * count
    for k in range(count):
        if 6 * k + 6 > len(body):
            break
        code, value = struct.unpack_from("<HI", body, 6 * k)
        if code & 0x8000:
            out[code & 0x3FFF], at = body[at : at + value], at + value
        else:
            out[code & 0x3FFF] = value
    return out


#: Programs by the stream that marks them, in order.
PROGRAMS = (("WordDocument", "Word.Document.8"), ("Workbook", "Excel.Sheet.8"), ("PowerPoint Document", "PowerPoint.Show.8"), ("Equation Native", "Equation.3"), ("\x02OlePres000", "Equation.3"), ("Package", "Package"))


def _below(file: Compound, storage: str) -> dict[str, bytes]:
    head = storage.lower() + "/"
    return {e.path[len(head) :]: file._read(e) for e in file.entries if e.kind != STORAGE and e.path.lower().startswith(head)}


def embedded_objects(file: Compound) -> list[dict]:
    """object_id, program, data (a compound file of its own) of the objects in the pool."""
    out = []
    streams: dict[str, dict[str, bytes]] = {}
    for path, body in _below(file, "ObjectPool").items():
        name, _, rest = path.partition("/")
        if rest:
            streams.setdefault(name.lower(), {})[rest] = body
    for name in file.children("ObjectPool"):
        own = streams.get(name.lower(), {})
        program = next((p for mark, p in PROGRAMS if mark in own), "Unknown")
        out.append({"object_id": name, "program": program, "data": build(own)})
    return out


def macros(file: Compound) -> bytes | None:
    """The macro storage as a compound file of its own."""
    streams = _below(file, "Macros")
    return build(streams) if streams else None


def charts(file: Compound) -> list[dict]:
    """name, kind, categories, series of the streams that are named like charts: sheets, or compound files that hold one."""
    out = []
    for e in file.entries:
        if e.kind == STORAGE or "chart" not in e.path.lower().rpartition("/")[2]:
            continue
        raw = file._read(e)
        try:
            inner = Compound(raw)
            raw = next((inner.read(n) for n in ("Workbook", "Book") if inner.find(n)), b"")
        except BadFile:
            pass
        out.append({"name": e.path, **biff.chart(biff.cells(raw).value)})
    return out


def _jpeg_end(data: bytes, at: int) -> int:
    end = data.find(b"\xff\xd9", at + 2)
    return end + 2 if end >= 0 else len(data)


def _png_end(data: bytes, at: int) -> int:
    place = at + 8
    while place + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, place)
        place += 12 + size
        if kind == b"IEND":
            return min(place, len(data))
    return len(data)


def _gif_end(data: bytes, at: int) -> int:
    end = data.find(b"\0\x3b", at + 6)
    return end + 2 if end >= 0 else len(data)


def _bmp_end(data: bytes, at: int) -> int:
    size = struct.unpack_from("<I", data, at + 2)[0]
    return at + size if 54 <= size <= len(data) - at and data[at + 6 : at + 10] == bytes(4) else -1


#: Signatures of images.
SIGNATURES = ((b"\x89PNG\r\n\x1a\n", "Png", _png_end), (b"\xff\xd8\xff", "Jpeg", _jpeg_end), (b"GIF87a", "Gif", _gif_end), (b"GIF89a", "Gif", _gif_end), (b"BM", "Dib", _bmp_end))
_ANY = re.compile(b"|".join(re.escape(s) for s, _, _ in SIGNATURES))


def images(data: bytes, skip: list[tuple[int, int]] = ()) -> list[dict]:
    """offset, kind, width, height, data of images found by their signatures, one after another; not in the ranges to skip."""
    out, at = [], 0
    while m := _ANY.search(data, at):
        at = m.start()
        if inside := next((e for s, e in skip if s <= at < e), None):
            at = inside
            continue
        kind, end_of = next((k, f) for s, k, f in SIGNATURES if s == m.group())
        end = end_of(data, at)
        if end <= at:
            at += 1
            continue
        body = data[at:end]
        width, height = dimensions(kind, body)
        out.append({"offset": at, "kind": kind, "width": width, "height": height, "data": body})
        at = end
    return out


def dimensions(kind: str, data: bytes) -> tuple[int, int]:
    """Width and height of an image; 0, 0 where they can't be told."""
    try:
        if kind == "Png":
            return struct.unpack_from(">II", data, 16)
        if kind == "Gif":
            return struct.unpack_from("<HH", data, 6)
        if kind == "Dib":
            width, height = struct.unpack_from("<ii", data, 18)
            return width, abs(height)
        at = 2
        while kind == "Jpeg" and at + 9 < len(data):
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", data, at + 5)
                return width, height
            at += 2 + size
    except struct.error:
        pass
    return 0, 0


def obfuscated_font(data: bytes, key: str) -> bytes:
    """A font with its first 32 bytes turned by a GUID's bytes from the last to the first, twice; turning again undoes it. Short fonts and odd keys leave it as it is."""
    digits = key.strip("{}").replace("-", "")
    if len(data) < 32 or not re.fullmatch(r"[0-9A-Fa-f]{32}", digits):
        return data
    turn = bytes.fromhex(digits)[::-1] * 2
    return bytes(a ^ b for a, b in zip(data[:32], turn, strict=True)) + data[32:]


#: How scalable fonts begin; lengths that a font's name may have.
SFNT, NAME_LENGTHS = (b"\0\1\0\0", b"OTTO"), range(3, 64)


def embedded_fonts(data: bytes) -> list[dict]:
    """name and data of the fonts in a stream of blocks, each with its length in front: what stands before a font's first bytes, back to a zero, is its name."""
    out, at = [], 0
    while at + 4 < len(data):
        size = struct.unpack_from("<i", data, at)[0]
        at += 4
        if size <= 0 or at + size > len(data):
            break
        block, at = data[at : at + size], at + size
        places = [p for s in SFNT if (p := block.find(s)) >= 0]
        if len(block) < 32 or not places:
            continue
        head = block[: places[0]].rstrip(b"\0")
        plain, wide = head.rpartition(b"\0")[2], head.rpartition(b"\0\0")[2].removeprefix(b"\0") + b"\0"
        for raw, code in ((plain, "ascii"), (wide, "utf-16-le")):  # two-byte names have zeros, so that little of them is left as plain ones
            name = raw.decode(code, "replace")
            if len(name) in NAME_LENGTHS and name.isprintable() and "\ufffd" not in name and name.strip():
                out.append({"name": name, "data": block[places[0] :]})
                break
    return out


def themes(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, colours, fonts (maps) of theme parts, in Arrow batches."""

    def run(batches):
        for batch in batches:
            found = [theme(c.as_py() or b"") for c in batch.column("__content")]
            maps = [pa.array([sorted(x[n].items()) for x in found], pa.map_(pa.string(), pa.string())) for n in ("colours", "fonts")]
            yield pa.RecordBatch.from_arrays([batch.column(key), *maps], [key, "colours", "fonts"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, F.col(content).alias("__content")).mapInArrow(run, f"{key} {kind}, colours map<string,string>, fonts map<string,string>")

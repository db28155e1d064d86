"""Binary word files to relations: one file in, one row of nested relations out, in Arrow batches."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import MapType, StructField, StructType

from inkwell.sources import crypto, modifiers, parts, pictures, sheets, stories
from inkwell.sources.compound import BadFile, Compound, build
from inkwell.sources.structures import Warned, formatting_page, inside, plc, string_table

#: Stories in order of their text, with the slot of their length.
STORIES = (("body", 3), ("footnote", 4), ("header", 5), ("annotation", 7), ("endnote", 8), ("textbox", 9), ("header_textbox", 10))
#: Where structures stand among the pairs of offset and length.
PAIRS = {
    "styles": 1, "footnote_refs": 2, "footnote_texts": 3, "comment_refs": 4, "comment_texts": 5, "sections": 6, "headers": 11, "character_pages": 12, "paragraph_pages": 13, "fonts": 15,
    "fields": 16, "header_fields": 17, "footnote_fields": 18, "comment_fields": 19, "bookmark_names": 21, "bookmark_starts": 22, "bookmark_ends": 23, "flags": 31, "pieces": 33,
    "comment_authors": 36, "anchors": 40, "comment_starts": 42, "comment_ends": 43, "endnote_refs": 46, "endnote_texts": 47, "endnote_fields": 48, "textboxes": 56, "textbox_fields": 57,
    "lists": 73, "overrides": 74,
}
#: Stories with lists of field marks.
FIELD_LISTS = {"body": "fields", "header": "header_fields", "footnote": "footnote_fields", "annotation": "comment_fields", "endnote": "endnote_fields", "textbox": "textbox_fields"}
IDENTS = (0xA5EC, 0xA5DB)
#: Code pages that are tried on bytes that the language's own doesn't fit.
OTHER_PAGES = ("gbk", "big5", "cp932", "cp949", "cp1252", "utf-8")
#: Code pages by language.
CODE_PAGES = {0x0804: "gbk", 0x0404: "gbk", 0x0411: "cp932", 0x0412: "cp949"}


class Information:
    """The block at the head of the main stream."""

    def __init__(self, data: bytes):
        if len(data) < 34 or int.from_bytes(data[:2], "little") not in IDENTS:
            raise BadFile("no file information block")
        self.language, flags = (int.from_bytes(data[k : k + 2], "little") for k in (6, 10))
        self.table, self.encrypted, self.obfuscated = "1Table" if flags & 0x0200 else "0Table", bool(flags & 0x0100), bool(flags & 0x8000)
        self.key = int.from_bytes(data[14:18], "little")
        at = 34 + 2 * int.from_bytes(data[32:34], "little")
        n = int.from_bytes(data[at : at + 2], "little")
        longs = struct.unpack_from(f"<{n}i", data, at + 2)
        self.lengths = {name: max(0, longs[k]) if k < n else 0 for name, k in STORIES}
        at += 2 + 4 * n
        m = int.from_bytes(data[at : at + 2], "little")
        pairs = data[at + 2 : at + 2 + 8 * m]
        self.pairs = {name: struct.unpack_from("<II", pairs, 8 * k) if 8 * k + 8 <= len(pairs) else (0, 0) for name, k in PAIRS.items()}


def pieces_of(table: bytes, at: int, size: int) -> Iterator[tuple[int, int, int, bool, int, int]]:
    """(first position, end, byte offset, two-byte characters, offset as written, property number) of the text's pieces."""
    if not inside(table, at, size):
        raise BadFile(f"piece table {at}+{size} lies outside of {len(table)} bytes")
    end = at + size
    while at < end and table[at] == 1:
        at += 3 + int.from_bytes(table[at + 1 : at + 3], "little")
    if at >= end or table[at] != 2:
        raise BadFile("no piece table")
    for first, last, raw in plc(table, at + 5, int.from_bytes(table[at + 1 : at + 5], "little"), 8).value:
        fc = int.from_bytes(raw[2:6], "little")
        one_byte, masked = bool(fc & 0x4000_0000), fc & 0x3FFF_FFFF
        yield first, last, masked // 2 if one_byte else masked, not one_byte, masked, int.from_bytes(raw[6:8], "little")


_CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF))
_NEAR_CJK = ((0x3040, 0x30FF), (0xAC00, 0xD7AF), (0x3000, 0x303F))
_ODD = ((0x24B6, 0x24FF, -5), (0x27F0, 0x27FF, -5), (0x0B80, 0x0BFF, -8))


def quality(text: str) -> int:
    """How right a decoded text looks, as functions.text.decode_quality tells it."""
    score, behind = 0, False
    for c in text:
        n = ord(c)
        if c == "\ufffd":
            score -= 50
        elif any(a <= n <= b for a, b in _CJK):
            score, behind = score + 6, True
        elif any(a <= n <= b for a, b in _NEAR_CJK):
            score, behind = score + (4 if 0x3000 <= n <= 0x303F else 5), behind or not 0x3000 <= n <= 0x303F
        elif c.isalnum() or c in " \t\r\n":
            score += 2
        elif odd := next((w for a, b, w in _ODD if a <= n <= b), 0):
            score += odd
        elif behind and c in "×÷":
            score -= 3
        elif n >= 0x20 and not 0x7F <= n <= 0x9F:
            score += 1 + (n > 0xFFFF)
    return score


_UNSURE = re.compile("[\ufffd×÷\u0b80-\u0bff\u24b6-\u24ff\u27f0-\u27ff]")
_CONTROL, _PLAIN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"), re.compile(r"[^\W_]|[ \t\r\n]")


def _fits(text: str) -> bool:
    """Whether a decoded text has no replacement characters, and quality() finds one good character in two, or more."""
    if not _UNSURE.search(text):  # then it is two for a plain character, more for a wide one, one for a sign, none for a control
        controls = len(_CONTROL.findall(text))
        return not controls or len(_PLAIN.findall(text)) >= controls
    return "\ufffd" not in text and quality(text) >= len(text)


def best_text(main: bytes, offset: int, raw: int, n: int, language: int) -> str:
    """One-byte text of n characters. The language's code page is taken if it fits: no replacement characters, and every other character a good one.
    Else the best by quality() of two-byte text at either offset, the page at either, and other pages; of equal ones the first in this order."""
    page = CODE_PAGES.get(language, "cp1252")
    own = main[offset : offset + n].decode(page, "replace")
    if _fits(own):
        return own
    tried = [main[at : at + 2 * n].decode("utf-16-le", "replace") for at in (raw, offset) if at + 2 * n <= len(main)]
    tried += [own, *([main[raw : raw + n].decode(page, "replace")] if raw + n <= len(main) else [])]
    tried += [main[offset : offset + n].decode(p, "replace") for p in OTHER_PAGES if p != page]
    return max(tried, key=quality)


def _keyed(values: dict) -> list[tuple[str, int]]:
    return sorted(values.items())


def decoded(content: bytes, password: str | None = None) -> dict:
    """The relations of one file. What can't be read is left out with a diagnostic; without text the file has failed."""
    notes: list[dict] = []
    note = lambda stage, message: notes.append({"seq": len(notes), "level": "warning", "stage": stage, "message": message})
    out = {"status": "ok", "error": None, "diagnostics": notes} | {name: [] for name in _ARROW if name not in ("status", "error", "diagnostics")}
    try:
        file = Compound(content)
        out["streams"] = [{"path": e.path, "kind": e.kind, "size": e.size} for e in file.entries]
        main = file.read("WordDocument")
        info = Information(main)
        if file.find(info.table) is None:
            other = "0Table" if info.table == "1Table" else "1Table"
            note("open", f"no stream {info.table}, {other} taken")
            info.table = other
        table = file.read(info.table)
        if info.encrypted and info.obfuscated and crypto.looks_obfuscated(main[68:]):
            main, table = main[:68] + crypto.xored(main[68:], info.key), crypto.xored(table, info.key)
        elif info.encrypted:
            secret, clear, digest = password or crypto.DEFAULT_PASSWORD, 52, "md5"
            if table[:4] == b"\x01\0\x01\0":
                base = crypto.verified(secret, table[4:20], table[20:36], table[36:52])
            elif table[:4] == b"\x02\0\x02\0":
                base, clear, digest = *crypto.provider_key(secret, table), "sha1"
            else:
                raise BadFile("unknown encryption")
            if base is None:
                raise PermissionError("the password doesn't fit")
            main, table = crypto.rc4(main, base, clear=68, digest=digest), crypto.rc4(table, base, clear=clear, digest=digest)
            info = Information(main)
        pieces = list(pieces_of(table, *info.pairs["pieces"]))
        groups = stories.piece_groups(table, *info.pairs["pieces"])
        text = ""
        for first, last, offset, wide, raw, _ in pieces:
            if offset + (last - first) * (1 + wide) > len(main):
                note("text", f"piece at {offset} is cut short")
            text += main[offset : offset + 2 * (last - first)].decode("utf-16-le", "replace") if wide else best_text(main, offset, raw, last - first, info.language)
        out["pieces"] = [
            {"cp_start": a, "cp_end": b, "offset": o, "wide": w, "raw": r, "properties": _keyed(modifiers.character(groups.get(p, b"") if p else b""))} for a, b, o, w, r, p in pieces
        ]
        at = 0
        units = text.encode("utf-16-le")  # positions count two-byte units
        for k, (name, _) in enumerate(STORIES):
            n = info.lengths[name]
            if n:
                out["stories"].append({"story": name, "ord": k, "start_cp": at, "ccp": n, "text": units[2 * at : 2 * (at + n)].decode("utf-16-le", "replace")})
            at += n
        names = string_table(table, *info.pairs["bookmark_names"])
        starts, ends = plc(table, *info.pairs["bookmark_starts"], 4), plc(table, *info.pairs["bookmark_ends"], 0)
        for w in (*names.warnings, *starts.warnings, *ends.warnings):
            note("bookmarks", w)
        for k, (begin, _, raw) in enumerate(starts.value):
            which = int.from_bytes(raw[:2], "little")
            last = ends.value[which][0] if which < len(ends.value) else begin
            out["bookmarks"].append({"idx": k, "name": names.value[k] if k < len(names.value) else f"Bookmark{k}", "start_cp": begin, "end_cp": last})
        at_cp = _mapping(pieces, sum(info.lengths.values()))
        for _, _, raw in plc(table, *info.pairs["character_pages"], 4).value:
            number = int.from_bytes(raw, "little")
            for begin, end, _, body in formatting_page(main[512 * number : 512 * number + 512], False):
                out["runs"].append({"fc_start": begin, "fc_end": end, "cp_start": at_cp(begin), "cp_end": at_cp(end), "properties": _keyed(modifiers.character(body))})
        for _, _, raw in plc(table, *info.pairs["paragraph_pages"], 4).value:
            number = int.from_bytes(raw, "little")
            for begin, end, style, body in formatting_page(main[512 * number : 512 * number + 512], True):
                row, cells = modifiers.table(body)
                out["paragraphs"].append({
                    "fc_start": begin, "fc_end": end, "cp_start": at_cp(begin), "cp_end": at_cp(end), "style": style, "properties": _keyed(modifiers.paragraph(body)), "row": _keyed(row),
                    "widths": [c["width"] for c in cells], "merges": [c["merges"] for c in cells],
                })
        _rest(out, note, file, info, main, table)
    except PermissionError as e:
        out |= {"status": "failed", "error": "EncryptionError"}
        note("open", str(e))
    except (BadFile, struct.error, IndexError, UnicodeError) as e:
        out |= {"status": "failed", "error": "CorruptedFile"}
        note("load", f"{type(e).__name__}: {e}")
    except MemoryError as e:
        out |= {"status": "failed", "error": "OutOfMemory"}
        note("load", f"MemoryError: {e}")
    return out


def _mapping(pieces: list[tuple[int, int, int, bool, int, int]], length: int):
    """A function from byte offsets to positions: by the first piece that holds one, in its bytes or in offsets as written; the end of the last piece; else brought into the text."""

    def at(fc: int) -> int:
        for first, last, offset, wide, raw, _ in pieces:
            step = 1 + wide
            if offset <= fc < offset + (last - first) * step:
                return first + (fc - offset) // step
            if raw <= fc < raw + (last - first) * 2:
                return first + (fc - raw) // 2
        if pieces:
            first, last, offset, wide, raw, _ = pieces[-1]
            if fc in (offset + (last - first) * (1 + wide), raw + (last - first) * 2):
                return last
        return max(0, min(fc, length))

    return at


def _rest(out: dict, note, file: Compound, info: Information, main: bytes, table: bytes) -> None:
    """What a file can do without. Each part is read by itself, so that one that fails leaves a diagnostic and not a hole."""

    def best(stage: str, read) -> list:
        try:
            found = read()
        except (BadFile, struct.error, IndexError, UnicodeError, ValueError) as e:
            note(stage, f"{type(e).__name__}: {e}")
            return []
        for w in found.warnings:
            note(stage, w)
        return found.value

    where = info.pairs
    keyed = lambda row, *names: row | {n: _keyed(row[n]) for n in names}
    out["styles"] = [keyed(x, "paragraph", "character", "table") for x in best("styles", lambda: sheets.style_sheet(table, *where["styles"]))]
    out["fonts"] = best("fonts", lambda: sheets.fonts(table, *where["fonts"]))
    known = best("lists", lambda: sheets.lists(table, *where["lists"]))
    out["lists"] = [x | {"levels": [keyed(v, "paragraph", "character") for v in x["levels"]]} for x in known]
    out["overrides"] = best("lists", lambda: sheets.overrides(table, *where["overrides"], known))
    out["sections"] = [keyed(x, "properties") for x in best("sections", lambda: stories.sections(table, *where["sections"], main))]
    out["notes"] = best("notes", lambda: stories.notes(table, *where["footnote_texts"], "footnote")) + best("notes", lambda: stories.notes(table, *where["endnote_texts"], "endnote"))
    authors = best("comments", lambda: stories.authors(table, *where["comment_authors"]))
    out["comments"] = best("comments", lambda: stories.comments(table, where["comment_refs"], where["comment_texts"], authors, where["comment_starts"], where["comment_ends"]))
    out["headers"] = best("headers", lambda: stories.positions(table, *where["headers"]))
    out["textboxes"] = best("textboxes", lambda: stories.textboxes(table, *where["textboxes"]))
    out["anchors"] = best("shapes", lambda: stories.anchors(table, *where["anchors"]))
    out["flags"] = _keyed(stories.document_flags(table, *where["flags"]))
    out["fields"] = [{"story": story, "cps": best("fields", lambda name=name: stories.field_places(table, *where[name]))} for story, name in FIELD_LISTS.items() if where[name][1]]
    parted = lambda read: Warned(read(), [])
    out["objects"] = best("objects", lambda: parted(lambda: parts.embedded_objects(file)))
    out["charts"] = best("charts", lambda: parted(lambda: parts.charts(file)))
    out["macros"] = best("macros", lambda: parted(lambda: [m] if (m := parts.macros(file)) else []))
    data = file.read("Data") if file.find("Data") else b""
    out["images"] = best("images", lambda: parted(lambda: pictures.located(data, [dict(r["properties"])["picture"] for r in out["runs"] if "picture" in dict(r["properties"])])))
    out["drawings"] = best("shapes", lambda: parted(lambda: pictures.shapes(parts.drawing_records(table))))


_INT, _TEXT, _FLAG = pa.int64(), pa.string(), pa.bool_()
_MAP = pa.map_(_TEXT, _INT)


def _rows(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


_ARROW = {
    "status": _TEXT,
    "error": _TEXT,
    "stories": _rows(story=_TEXT, ord=_INT, start_cp=_INT, ccp=_INT, text=_TEXT),
    "pieces": _rows(cp_start=_INT, cp_end=_INT, offset=_INT, wide=_FLAG, raw=_INT, properties=_MAP),
    "bookmarks": _rows(idx=_INT, name=_TEXT, start_cp=_INT, end_cp=_INT),
    "runs": _rows(fc_start=_INT, fc_end=_INT, cp_start=_INT, cp_end=_INT, properties=_MAP),
    "paragraphs": _rows(fc_start=_INT, fc_end=_INT, cp_start=_INT, cp_end=_INT, style=_INT, properties=_MAP, row=_MAP, widths=pa.list_(_INT), merges=pa.list_(_INT)),
    "styles": _rows(style_id=_INT, sti=_INT, kind=_TEXT, name=_TEXT, based_on=_INT, next=_INT, hidden=_FLAG, n_blocks=_INT, paragraph=_MAP, character=_MAP, table=_MAP),
    "fonts": _rows(idx=_INT, name=_TEXT, other=_TEXT, family=_INT, charset=_INT, pitch=_INT, scalable=_FLAG),
    "lists": _rows(list_id=_INT, kind=_INT, levels=_rows(level=_INT, start_at=_INT, format=_TEXT, align=_INT, text=_TEXT, indent=_INT, paragraph=_MAP, character=_MAP)),
    "overrides": _rows(override_id=_INT, list_id=_INT, levels=_rows(level=_INT, start_at=_INT, has_start=_FLAG, has_format=_FLAG, format=_TEXT, text=_TEXT)),
    "sections": _rows(section=_INT, start_cp=_INT, end_cp=_INT, properties=_MAP),
    "notes": _rows(kind=_TEXT, idx=_INT, cp=_INT, size=_INT),
    "comments": _rows(idx=_INT, cp=_INT, start_cp=_INT, end_cp=_INT, text_cp=_INT, size=_INT, date=_INT, author=_TEXT),
    "headers": pa.list_(_INT),
    "textboxes": _rows(idx=_INT, cp=_INT, size=_INT),
    "anchors": _rows(shape_id=_INT, cp=_INT, left=_INT, top=_INT, right=_INT, bottom=_INT, flags=_INT),
    "flags": _MAP,
    "fields": _rows(story=_TEXT, cps=pa.list_(_INT)),
    "objects": _rows(object_id=_TEXT, program=_TEXT, data=pa.binary()),
    "charts": _rows(name=_TEXT, kind=_TEXT, categories=pa.list_(_TEXT), series=_rows(name=_TEXT, values=pa.list_(pa.float64()))),
    "macros": pa.list_(pa.binary()),
    "images": _rows(offset=_INT, kind=_TEXT, width=_INT, height=_INT, data=pa.binary()),
    "drawings": _rows(shape_no=_INT, parent=_INT, shape_id=_INT, kind=_TEXT, flip_x=_FLAG, flip_y=_FLAG, text=_TEXT, options=_MAP, vertices=_rows(x=_INT, y=_INT), segments=_rows(kind=_TEXT, vertex=_INT), stops=_rows(colour=_INT, place=pa.float64())),
    "streams": _rows(path=_TEXT, kind=_INT, size=_INT),
    "diagnostics": _rows(seq=_INT, level=_TEXT, stage=_TEXT, message=_TEXT),
}
SCHEMA = from_arrow_schema(pa.schema(list(_ARROW.items())))


#: Bytes of files whose relations go into one batch.
BATCH_BYTES = 1 << 20


def relations(batches: Iterable[pa.RecordBatch], key: str, names: Sequence[str], password: str | None = None, make: Callable[[Any], bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of key and the named relations of the files in the column __content (or of those that make() packs from its values), each of some BATCH_BYTES of files."""
    for batch in batches:
        made: list[dict] = []
        first = size = 0
        for k, c in enumerate(batch.column("__content"), 1):
            value = c.as_py()
            file = (make(value) if make else value) or b""
            row = decoded(file, password)
            made.append({n: row[n] for n in names})
            size += len(file)
            if size >= BATCH_BYTES or k == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(first, k - first), *(pa.array([r[n] for r in made], _ARROW[n]) for n in names)], [key, *names])
                made, first, size = [], k, 0


def decode(files: DataFrame, key: str = "path", content: str = "content", password: str | None = None, only: Sequence[str] | None = None, make: Callable[[Any], bytes] | None = None) -> DataFrame:
    """key and the relations of each file, or only those named. A file fails alone: its row says why.

    make: turns a value of the column content into the file's bytes, so that files packed from rows pass no further than the worker that reads them.
    """
    names = [n for n in _ARROW if only is None or n in only]
    schema = StructType([StructField(key, files.schema[key].dataType), *(f for f in SCHEMA.fields if f.name in names)])
    return files.select(key, F.col(content).alias("__content")).mapInArrow(lambda batches: relations(batches, key, names, password, make), schema)


class DecodeDocument:
    """decode_document(content [, password]) as a table function of SQL: one row of relations per file."""

    def eval(self, content: bytes, password: str | None = None):
        row = decoded(content or b"", password)
        yield tuple(dict(row[f.name]) if isinstance(f.dataType, MapType) else row[f.name] for f in SCHEMA.fields)


def register(spark: SparkSession, name: str = "decode_document") -> None:
    """Make the table function known to a session."""
    spark.udtf.register(name, udtf(DecodeDocument, returnType=SCHEMA))


def encode(stories: dict[str, str], bookmarks: list[tuple[str, int, int]] = (), wide: bool = True, table: str = "1Table") -> bytes:
    """A word file of stories and bookmarks; one-byte text needs characters of cp1252 only."""
    text = "".join(stories.get(name, "") for name, _ in STORIES)
    body = text.encode("utf-16-le" if wide else "cp1252", "replace")
    n = len(text.encode("utf-16-le")) // 2
    offset = 1024
    main = bytearray(offset) + body
    fc = offset if wide else 2 * offset | 0x4000_0000
    tables = {"pieces": b"\x02" + struct.pack("<I", 16) + struct.pack("<IIHIH", 0, n, 0, fc, 0)}
    if bookmarks:
        names = b"\xff\xff" + struct.pack("<HH", len(bookmarks), 0) + b"".join(struct.pack("<H", len(b[0])) + b[0].encode("utf-16-le") for b in bookmarks)
        order = sorted(range(len(bookmarks)), key=lambda k: bookmarks[k][2])
        tables |= {
            "bookmark_names": names,
            "bookmark_starts": struct.pack(f"<{len(bookmarks) + 1}I", *(b[1] for b in bookmarks), n) + b"".join(struct.pack("<HH", order.index(k), 0) for k in range(len(bookmarks))),
            "bookmark_ends": struct.pack(f"<{len(bookmarks) + 1}I", *(bookmarks[k][2] for k in order), n),
        }
    stream, pairs = b"", bytearray(8 * 93)
    for name, raw in tables.items():
        struct.pack_into("<II", pairs, 8 * PAIRS[name], len(stream), len(raw))
        stream += raw
    longs = [0] * 22
    for name, k in STORIES:
        longs[k] = len(stories.get(name, "").encode("utf-16-le")) // 2
    head = struct.pack("<HHHHHHHIBB", 0xA5EC, 0xC1, 0, 0x0409, 0, 0x0200 if table == "1Table" else 0, 0xBF, 0, 0, 0)
    head = head.ljust(32, b"\0") + struct.pack("<H", 14) + bytes(28) + struct.pack("<H", 22) + struct.pack("<22i", *longs) + struct.pack("<H", 93) + bytes(pairs)
    main[: len(head)] = head
    return build({"WordDocument": bytes(main), table: stream})

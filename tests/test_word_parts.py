"""Styles, numbering, formatting, stories and shapes of word files, from bytes packed by hand."""

import hashlib
import struct
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from inkwell.plans import fixtures as fx
from inkwell.plans import contents, words
from inkwell.sources import crypto, modifiers, parts, pictures, sheets, stories, word
from inkwell.sources.compound import build


def test_character_modifiers():
    raw = fx.modifier(0x0835, b"\1") + fx.modifier(0x0836, b"\0") + fx.modifier(0x4A43, b"\x30\0") + fx.modifier(0x4845, struct.pack("<h", -6)) + fx.modifier(0x6870, struct.pack("<I", 0x0102FF))
    raw += fx.modifier(0x2A48, b"\2") + fx.modifier(0x4873, struct.pack("<H", 0x0411)) + fx.modifier(0x6865, struct.pack("<I", 0x04_02_01_08)) + fx.modifier(0x0802, b"\1") + fx.modifier(0xCA78, b"\3\0\x10")
    got = modifiers.character(raw)
    assert got == {
        "bold": 1, "italic": 0, "explicit_italic": 1, "size": 48, "position": -6, "rgb": 0x0102FF, "has_rgb": 1, "superscript": 0, "subscript": 1, "language": 0x0411,
        "border_style": 1, "border_width": 8, "border_colour": 2, "border_space": 4, "east_asian_layout": 3, "vertical": 1, "vertical_compressed": 1,
    }
    assert modifiers.character(fx.modifier(0x0843, b"\x1c")) == {"size": 28} and modifiers.character(fx.modifier(0x2C43, b"\x1c")) == {}  # by low bits, in its groups only


def test_paragraph_modifiers():
    raw = fx.modifier(0x2461, b"\2") + fx.modifier(0x840F, struct.pack("<h", -720)) + fx.modifier(0x6412, struct.pack("<hH", 360, 1)) + fx.modifier(0xA413, struct.pack("<h", 120)) + fx.modifier(0x4458, struct.pack("<h", 50))
    raw += fx.modifier(0x442D, struct.pack("<h", -512)) + fx.modifier(0x2416, b"\1") + fx.modifier(0x6649, struct.pack("<i", 2)) + fx.modifier(0xC64D, struct.pack("<IIH", 1, 2, 3)) + fx.modifier(0xC64E, struct.pack("<IBBBB", 0xFF, 6, 3, 1, 0))
    got = modifiers.paragraph(raw)
    assert got == {
        "justify": 2, "left": -720, "line": 360, "line_multiple": 1, "explicit_line": 1, "space_before": 0, "lines_before": 50, "first_line_chars": -206, "in_table": 1, "nesting": 2,
        "shading_fore": 1, "shading_back": 2, "shading_pattern": 3, "border_top_style": 3, "border_top_width": 6, "border_top_space": 1, "border_top_colour": 0xFF,
    }


def test_table_modifiers():
    cells = struct.pack("<H", 1) + bytes(2) + struct.pack("<4I", 0x0108, 0, 0, 0x0208) + struct.pack("<H", 4) + bytes(18)
    definition = bytes([2]) + struct.pack("<3h", -100, 900, 2000) + cells
    raw = fx.modifier(0xD608, definition) if len(definition) < 256 else b""
    raw += fx.modifier(0x9407, struct.pack("<h", -300)) + fx.modifier(0x3404, b"\1") + fx.modifier(0x9602, struct.pack("<h", 50)) + fx.modifier(0xD605, struct.pack("<6I", *[0x0104] * 6)) + fx.modifier(0x940E, struct.pack("<h", 77)) + fx.modifier(0x3465, b"\1")
    row, found = modifiers.table(raw)
    assert [c["width"] for c in found] == [1000, 1100] and [c["merges"] for c in found] == [1, 4]
    assert found[0]["borders"] == {"top": {"style": 1, "width": 8, "space": 0, "colour": 0}, "right": {"style": 2, "width": 8, "space": 0, "colour": 0}} and found[1]["borders"] == {}
    assert row["height"] == 300 and row["exact"] == 1 and row["header"] == 1 and row["gap_half"] == 50 and row["spacing"] == 100 and row["x"] == 77 and row["overlap"] == 0
    assert row["border_inside_v_style"] == 1
    legacy = bytes([0, 2]) + struct.pack("<3h", 0, 500, 500)
    assert [c["width"] for c in modifiers.table(fx.modifier(0xD608, legacy))[1]] == [503, 0]
    assert modifiers.extended_border(struct.pack("<II", 0x00336699, 0x0108)) == {"style": 1, "width": 8, "space": 0, "colour": 0x336699}
    assert modifiers.extended_border(bytes(8)) is None
    assert modifiers.section(fx.modifier(0xB00F, struct.pack("<h", 9000)) + fx.modifier(0x5002, struct.pack("<H", 1)) + fx.modifier(0x3001, b"\1")) == {"page_width": 9000, "columns": 2, "title_page": 1}


def test_style_sheet():
    bold, centred = fx.modifier(0x0835, b"\1"), fx.modifier(0x2403, b"\1")
    raw = fx.sheet([
        fx.style(0, 1, 0xFFF, "Normal", [b"\0\0" + centred, bold]), fx.style(2, 1, 0, "", []), struct.pack("<H", 0), fx.style(65, 2, 0xFFF, "Strong", [bold], 0xFFF),
        fx.style(105, 3, 0xFFF, "Grid", [fx.modifier(0x9601, struct.pack("<h", 55)), b"\4\0" + centred]),
    ])
    found = sheets.style_sheet(raw, 0, len(raw))
    assert not found.warnings and [(s["style_id"], s["kind"], s["name"], s["based_on"]) for s in found.value] == [(0, "paragraph", "Normal", None), (1, "paragraph", "heading 1", 0), (3, "character", "Strong", None), (4, "table", "Grid", None)]
    assert found.value[0]["paragraph"] == {"justify": 1} and found.value[0]["character"] == {"bold": 1} and found.value[2]["character"] == {"bold": 1}
    assert found.value[3]["table"] == {"indent": 55} and found.value[3]["paragraph"] == {"justify": 1}
    cut = sheets.style_sheet(raw, 0, len(raw) - 10)
    assert len(cut.value) == 3 and cut.warnings and sheets.style_sheet(raw, 5, len(raw)).warnings
    names = fx.fonts([fx.font("Arial"), fx.font("Own", "Other"), b"\x05abcde"])
    assert [(f["idx"], f["name"], f["other"]) for f in sheets.fonts(b"pad!" + names, 4, len(names)).value] == [(0, "Arial", None), (1, "Own", "Other")]
    assert sheets.fonts(b"", 0, 0).value[4]["name"] == "Wingdings"


def test_numbering():
    indent = fx.modifier(0x840F, struct.pack("<h", 360))
    raw = fx.lists([(77, 0, [fx.level(3, 2, "\0.", papx=indent, align=2)]), (0, 0, []), (88, 1, [fx.level(1, 0, "") for _ in range(9)])])
    found = sheets.lists(raw, 0, len(raw))
    assert [x["list_id"] for x in found.value] == [77, 88] and all(len(x["levels"]) == 9 for x in found.value)
    first = found.value[0]["levels"]
    assert (first[0]["format"], first[0]["text"], first[0]["indent"], first[0]["start_at"], first[0]["align"]) == ("LowerRoman", "%1.", 360, 3, 2)
    assert (first[4]["text"], first[4]["indent"]) == ("%5", 3600) and found.value[1]["levels"][2]["text"] == "%3"
    raw = fx.overrides([(88, [fx.override(1, start=5), fx.override(0, formatted=fx.level(1, 23, "*"))]), (999, [])])
    got = sheets.overrides(b"pad!" + raw, 4, len(raw), found.value)
    assert [(o["override_id"], o["list_id"]) for o in got.value] == [(1, 88), (2, 88)]
    assert [(v["level"], v["start_at"], v["has_start"], v["has_format"], v["format"]) for v in got.value[0]["levels"]] == [(1, 5, True, False, None), (0, 0, False, True, "Bullet")]


def whole_file():
    body, notes, headers, remarks = "One two.\rThree \x07four.\r", "A note.\r", "Head\r", "Remark\r"
    places = {4: notes, 5: headers, 7: remarks}
    fcs = [1024, 1024 + 2 * 9, 1024 + 2 * len(body)]
    section = fx.modifier(0xB00F, struct.pack("<h", 15000))
    tail = struct.pack("<H", len(section)) + section
    at = fx.tail_place(body, 2, places)
    tables = {
        fx.STYLES: fx.sheet([fx.style(0, 1, 0xFFF, "Normal", [])]), fx.NOTE_TEXTS: fx.positions([0, 7, 8], [b"\1\0"]), fx.HEADERS: fx.positions([0, 0, 5, 5, 5, 5, 5]),
        fx.SECTIONS: fx.positions([0, len(body)], [struct.pack("<HI6s", 0, at, bytes(6))]), fx.FLAGS: struct.pack("<HH", 0x4008, 0x0001) + bytes(10) + struct.pack("<hh", 720, 0) + bytes(4),
        fx.COMMENT_REFS: fx.positions([3, 9], [struct.pack("<hhhIh18s", 0, 0, 0, 1234, 1, bytes(18))]), fx.COMMENT_TEXTS: fx.positions([0, 6]), fx.AUTHORS: fx.xst("Ann") + fx.xst("Bob"),
        fx.COMMENT_STARTS: fx.positions([2, 9], [b"\0\0"]), fx.COMMENT_ENDS: fx.positions([6, 9], [b"\0\0"]), fx.ANCHORS: fx.positions([4, 9], [struct.pack("<5iHH2s", 1025, 1, 2, 3, 4, 0, 0x2000, bytes(2))]),
        fx.PIECES: b"\x01" + struct.pack("<HH", 5, 3) + fx.modifier(0x083C, b"\1"),
    }
    pages = {
        fx.CHARACTERS: [fx.page(fcs, [fx.modifier(0x0835, b"\1"), fx.modifier(0x6A03, struct.pack("<I", 40))], False)],
        fx.PARAGRAPHS: [fx.page(fcs, [b"\3\0" + fx.modifier(0x2403, b"\1"), b"\0\0" + fx.modifier(0x2416, b"\1") + fx.modifier(0x3404, b"\1")], True)],
    }
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBBI", 13, b"IHDR", 7, 9, 8, 6, 0, 0, 0, 0) + struct.pack(">I4sI", 0, b"IEND", 0)
    data = bytes(40) + struct.pack("<IHH", 200, 68, 100) + bytes(60) + png + bytes(30)
    return fx.document(body, tables, pages, places, tail, {"Data": data, "ObjectPool/_1/Equation Native": b"x", "Macros/VBA/dir": b"m"}), body


def test_whole_file():
    raw, body = whole_file()
    got = word.decoded(raw)
    assert got["status"] == "ok" and not got["diagnostics"], got["diagnostics"]
    assert [(s["story"], s["text"]) for s in got["stories"]] == [("body", body), ("footnote", "A note.\r"), ("header", "Head\r"), ("annotation", "Remark\r")]
    assert [(r["cp_start"], r["cp_end"], dict(r["properties"])) for r in got["runs"]] == [(0, 9, {"bold": 1}), (9, len(body), {"picture": 40})]
    assert [(p["cp_start"], p["cp_end"], p["style"], dict(p["properties"]), dict(p["row"])) for p in got["paragraphs"]] == [(0, 9, 3, {"justify": 1}, {}), (9, len(body), 0, {"in_table": 1}, {"header": 1})]
    assert got["sections"] == [{"section": 0, "start_cp": 0, "end_cp": len(body), "properties": [("page_width", 15000)]}]
    assert got["notes"] == [{"kind": "footnote", "idx": 1, "cp": 0, "size": 7}] and got["headers"] == [0, 0, 5, 5, 5, 5, 5]
    assert got["comments"] == [{"idx": 0, "cp": 3, "start_cp": 2, "end_cp": 6, "text_cp": 0, "size": 6, "date": 1234, "author": "Bob"}]
    assert dict(got["flags"]) == {"facing_pages": 1, "mirror_margins": 1, "printer_metrics": 1, "tab": 720, "column_width": 0} and got["anchors"][0]["flags"] == 0x2000 and got["anchors"][0]["right"] == 3
    assert [(o["object_id"], o["program"]) for o in got["objects"]] == [("_1", "Equation.3")] and len(got["macros"]) == 1
    assert [(i["offset"], i["width"], i["height"]) for i in got["images"]] == [(108, 7, 9)]
    assert stories.piece_groups(b"\x01" + struct.pack("<HH", 5, 3) + fx.modifier(0x083C, b"\1"), 0, 8)[0] == fx.modifier(0x083C, b"\1")


def test_relations_and_table_function(spark):
    raw, body = whole_file()
    files = spark.createDataFrame([("a.doc", bytearray(raw)), ("b.doc", bytearray(b"no"))], "path string, content binary")
    rows = {r.path: r for r in word.decode(files).collect()}
    assert rows["a.doc"].stories[0].text == body and rows["a.doc"].runs[0].properties == {"bold": 1} and rows["b.doc"].status == "failed"
    word.register(spark)
    files.createOrReplaceTempView("files_to_decode")
    found = spark.sql("select path, d.status, get(d.stories, 0).text as body, d.flags['tab'] as tab from files_to_decode, lateral decode_document(content) d order by path").collect()
    assert [tuple(r) for r in found] == [("a.doc", "ok", body, 720), ("b.doc", "failed", None, None)]


def test_code_pages():
    chinese, plain = "你好，世界。今天天气很好", "Plain words, naïve ones."
    raw = chinese.encode("gbk")
    assert word.best_text(b"\0" * 10 + raw, 10, 20, len(raw), 0x0804) == chinese
    assert word.best_text(plain.encode("cp1252"), 0, 0, len(plain), 0x0409) == plain
    wide = plain.encode("utf-16-le")
    assert word.best_text(wide, 0, 0, len(plain), 0x0409) == plain  # flagged as one-byte, but two-byte
    assert word.quality("ab�") == -46 and word.quality("你") == 6 and word.quality("你×") == 3


def test_quality_is_that_of_columns(spark):
    from inkwell.functions.text import decode_quality

    texts = ["plain text 12", "你好 世界", "かな 한글 。", "��", "ⒶⓏ ⟰", "அஆ", "你×÷", "é×", "a\x01\x80b", "😀", "naïve – “q”"]
    got = {r.t: r.q for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode_quality(F.col("t")).alias("q")).collect()}
    assert {t: word.quality(t) for t in texts} == got


def test_provider_key():
    import hashlib

    salt = bytes(range(16))
    name = "Provider".encode("utf-16-le") + b"\0\0"
    head = b"\2\0\2\0" + struct.pack("<IIIIIIII", 4, 0, 0x6801, 0x8004, 40, 1, 0, 0)[:32] + name
    head += bytes(-len(head) % 4) + struct.pack("<I", 16) + salt + bytes(16) + struct.pack("<I", 20) + bytes(20)
    base, end = crypto.provider_key("pw", head)
    assert base == hashlib.sha1(salt + "pw".encode("utf-16-le")).digest()[:5] and end == len(head)
    sent = crypto.rc4(b"secret text", base, at=700, digest="sha1")
    assert crypto.rc4(sent, base, at=700, digest="sha1") == b"secret text" != sent
    assert crypto.looks_obfuscated(b"\1\2") and not crypto.looks_obfuscated(b"\xec\xa5")


def test_shapes():
    record = lambda kind, instance, body, holds=False: struct.pack("<HHI", instance << 4 | (15 if holds else 2), kind, len(body)) + body
    points = struct.pack("<HHH", 2, 2, 8) + struct.pack("<4i", 1, 2, 3, -4)
    path = struct.pack("<HHH", 4, 4, 2) + struct.pack("<4H", 3, 1, 0x8001, 0xAA)
    stops = struct.pack("<H", 1) + struct.pack("<if", 255, 0.5)
    table = struct.pack("<HI", 321 | 0x8000, len(points)) + struct.pack("<HI", 322 | 0x8000, len(path)) + struct.pack("<HI", 1001 | 0x8000, len(stops)) + struct.pack("<HI", 448, 0xFF) + points + path + stops
    one = record(0xF004, 0, record(0xF00A, 1, struct.pack("<iI", 1025, 0x40)) + record(0xF00B, 4, table), True)
    name = "Node\0".encode("utf-16-le")
    two = record(0xF004, 0, record(0xF00A, 99, struct.pack("<iI", 1026, 0x80)) + record(0xF00B, 1, struct.pack("<HI", 896 | 0x8000, len(name)) + name), True)
    got = pictures.shapes(parts.drawing_records(record(0xF002, 0, one + record(0xF003, 0, two, True), True)))
    assert [(s["shape_no"], s["parent"], s["kind"], s["shape_id"], s["flip_x"], s["flip_y"], s["text"]) for s in got] == [(0, -1, "Custom", 1025, True, False, None), (1, -1, "Group", None, False, False, None), (2, 1, "SmartArt", 1026, False, True, "Node")]
    assert got[0]["vertices"] == [{"x": 1, "y": 2}, {"x": 3, "y": -4}] and [s["kind"] for s in got[0]["segments"]] == ["MoveTo", "LineTo", "Close", "End"] and got[0]["stops"] == [{"colour": 255, "place": 0.5}]
    assert got[0]["options"] == [("448", 255)]


def test_damage_leaves_diagnostics():
    raw, _ = whole_file()
    from inkwell.sources.compound import Compound

    file = Compound(raw)
    main, table = bytearray(file.read("WordDocument")), file.read("1Table")
    at = 34 + 28 + 2 + 88 + 2 + 8 * fx.STYLES
    struct.pack_into("<II", main, at, 5, 1 << 20)
    got = word.decoded(build({"WordDocument": bytes(main), "1Table": table}))
    assert got["status"] == "ok" and got["styles"] == [] and [d["stage"] for d in got["diagnostics"]] == ["styles"]
    assert word.decoded(raw[: len(raw) // 2])["status"] in ("ok", "failed")


if __name__ == "__main__":
    pytest.main([__file__])


def test_own_number_before_a_paragraph_block():
    """1042 would read as a modifier of line spacing, of more properties than what follows it."""
    table = fx.sheet([fx.style(100, 1, 0xFFF, f"n{k}", [struct.pack("<H", k) + fx.modifier(0x2403, b"\2")]) for k in range(1100)])
    found = sheets.style_sheet(table, 0, len(table)).value
    assert len(found) == 1100 and all(x["paragraph"] == {"justify": 2} for x in found)


def test_styles_of_more_than_a_file(spark):
    part = spark.range(4500).selectExpr("'B' as p_brand", "id as p_partkey", "cast(id % 50 + 1 as int) as p_size", "concat('n', id) as p_name")
    rows = sorted(words.word_styles(SimpleNamespace(part=part)).collect(), key=lambda r: r.style_id)
    assert [r.style_id for r in rows] == list(range(4500)) and all(r.name == f"n{r.style_id}" and r.size == r.style_id % 50 + 1 for r in rows)
    assert all(r.based_on == (r.style_id - 1 if r.style_id and r.style_id % 3 < 2 else None) for r in rows)
    assert all(r.kind == ("character" if r.style_id % 3 == 2 else "paragraph") for r in rows)


def test_borders_of_wide_colours(spark):
    keys = [*range(60), 63231, 63232, 63233, 63300, 65536, 120_000, 1_199_999, 2**31, 2**40 + 3]
    rows = [(k, 1, k, s) for k in keys for s in (0, 1, 94, 95)]
    found = contents.border_operands(SimpleNamespace(lineitem=spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"))).collect()
    assert len(found) == len(rows) and all((r.style, r.width, r.colour) == (1, r.l_suppkey % 96 + 1, r.l_partkey * 256 + 65536 * 9 + 5) for r in found)


def test_obfuscated_texts_that_would_look_plain(spark):
    """Of each number one beginning turns into a plain file's first bytes by the first key."""
    texts = [(i, crypto.xored(head, 0xA1B2C300 | i % 255 + 1).decode() + " it") for i in range(255) for head in crypto.PLAIN if (head[0] ^ (i % 255 + 1)) < 128]
    assert len(texts) > 100
    rows = [*texts, (1000, ""), (1001, None), (1002, "f")]
    found = contents.obfuscated_texts(SimpleNamespace(documents=spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    expected = sorted((i, hashlib.md5((t or "").encode()).hexdigest(), bool(t)) for i, t in rows)
    assert sorted((r.doc_id, r.plain, r.hidden) for r in found) == expected


def test_more_than_a_thousand_lists(spark):
    n = 1500
    table = fx.lists([(k + 1, 0, [fx.level(k, 0, "x")]) for k in range(n)])
    known = sheets.lists(table, 0, len(table)).value
    assert [x["list_id"] for x in known] == list(range(1, n + 1)) and all(x["levels"][0]["start_at"] == x["list_id"] - 1 for x in known)
    over = bytes(4) + fx.overrides([(k + 1, [fx.override(0, start=k + 7)]) for k in range(n)])
    assert [(x["list_id"], x["levels"][0]["start_at"]) for x in sheets.overrides(over, 4, len(over) - 4, known).value] == [(k + 1, k + 7) for k in range(n)]
    part = spark.range(2300).selectExpr("'B' as p_brand", "id as p_partkey", "cast(id % 50 + 1 as int) as p_size")
    rows = words.word_lists(SimpleNamespace(part=part)).filter("level = 0").collect()
    assert sorted((r.list_id, r.indent, r.start_at) for r in rows) == [(k + 1, 10 * (k % 50 + 1), k % 50 + 2 if k % 2 == 0 else None) for k in range(2300)]

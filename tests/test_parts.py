"""Parts of word files against bytes built by hand."""

import struct

import pyarrow as pa

from inkwell.plans import contents
from inkwell.sources import biff, compound, parts, word


def test_theme():
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    xml = f"""<a:theme {ns}><a:clrScheme><a:dk1><a:sysClr val="windowText" lastClr="0a0b0c"/></a:dk1><a:accent1><a:srgbClr val="4472c4"/></a:accent1>
    <a:hlink><a:scrgbClr r="100000" g="0" b="50000"/></a:hlink><a:lt1><a:sysClr val="window"/></a:lt1></a:clrScheme>
    <a:fontScheme><a:majorFont><a:latin typeface="Cambria"/><a:ea typeface=""/></a:majorFont><a:minorFont><a:cs typeface="Arial"/></a:minorFont></a:fontScheme></a:theme>"""
    assert parts.theme(xml.encode()) == {"colours": {"dk1": "0A0B0C", "accent1": "4472C4", "hlink": "FF0080"}, "fonts": {"major_latin": "Cambria", "minor_bidi": "Arial"}}
    assert parts.theme(b"<a>") == parts.theme(b"<!DOCTYPE a><a/>") == {"colours": {}, "fonts": {}}


def test_drawing_records():
    record = lambda kind, body, version=0, instance=0: struct.pack("<HHI", instance << 4 | version, kind, len(body)) + body
    options = struct.pack("<HI", 0x0104, 7) + struct.pack("<HI", 0x8145, 3) + b"abc"
    shape = record(0xF004, record(0xF00A, struct.pack("<II", 1025, 0), 2, 1) + record(0xF00B, options, 3, 2), 15)
    data = b"\x01\x02junk" + record(0xF003, shape + shape, 15) + b"\xff" + record(0xF11E, b"1234")
    got = parts.drawing_records(data)
    assert [(r["type"], r["parent_no"]) for r in got] == [(0xF003, -1), (0xF004, 0), (0xF00A, 1), (0xF00B, 1), (0xF004, 0), (0xF00A, 4), (0xF00B, 4), (0xF11E, -1)]
    assert parts.shape_options(got[3]["body"], got[3]["instance"]) == {0x0104: 7, 0x0145: b"abc"}
    assert parts.drawing_records(b"") == [] and parts.drawing_records(data[:30])[:1] == []


def test_objects_macros_charts():
    sheet = biff.encode([(0, 0, "A"), (0, 1, "B"), (1, 0, 1.0), (1, 1, 2.0)])
    file = compound.Compound(compound.build({
        "ObjectPool/_1/Workbook": sheet, "ObjectPool/_1/\x01Ole": b"x", "ObjectPool/_2/Equation Native": b"e", "ObjectPool/_3/odd": b"", "Macros/VBA/dir": b"code", "MSChart1": sheet,
        "Chart 2": compound.build({"Workbook": sheet}), "WordDocument": b"w",
    }))
    found = {o["object_id"]: o for o in parts.embedded_objects(file)}
    assert {k: v["program"] for k, v in found.items()} == {"_1": "Excel.Sheet.8", "_2": "Equation.3", "_3": "Unknown"}
    assert compound.Compound(found["_1"]["data"]).read("Workbook") == sheet
    assert compound.Compound(parts.macros(file)).read("VBA/dir") == b"code" and parts.macros(compound.Compound(compound.build({"a": b"1"}))) is None
    charts = {c["name"]: c for c in parts.charts(file)}
    assert set(charts) == {"MSChart1", "Chart 2"} and all(c["series"][0]["values"] == [1.0, 2.0] and c["categories"] == ["A", "B"] for c in charts.values())


def test_images():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"crc!"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 30, 40) + bytes(5)) + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 10) + bytes(10) + b"\xff\xd9"
    gif = b"GIF89a" + struct.pack("<HH", 5, 6) + b"data\0\x3b"
    bmp = b"BM" + struct.pack("<III", 58, 0, 54) + struct.pack("<Iii", 40, 7, -8) + bytes(28) + b"pix!"
    data = b"xx" + png + b"BM.." + jpeg + gif + b"yy" + bmp
    got = parts.images(data)
    assert [(i["kind"], i["width"], i["height"]) for i in got] == [("Png", 30, 40), ("Jpeg", 10, 20), ("Gif", 5, 6), ("Dib", 7, 8)] and [i["data"] for i in got] == [png, jpeg, gif, bmp]
    assert [i["kind"] for i in parts.images(data, [(0, len(png) + 2)])] == ["Jpeg", "Gif", "Dib"] and parts.images(b"") == []


def test_fonts():
    font, key = bytes(range(100)), "{00112233-4455-6677-8899-AABBCCDDEEFF}"
    turned = parts.obfuscated_font(font, key)
    assert turned[0] == 0xFF and turned[32:] == font[32:] and parts.obfuscated_font(turned, key) == font
    assert parts.obfuscated_font(font, "odd") == font and parts.obfuscated_font(b"short", key) == b"short"


def test_relations_come_in_batches_of_few_bytes():
    rows = [[{"k": 10 * i + j, "s": "O"} for j in range(10)] for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(rows)], ["key", "__content"])
    make = lambda some: contents._object_file([tuple(x.values()) for x in some])
    got = list(word.relations([batch], "key", ["objects", "streams"], make=make))
    assert [k for b in got for k in b.column("key").to_pylist()] == list(range(400)) and got[0].schema.names == ["key", "objects", "streams"]
    sizes = [sum(len(make(rows[k])) for k in b.column("key").to_pylist()) for b in got]
    assert len(sizes) > 3 and max(sizes) < 2 * word.BATCH_BYTES
    assert all(len(o) == 10 for b in got for o in b.column("objects").to_pylist())


def test_objects_of_a_large_pool():
    file = compound.Compound(compound.build({f"ObjectPool/_{k}/{'Workbook' if k % 2 else 'Package'}": bytes(k % 5 + 1) for k in range(3000)}))
    reads = []
    file._read = lambda e, read=file._read: reads.append(e.sid) or read(e)
    found = parts.embedded_objects(file)
    assert [o["program"] for o in found] == [("Package", "Excel.Sheet.8")[int(o["object_id"][1:]) % 2] for o in found] and len(found) == len(reads) == 3000

"""Byte structures against bytes built by hand."""

import hashlib
import random
import struct

import pytest

from inkwell.sinks import packages
from inkwell.sources import biff, compound, crypto, modifiers, structures, word


def test_compound_round_trip():
    rnd = random.Random(1)
    streams = {"WordDocument": rnd.randbytes(9000), "1Table": rnd.randbytes(100), "ObjectPool/_1/\x01Ole": b"abc", "ObjectPool/_1/Data": rnd.randbytes(5000), "Macros/VBA/dir": b"", "Z": rnd.randbytes(4096), "a": rnd.randbytes(4095)}
    file = compound.Compound(compound.build(streams))
    assert {e.path: file._read(e) for e in file.entries if e.kind == compound.STREAM} == streams
    assert file.read("worddocument") == streams["WordDocument"] and file.read("Data") == streams["ObjectPool/_1/Data"]
    assert file.children("objectpool/_1") == ["\x01Ole", "Data"] and file.children("nothing") == []
    with pytest.raises(compound.BadFile, match="there are: .*WordDocument"):
        file.read("missing")
    many = compound.Compound(compound.build({f"s{k:03}": bytes([k % 256]) * (k * 37) for k in range(200)}))
    assert all(many.read(f"s{k:03}") == bytes([k % 256]) * (k * 37) for k in range(200))


def test_compound_damage():
    whole = compound.build({"A": bytes(range(256)) * 40})
    assert compound.Compound(whole[:-512] + whole[-512:]).read("A")[:4] == b"\0\1\2\3"
    for bad in (b"", b"x" * 600, whole[:8] + bytes(600), whole[:26] + b"\x09\0" + whole[28:]):
        with pytest.raises(compound.BadFile):
            compound.Compound(bad)
    loop = bytearray(whole)
    first = compound.Compound(whole).find("A").start
    fat = len(whole) - 512
    struct.pack_into("<I", loop, fat + 4 * first, first)
    with pytest.raises(compound.BadFile, match="follows itself"):
        compound.Compound(bytes(loop)).read("A")


def test_positions_and_tables():
    raw = b"pad" + struct.pack("<4I", 0, 5, 9, 12) + b"aabbcc"
    assert structures.plc(raw, 3, 22, 2).value == [(0, 5, b"aa"), (5, 9, b"bb"), (9, 12, b"cc")]
    assert structures.plc(raw, 3, 0, 2) == ([], []) and structures.plc(raw, 10, 100, 2).warnings and structures.plc(raw, -1, 5, 2).warnings
    wide = b"\xff\xff" + struct.pack("<HH", 2, 0) + b"\1\0A\0" + b"\4\0B\0"
    found = structures.string_table(wide, 0, len(wide))
    assert found.value == ["A"] and len(found.warnings) == 1
    narrow = struct.pack("<HH", 2, 1) + b"\2hi!" + b"\1\xe9?"
    assert structures.string_table(narrow, 0, len(narrow)) == (["hi", "é"], [])


def test_modifiers():
    raw = struct.pack("<HB", 0x0835, 1) + struct.pack("<HH", 0x4A43, 28) + struct.pack("<HI", 0x6870, 0x00FF00) + struct.pack("<HB", 0xC615, 3) + b"abc" + struct.pack("<HBBB", 0xE000, 1, 2, 3) + struct.pack("<Hh", 0x840F, -720) + struct.pack("<HB", 0x0835, 0)
    assert [len(o) for _, o in structures.modifiers(raw)] == [1, 2, 4, 3, 3, 2, 1]
    assert modifiers.character(raw) == {"bold": 0, "size": 28, "rgb": 0xFF00, "has_rgb": 1} and modifiers.paragraph(raw)["left"] == -720
    assert structures.modifiers(raw[:4]) == [(0x0835, b"\1")] and structures.modifiers(b"\1") == []


def test_formatting_pages():
    page = bytearray(512)
    struct.pack_into("<3I", page, 0, 1024, 1030, 1040)
    page[12], page[13] = 0, 200
    body = struct.pack("<HB", 0x0836, 1)
    page[400 : 401 + len(body)] = bytes([len(body)]) + body
    page[511] = 2
    assert structures.formatting_page(bytes(page), False) == [(1024, 1030, 0, b""), (1030, 1040, 0, body)]
    page[511] = 102
    assert structures.formatting_page(bytes(page), False) == [] and structures.formatting_page(b"", True) == []
    page = bytearray(512)
    struct.pack_into("<2I", page, 0, 0, 9)
    page[8] = 100
    page[200:208] = bytes([0, 3]) + struct.pack("<H", 7) + struct.pack("<HH", 0x2403, 1)[:3] + b"\0"
    page[511] = 1
    assert structures.formatting_page(bytes(page), True)[0][:3] == (0, 9, 7)


def test_crypto():
    data, base = random.Random(3).randbytes(2000), b"\1\2\3\4\5"
    sent = crypto.rc4(data, base, clear=68)
    assert sent[:68] == data[:68] and sent[68:] != data[68:] and crypto.rc4(sent, base, clear=68) == data
    assert crypto.rc4(sent[700:], base, at=700, clear=68) == data[700:]  # from inside a block
    assert crypto.keystream(b"Key", 9) == bytes.fromhex("EB9F7781B734CA72A7")
    salt, plain = b"s" * 16, b"v" * 16
    key = crypto.base_key("pass", salt)
    both = crypto.rc4(plain + hashlib.md5(plain).digest(), key)
    assert crypto.verified("pass", salt, both[:16], both[16:]) == key and crypto.verified("no", salt, both[:16], both[16:]) is None
    assert crypto.xored(crypto.xored(data, 0xE1B0C1B2), 0xE1B0C1B2) == data


def test_sheets():
    grid = [(0, 1, "A"), (0, 2, "B"), (1, 0, "S1"), (2, 0, "S2"), (1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0), (2, 2, 4.0)]
    found = biff.cells(biff.encode(grid))
    assert sorted(found.value, key=str) == sorted(grid, key=str) and not found.warnings
    assert biff.chart(found.value) == {"kind": "column", "categories": ["A", "B"], "series": [{"name": "S1", "values": [1, 2]}, {"name": "S2", "values": [3, 4]}]}
    assert biff.chart([(0, 1, "A"), (0, 2, "B"), (1, 0, "L"), (1, 2, 5.0)])["kind"] == "pie" and biff.chart([])["series"] == []
    assert [biff.packed_number(x) for x in (0x0000_0012 | 2, (100 << 2) | 3, (-5 << 2) & 0xFFFFFFFF | 2, 0x3FF0_0000)] == [4.0, 1.0, -5.0, 1.0]
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    odd = record(biff.STRINGS, struct.pack("<II", 2, 2) + struct.pack("<HB", 2, 0) + b"hi" + struct.pack("<HB", 50, 0) + b"x") + record(biff.STRING_CELL, struct.pack("<HHHI", 3, 3, 0, 0))
    odd += record(biff.FORMULA, struct.pack("<HHH", 4, 4, 0) + b"\0" * 6 + b"\xff\xff" + bytes(6)) + record(biff.STRING, struct.pack("<HB", 2, 0) + b"ok") + record(biff.NUMBER, b"\0")
    found = biff.cells(odd)
    assert (3, 3, "hi") in found.value and (4, 4, "ok") in found.value and len(found.warnings) == 2


def test_word_files():
    stories = {"body": "Héllo\rworld 😀", "footnote": "note", "textbox": "box"}
    out = word.decoded(word.encode(stories, [("b", 1, 9), ("a", 3, 4)]))
    assert out["status"] == "ok" and {s["story"]: s["text"] for s in out["stories"]} == stories
    assert [(b["name"], b["start_cp"], b["end_cp"]) for b in out["bookmarks"]] == [("b", 1, 9), ("a", 3, 4)]
    assert [s["start_cp"] for s in out["stories"]] == [0, 14, 18]
    narrow = word.decoded(word.encode({"body": "caf\xe9"}, wide=False, table="0Table"))
    assert narrow["stories"][0]["text"] == "café" and not narrow["pieces"][0]["wide"]
    assert word.decoded(b"no")["error"] == "CorruptedFile" and word.decoded(compound.build({"X": b"1"}))["diagnostics"]
    swapped = compound.Compound(word.encode({"body": "x"}))
    moved = word.decoded(compound.build({"WordDocument": swapped.read("WordDocument"), "0Table": swapped.read("1Table")}))
    assert moved["status"] == "ok" and "0Table taken" in moved["diagnostics"][0]["message"]


def test_packages():
    made = packages.package([{"text": "a <b> & \x01\tc\n", "style": "Heading1", "url": None}, {"text": "", "style": None, "url": None}, {"text": "l", "style": None, "url": "http://x/?a&b"}])
    assert packages.faults(made) == [] and made == packages.package([{"text": "a <b> & \x01\tc\n", "style": "Heading1", "url": None}, {"text": "", "style": None, "url": None}, {"text": "l", "style": None, "url": "http://x/?a&b"}])
    import io
    import zipfile

    def changed(drop=None, **put):
        out, old = io.BytesIO(), zipfile.ZipFile(io.BytesIO(made))
        with zipfile.ZipFile(out, "w") as z:
            for n in old.namelist():
                if n != drop:
                    z.writestr(n, put.get(n.replace("/", "_").replace(".", "_"), old.read(n)))
        return out.getvalue()

    assert packages.faults(changed("word/styles.xml")) == ["word/_rels/document.xml.rels: no part word/styles.xml"]
    assert "missing part word/document.xml" in packages.faults(changed("word/document.xml"))
    assert packages.faults(changed(word_document_xml=b"<a>")) == ["word/document.xml isn't well-formed"]
    assert packages.faults(changed(word_document_xml=b"<!DOCTYPE a><a/>")) == ["word/document.xml declares a document type"]
    assert packages.faults(b"zip") == ["not a package"]

"""Markup, whole packages, the command line, and incremental ingest."""

import io
import struct
import zipfile
from xml.etree import ElementTree

import pytest

from inkwell import cli
from inkwell.options import ERRORS, Options, error_kind
from inkwell.plans import fixtures as fx
from inkwell.sinks import markup as m
from inkwell.sinks import packages
from inkwell.sources import word
from inkwell.sources.compound import BadFile
from inkwell.streaming.ingest import ingest

W = f"{{{m.MAIN}}}"


def parsed(xml: str) -> ElementTree.Element:
    return ElementTree.fromstring(m.part("w:x", xml).partition("?>")[2])


def test_runs_and_paragraphs():
    run = parsed(m.run("a\tb\x0c", {"bold": 1, "italic": 0, "explicit_italic": 1, "size": 24, "underline": 3, "highlight": 7, "has_rgb": 1, "rgb": 0x0000FF, "subscript": 1}, "Own & Sons", "Strong"))[0]
    assert [e.tag.removeprefix(W) for e in run[0]] == ["rStyle", "rFonts", "b", "i", "color", "sz", "highlight", "u", "vertAlign"]
    assert run[0][1].get(f"{W}ascii") == "Own & Sons" and run[0][3].get(f"{W}val") == "0" and run[0][4].get(f"{W}val") == "FF0000" and [e.tag.removeprefix(W) for e in run[1:]] == ["t", "tab", "t", "br"]
    p = parsed(m.paragraph("", {"justify": 1, "list": 4, "level": 2, "left": 720, "first_line": -360, "space_before": 120, "explicit_line": 1, "line": 360, "line_multiple": 1, "border_top_style": 6, "border_top_width": 8, "shading_back": 8}, "Heading1"))[0][0]
    assert [e.tag.removeprefix(W) for e in p] == ["pStyle", "numPr", "pBdr", "shd", "spacing", "ind", "jc"] and p[2][0].get(f"{W}val") == "dash" and p[3].get(f"{W}fill") == "FFFFFF" and p[5].get(f"{W}hanging") == "360"
    gone = parsed(m.run("x", {"deleted": 1, "author": "Ann"}))[0]
    assert gone.tag == f"{W}del" and gone[0][0].tag == f"{W}delText"


def test_parts_are_well_formed():
    every = [
        m.styles([{"kind": "table", "id": "Grid", "name": "G<", "table": {"border_inside_h_style": 1}, "character": {"bold": 1}, "paragraph": {"keep": 1}}]),
        m.numbering([{"list_id": 1, "levels": [{"level": 0, "format": "Bullet", "text": "·", "indent": 720}]}], [{"override_id": 1, "list_id": 1, "levels": [{"level": 0, "has_start": True, "start_at": 4}]}]),
        m.notes("footnote", [(1, "")]), m.comments([{"idx": 0, "author": "A&B"}]), m.header("hdr", ""), m.settings({"tab": 720, "mirror_margins": 1}, True), m.core_properties({"title": "<t>", "created": "2020-01-01T00:00:00Z"}), m.app_properties(),
        m.fonts([{"name": "F", "other": "G", "pitch": 1}], {"F": ("rId9", "{1}")}), m.part("w:x", m.table([{"values": {"height": 50000, "exact": 1}, "cells": [{"width": 5, "span": 2, "down": "restart"}]}], {"indent": 4}, [5, 6])),
        m.part("w:x", m.drawing(1, 100, 200, m.picture("rId1", 1, 100, 200, (0.1, 0, 0, 0), flip_x=True), {"x": 1, "y": 2, "horizontal": "Page", "vertical": "Margin", "wrap": "Tight", "points": [(0, 0), (5, 5), (0, 9)]})),
        m.part("w:x", m.drawing(2, 10, 20, m.shape("Ellipse", 10, 20, 0xFF, 2, m.tag("w:p")))), m.part("w:x", m.shape("Custom", 1, 1, path=[{"kind": "MoveTo", "vertex": 0}, {"kind": "CurveTo", "vertex": 1}, {"kind": "Close", "vertex": 4}], points=[(k, k) for k in range(4)])),
        *[m.chart(kind, ["a", "b<"], [("s", [1.0]), ("t", [1.0, 2.0, 3.0])], "T", "Right", True) for kind in m.CHARTS],
    ]
    for xml in every:
        ElementTree.fromstring(xml.partition("?>")[2])
    chart = ElementTree.fromstring(every[-1].partition("?>")[2])
    numbers = [[p[0].text for p in n if p.tag.endswith("}pt")] for n in chart.iter("{http://schemas.openxmlformats.org/drawingml/2006/chart}numLit")]
    assert numbers == [["1.0", "0.0"], ["1.0", "2.0"]]
    row = ElementTree.fromstring(every[9].partition("?>")[2])[0][2]
    assert row[0][0].get(f"{W}val") == "31680" and row[1][0][1].get(f"{W}val") == "2"


def test_equation():
    char = lambda c: b"\x02" + c.encode("utf-16-le")
    fraction = b"\x03\0\0\0" + b"\x01" + char("a") + b"\0\0" + b"\x01" + char("b") + b"\0\0"
    root = b"\x03\x03\0\0" + char("x") + b"\0"
    raw = b"head" + m.EQUATION + b"\0" + b"\x01" + fraction + b"\x06\x01\0\0" + root + char("<") + b"\0"
    got = m.equation(raw)
    tree = ElementTree.fromstring(got)
    assert "".join(tree.itertext()) == "abx<" and [e.tag.rpartition("}")[2] for e in tree] == ["f", "rad", "r"]
    assert m.equation(b"abc") is None and m.equation(raw[:20]).startswith("<m:oMath")


def whole(body="Title\rSee \x13HYPERLINK \"http://a.b/c#d\" \x14the link\x15 here.\rA\x07B\x07\x07\rEnd\x02.\r", password=None):
    at = body.index("A\x07")
    widths = bytes([2]) + struct.pack("<3h", 0, 1000, 2500)
    fcs = [1024, 1024 + 12, 1024 + 2 * at, 1024 + 2 * at + 12, 1024 + 2 * len(body)]
    cell = b"\0\0" + fx.modifier(0x2416, b"\1") + fx.modifier(0xD608, widths) + fx.modifier(0x3404, b"\1")
    papx = [b"\1\0", b"\0\0" + fx.modifier(0x2403, b"\1"), cell, b"\0\0" + fx.modifier(0x260A, b"\0") + fx.modifier(0x460B, struct.pack("<h", 1))]
    tables = {
        fx.STYLES: fx.sheet([fx.style(0, 1, 0xFFF, "Normal", []), fx.style(2, 1, 0, "heading 1", [b"\1\0", fx.modifier(0x0835, b"\1")])]), fx.FONTS: fx.fonts([fx.font("Arial")]),
        fx.LISTS: fx.lists([(77, 0, [fx.level(1, 0, "\0.")])]), fx.OVERRIDES: fx.overrides([(77, [])]), fx.NOTE_TEXTS: fx.positions([0, 7, 8], [b"\1\0"]), fx.HEADERS: fx.positions([0, 0, 5, 5, 5, 5, 5]),
        fx.SECTIONS: fx.positions([0, len(body)], [struct.pack("<HI6s", 0, 0xFFFFFFFF, bytes(6))]),
    }
    pages = {fx.CHARACTERS: [fx.page([1024, 1034, 1024 + 2 * len(body)], [fx.modifier(0x0836, b"\1"), fx.modifier(0x4A4F, b"\0\0")], False)], fx.PARAGRAPHS: [fx.page(fcs, papx, True)]}
    return fx.document(body, tables, pages, {4: "A note.\r", 5: "Head\r"})


def test_whole_package():
    docx, error, notes = packages.converted(whole(), Options())
    assert error is None and not notes, notes
    z = zipfile.ZipFile(io.BytesIO(docx))
    assert not packages.faults(docx) and {"word/styles.xml", "word/numbering.xml", "word/footnotes.xml", "word/settings.xml", "word/fontTable.xml", "docProps/core.xml", "word/header1_default.xml"} <= set(z.namelist())
    body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    assert [e.tag.removeprefix(W) for e in body] == ["p", "p", "tbl", "p", "sectPr"]
    assert ["".join(p.itertext()) for p in body[:2]] == ["Title", "See the link here."] and body[0][0][0].get(f"{W}val") == "Heading1"
    assert body[1].find(f"{W}hyperlink") is not None and b"http://a.b/c#d" in z.read("word/_rels/document.xml.rels")
    table = body[2]
    assert [c.get(f"{W}w") for c in table.find(f"{W}tblGrid")] == ["1000", "1500"] and len(table.findall(f"{W}tr")) == 1 and ["".join(c.itertext()) for c in table.iter(f"{W}tc")] == ["A", "B"]
    assert table.find(f"{W}tr/{W}trPr/{W}tblHeader") is not None and body[3].find(f"{W}pPr/{W}numPr/{W}numId").get(f"{W}val") == "1"
    assert body[3].find(f"{W}r/{W}footnoteReference") is not None and body[4][0].tag == f"{W}headerReference"
    assert packages.converted(whole(), Options())[0] == docx
    plain = packages.converted(whole(), Options(links=False))[0]
    assert b"a.b/c" not in zipfile.ZipFile(io.BytesIO(plain)).read("word/_rels/document.xml.rels")


def test_options_and_errors():
    assert Options().but(links=False).links is False and Options() == Options()
    for bad in ({"most_bytes": -1}, {"table_depth": 0}):
        with pytest.raises(ValueError):
            Options(**bad)
    kinds = {error_kind(e) for e in (PermissionError(), TimeoutError(), MemoryError(), OSError(), BadFile("x"), KeyError("x"))}
    assert kinds == {"EncryptionError", "Timeout", "OutOfMemory", "IOError", "CorruptedFile", "Unknown"} and kinds < set(ERRORS)
    assert cli.fault_of_paths(" ", "x") and cli.fault_of_paths("nowhere at all", "x") and cli.fault_of_paths(".", ".") and not cli.fault_of_paths(".", "/tmp/other")


def test_command_line(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    (source / "a.doc").write_bytes(whole())
    (source / "sub" / "b.DOC").write_bytes(word.encode({"body": "text\r"}))
    (source / "c.docx").write_bytes(packages.package([{"text": "x", "style": None, "url": None}]))
    monkeypatch.setattr(spark, "stop", lambda: None)
    assert cli.main([str(source), str(target), "-r"]) == 0
    assert sorted(str(p.relative_to(target)) for p in target.rglob("*.docx")) == ["a.docx", "c.docx", "sub/b.docx"]
    assert not packages.faults((target / "a.docx").read_bytes())
    (source / "bad.doc").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1nothing")
    (source / "odd.doc").write_bytes(b"no")
    assert cli.main([str(source), str(target)]) == 2
    got = {r.path.rpartition("/")[2]: r.error for r in spark.read.parquet(str(target / "_results")).collect()}
    assert got == {"a.doc": None, "c.docx": None, "bad.doc": "CorruptedFile", "odd.doc": "CorruptedFile"}
    assert cli.main([str(tmp_path / "none"), str(target)]) == 1


def test_ingest(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()
    (source / "a.doc").write_bytes(word.encode({"body": "one\r"}))
    (source / "large.doc").write_bytes(bytes(30_000))
    (source / "p.docx").write_bytes(b"PK")
    (source / "c.txt").write_bytes(b"x")
    ingest(spark, str(source), out, checkpoint, most_bytes=20_000).awaitTermination()
    (source / "b.doc").write_bytes(word.encode({"body": "two\r"}))
    ingest(spark, str(source), out, checkpoint, most_bytes=20_000).awaitTermination()
    got = {r.path.rpartition("/")[2]: (r.status, r.error, r.text) for r in spark.read.parquet(out).selectExpr("path", "status", "error", "get(stories, 0).text as text").collect()}
    assert got == {"a.doc": ("ok", None, "one\r"), "b.doc": ("ok", None, "two\r"), "large.doc": ("failed", "FileTooLarge", None), "p.docx": ("failed", "UnsupportedFormat", None)}


def test_shapes_and_charts_stand_in_the_text():
    from inkwell.sources import biff

    record = lambda kind, instance, body, holds=False: struct.pack("<HHI", instance << 4 | (15 if holds else 2), kind, len(body)) + body
    one = record(0xF004, 0, record(0xF00A, 202, struct.pack("<iI", 1025, 0x40)) + record(0xF00B, 1, struct.pack("<HI", 384, 0xFF)), True)
    body = "A\x08B\r"
    tables = {50: record(0xF002, 0, one, True), fx.ANCHORS: fx.positions([1, 4], [struct.pack("<5iHH2s", 1025, 100, 200, 1540, 920, 0, 2 << 1 | 2 << 3 | 4 << 5, bytes(2))]), 56: fx.positions([0, 8, 9], [bytes(8)])}
    sheet = biff.encode([(0, 1, "a"), (0, 2, "b"), (1, 0, "s"), (1, 1, 1.0), (1, 2, 2.0)])
    raw = fx.document(body, tables, stories={9: "In a box\r"}, streams={"Chart1": sheet})
    docx, error, notes = packages.converted(raw, Options())
    assert error is None and not notes, notes
    z = zipfile.ZipFile(io.BytesIO(docx))
    xml = z.read("word/document.xml").decode()
    tree = ElementTree.fromstring(xml)[0]
    assert "In a box" in "".join(tree[0].itertext()) and [t.text for t in tree[0].iter(f"{W}t")] == ["A", "In a box", "B"]
    assert '<wp:positionH relativeFrom="column">' in xml and "<wp:wrapTopAndBottom/>" in xml and 'flipH="1"' in xml and "FF0000" in xml
    assert "word/charts/chart1.xml" in z.namelist() and "<c:chart " in xml and not packages.faults(docx)

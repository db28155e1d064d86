"""Expressions and operators on small tables."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from inkwell.functions import fields, formats, text
from inkwell.operators import assign, matching, sequences
from inkwell.sources.containers import files, input_kind, rejected


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").select(column(F.col("s"))).collect()]


def test_text(spark):
    assert one(spark, text.clean_controls, "a\x07b\x0bc\x1ed\xa0e\tf\rg", None) == ["ab\nc-d e\tfg", None]
    assert one(spark, text.clean_header, " \x07a\x0bb\x1ec ") == ["a\nbc"]
    assert one(spark, text.clean_textbox, "\x13a\x07b\x1ec\x1f") == ["a\tb-c"]
    assert one(spark, text.xml_safe, "a�b\x01c\U0001f600") == ["a bc\U0001f600"]
    assert one(spark, text.decode_quality, "", "ab 1", "中", "�", "é", "中×", "×", "—", "カ", "、", "ⓐ", "😀") == [0, 8, 6, -50, 2, 3, 1, 1, 5, 4, -5, 2]
    assert one(spark, text.mixed_script_noise, "中가", "中가a", "中かд", "中か") == [True, False, True, False]
    assert one(spark, text.usable, " \t", "x" * 256, "x" * 257) == [False, True, False]
    assert one(spark, text.garbled, "", "a\x00", "a\x00\x00") == [True, False, True]
    assert one(spark, text.tokens, "a\tb\n\nc\f") == [["a", "\t", "b", "\n", "\n", "c", "\f"]]
    assert one(spark, text.utf16_length, "a😀") == [3]


def test_fields(spark):
    assert one(spark, fields.field_name, "  page \\* x", "", "= 1 + 2") == ["PAGE", None, None]
    assert one(spark, lambda c: fields.switches(c), 'a \\@ "d M" \\* x \\@ \'y\'', "none") == [{"@": "y", "*": "x"}, {}]
    assert one(spark, fields.field_type, "toc", "EQ", "zzz") == ["TableOfContents", "Formula", "Unknown"]
    links = one(spark, fields.hyperlink, 'HYPERLINK "http://a/#x" \\l "b"', 'HYPERLINK "#t"', 'HYPERLINK \\l "m"', "HYPERLINK http://a#", "PAGE", "hyperlink 'q'")
    assert [tuple(x) if x else None for x in links] == [("http://a/", "b", True), ("", "t", False), ("", "m", False), ("http://a", None, True), None, ("q", None, True)]
    assert one(spark, fields.link_text, 'HYPERLINK "u" see', "x HYPERLINK y", 'HYPERLINK "cut', '"') == ["see", "x  y", None, None]
    assert one(spark, fields.field_result, "\x13C\x14R\x15", "\x13C\x15", "plain") == ["R", "\x13C\x15", "plain"]


def test_formats(spark):
    rows = spark.createDataFrame([(0, None), (3, "heading 2"), (11, "Heading 12"), (12, "no spacing"), (13, ""), (14, "My Style")], "i int, n string")
    assert [r[0] for r in rows.select(formats.style_id(F.col("i"), F.col("n"))).collect()] == ["Normal", "Heading3", "Heading12", "NoSpacing", "Style13", "MyStyle"]
    assert [r[0] for r in rows.select(formats.table_style_id(F.col("i"), F.col("n"))).collect()][:2] == ["TableNormal", "heading2"]
    got = spark.range(1).select(formats.resolved_target(F.lit("word"), F.lit("../media/./a")), formats.resolved_target(F.lit("word"), F.lit("/x//y")), formats.resolved_target(F.lit(""), F.lit("../../z")), formats.padded(F.array(F.lit(1.0)), F.lit(2))).first()
    assert tuple(got) == ("media/a", "x/y", "z", [1.0, 0.0])
    assert spark.range(1).select(formats.dttm(F.lit(0)), formats.dttm(F.lit(61 | 30 << 6 | 31 << 11 | 2 << 16 | 100 << 20)).cast("string")).first()[1] == "2000-02-29 23:59:00"


def test_pairs_equal_a_stack(spark):
    rnd = random.Random(4)
    rows = [(k, i, rnd.choice(["b", "e", "x"])) for k in range(30) for i in range(40)]
    want = set()
    for k in range(30):
        stack = []
        for kk, i, m in rows:
            if kk == k and m == "b":
                stack.append(i)
            elif kk == k and m == "e" and stack:
                want.add((k, stack.pop(), i))
            elif kk == k and m == "e":
                stack = []
    df = spark.createDataFrame(rows, "k int, i int, m string")
    got = {(r.k, r.begin_at, r.end_at) for r in sequences.nested_pairs(df, ["k"], ["i"], F.col("m") == "b", F.col("m") == "e").collect()}
    assert got == want


def test_split_and_concat_is_identity(spark):
    ranges = spark.createDataFrame([("d", 0, 5), ("d", 5, 9), ("e", 0, 3)], "k string, a int, b int")
    cuts = spark.createDataFrame([("d", 2), ("d", 2), ("d", 5), ("d", 4), ("e", 9), ("d", None)], "k string, c int")
    got = sorted((r.k, r.a, r.seg_start, r.seg_end) for r in sequences.split_at(ranges, cuts, ["k"], "a", "b", "c").collect())
    assert got == [("d", 0, 0, 2), ("d", 0, 2, 4), ("d", 0, 4, 5), ("d", 5, 5, 9), ("e", 0, 0, 3)]


def test_asof(spark):
    points = spark.createDataFrame([("d", 5), ("d", 0), ("d", 25), ("e", 1)], "k string, at int")
    starts = spark.createDataFrame([("d", 3, 0), ("d", 20, 1)], "k string, s int, v int")
    show = lambda df: {(r.k, r.at): r.v for r in df.collect()}
    assert show(matching.asof_floor(points, starts, ["k"], "at", "s", "v")) == {("d", 5): 0, ("d", 0): 0, ("d", 25): 1, ("e", 1): None}
    assert show(matching.asof_ceiling(points, starts, ["k"], "at", "s", "v")) == {("d", 5): 1, ("d", 0): 0, ("d", 25): 1, ("e", 1): None}
    assert {(r.at): r.f for r in matching.bounded_lookback(points, starts, ["k"], "at", "s", "f", 3).collect()} == {5: 3, 0: None, 25: None, 1: None}


def test_mode_and_ancestors(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c"), (2, "c"), (2, "d")], "k int, v string")
    assert {r.k: r.m for r in matching.mode(df, ["k"], "v", "m").collect()} == {1: "b", 2: "c"}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)] + [(50, 51)], "n int, b int")
    got = matching.ancestors(chain, "n", "b").groupBy("node").agg(F.max("depth").alias("d"), F.count(F.lit(1)).alias("c")).collect()
    assert {r.node: (r.d, r.c) for r in got} == {i: (i, i + 1) for i in range(20)} | {50: (0, 1)}


def test_ancestors_of_long_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(100)] + [(200, 201), (201, 202), (202, 200), (203, 200), (300, 300)]
    got = matching.ancestors(spark.createDataFrame(rows, "n int, b int"), "n", "b").collect()
    found = {n: sorted((r.depth, r.ancestor) for r in got if r.node == n) for n, _ in rows}
    assert all(found[i] == [(d, i - d) for d in range(i + 1)] for i in range(100))
    assert found[200] == [(0, 200), (1, 201), (2, 202)] and found[203] == [(0, 203), (1, 200), (2, 201), (3, 202)] and found[300] == [(0, 300)]
    assert max(r.depth for r in matching.ancestors(spark.createDataFrame(rows, "n int, b int"), "n", "b", most=40).collect()) == 40


def test_files(spark, tmp_path):
    for name, raw in {"a.DOC": bytes.fromhex("D0CF11E0A1B11AE1"), "b.docx": b"PK\x03\x04", "c.txt": b"x", "sub/d.doc": b"y" * 50, "e.docx": b"plain"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    found = files(spark, str(tmp_path), most_bytes=20)
    kinds = {r.path.rsplit("/", 1)[-1]: r.kind for r in found.select("path", input_kind(F.col("content"), F.col("path")).alias("kind")).collect()}
    assert kinds == {"a.DOC": "doc", "b.docx": "docx", "e.docx": "docx"}
    assert [r.path.rsplit("/", 1)[-1] for r in rejected(spark, str(tmp_path), most_bytes=20).collect()] == ["d.doc"]
    assert "PushedFilters" in found._jdf.queryExecution().toString()


def test_registry(spark):
    import __spark_entry__ as entry

    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) > 80
    assert entry.entry(spark).count() == 4


def test_assignments(spark):
    from inkwell.operators import assign

    boxes = spark.createDataFrame([("d", 1, 5), ("d", 2, 0), ("e", 1, -1), ("f", 1, 1)], "k string, idx long, para long")
    shapes = spark.createDataFrame([("d", 1001, 0), ("d", 1002, 5), ("e", 7, -1), ("e", 3, 2)], "k string, shape_id long, para long")
    got = {(r.k, r.idx): (r.shape_id, r.score) for r in assign.textboxes_to_shapes(boxes, shapes, "k").collect()}
    assert got == {("d", 1): (1002, 1), ("d", 2): (1001, 1), ("e", 1): (7, 6)}  # the nearest paragraph beats the order of input
    runs = spark.createDataFrame([("d", 0, 100), ("d", 1, 101), ("d", 2, 0), ("d", 3, 9)], "k string, run_idx long, offset long")
    images = spark.createDataFrame([("d", 0, 99), ("d", 1, 500), ("d", 2, 0)], "k string, image_idx long, offset long")
    assert {r.run_idx: r.image_idx for r in assign.runs_to_images(runs, images, "k").collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    cells = spark.createDataFrame([("t", 0, 0, 1, 50), ("t", 1, 0, 1, 70), ("t", 1, 1, 3, 101), ("t", 2, 0, 2, 90), ("t", 3, 9, 1, 5), ("u", 0, 0, 5, 10)], "k string, row_idx int, col_idx int, span int, width int")
    assert {r.k: r.widths for r in assign.column_widths(cells, ["k"], 4).collect()} == {"t": [70, 34, 34, 33], "u": [3, 3, 2, 2]}


def test_ingest_and_cli(spark, tmp_path, capsys):
    from inkwell import cli
    from inkwell.sinks import packages
    from inkwell.sources import word
    from inkwell.streaming.ingest import ingest

    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.doc").write_bytes(word.encode({"body": "one\rtwo"}))
    ingest(spark, str(source), out, str(tmp_path / "cp")).awaitTermination()
    (source / "b.doc").write_bytes(b"broken")
    ingest(spark, str(source), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.status for r in spark.read.parquet(out).collect()) == ["failed", "ok"]
    assert cli.main([str(tmp_path / "nothing"), out]) == 1
    assert cli.main([str(source), str(tmp_path / "docx")]) == 2 and "1 of 2 files" in capsys.readouterr().out
    made = {r.path[-5:]: r for r in spark.read.parquet(str(tmp_path / "docx" / "_results")).collect()}
    assert made["b.doc"].error == "CorruptedFile" and packages.faults((tmp_path / "docx" / "a.docx").read_bytes()) == []


def test_prefix_runs():
    assert assign.prefix_runs(["ab cd", "ef"], ["ab ", "cd\x07", "ef"]) == [(0, 0, 0, 3), (0, 1, 0, 2), (1, 2, 0, 2)]
    assert assign.prefix_runs([" ab ", "x", "cd"], ["\x07ab", "", " cd"]) == [(0, 0, 1, 2), (2, 2, 1, 2)]
    assert assign.prefix_runs(["abc"], ["ab", "X"]) == [(0, 0, 0, 2)] and assign.prefix_runs(["a"], []) == [] and assign.prefix_runs([], ["a"]) == []


def test_runs_come_in_batches_of_few_rows():
    words = [f"w{k}" for k in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([[], *[words] * 999]), pa.array([["x"], *[[w + " " for w in words]] * 999])], ["key", "cells", "runs"])
    got = list(assign.run_batches([batch], "key"))
    assert max(b.num_rows for b in got) < assign.MOST_ROWS + 400 and sum(b.num_rows for b in got) == 999 * 400
    assert [x for b in got for x in b.column("key").to_pylist()] == [k for k in range(1, 1000) for _ in words]
    assert got[-1].slice(got[-1].num_rows - 1).to_pylist() == [{"key": 999, "cell": 399, "run": 399, "offset": 0, "length": 4}]
    none = list(assign.run_batches([batch.slice(0, 1)], "key"))
    assert [b.num_rows for b in none] == [0] and none[0].schema.field("key").type == pa.int64()


def test_column_major():
    assert assign.column_major([["a", "b"], ["c", "d"]], []) == [(0, 0, 1, ["a"]), (0, 1, 1, ["b"]), (1, 0, 1, ["c"]), (1, 1, 1, ["d"])]
    assert assign.column_major([["a", "b", "c"], ["d"]], []) == [(0, 0, 2, ["a", "b"]), (0, 1, 1, ["c"]), (1, 0, 1, []), (1, 1, 1, ["d"])]
    assert assign.column_major([["a", "b"], ["c", "d"]], [[0, 2], [0, 0]]) == [(0, 0, 1, ["a", "b"]), (0, 1, 1, []), (1, 0, 1, ["c"]), (1, 1, 1, ["d"])]
    assert assign.column_major([["a", "b"], ["c", "d"]], [[0, 0], [1, 0]])[0] == (0, 0, 2, ["a", "b"])
    assert assign.column_major([["a", "b"]], []) is None and assign.column_major([["a"], ["b"]], []) is None and assign.column_major([["a", "b"], ["c"]], []) is None


def test_repeated_rows_stay(spark):
    from inkwell.operators import assign, matching, sequences

    points = spark.createDataFrame([("d", 3), ("d", 3), ("d", 9)], "k string, cp int")
    ranges = spark.createDataFrame([("d", 0, 5, 7), ("d", 2, 4, 8)], "k string, s int, e int, n int")
    assert sorted(tuple(r) for r in matching.containing(points, ranges, ["k"], "cp", "s", "e", "n").collect()) == [("d", 3, 7), ("d", 3, 7), ("d", 9, None)]
    apart = spark.createDataFrame([("d", 0, 5, 7), ("d", 5, 6, 8)], "k string, s int, e int, n int")
    assert sorted(tuple(r) for r in matching.containing(points, apart, ["k"], "cp", "s", "e", "n", disjoint=True).collect()) == [("d", 3, 7), ("d", 3, 7), ("d", 9, None)]
    twice = spark.createDataFrame([("d", 0, 5), ("d", 0, 5), ("d", 9, 9)], "k string, s int, e int")
    got = sequences.split_at(twice, points.withColumnRenamed("cp", "c"), ["k"], "s", "e", "c").select("s", "seg_start", "seg_end").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 3), (0, 0, 3), (0, 3, 5), (0, 3, 5), (9, 9, 9)]


def test_long_chains_and_cycles(spark):
    from inkwell.operators import matching

    chain = spark.createDataFrame([(k, k - 1 if k else None) for k in range(60)] + [(100, 101), (101, 100)], "id long, base long")
    got = {r.node: r.depth for r in matching.ancestors(chain, "id", "base").groupBy("node").agg({"depth": "max"}).withColumnRenamed("max(depth)", "depth").collect()}
    assert got[59] == 59 and got[0] == 0 and got[100] == 1


def test_paragraphs_grow_in_proportion(spark):
    from pyspark.sql import functions as F

    from inkwell.operators import sequences

    lines = 60_000
    df = spark.createDataFrame([(1, "ab\n" * lines), (2, ""), (3, "x")], "doc_id int, text string")
    got = sequences.paragraphs(df, "doc_id", F.col("text")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("start_cp").alias("last")).collect()
    assert {r.doc_id: (r.n, r.last) for r in got} == {1: (lines + 1, 3 * lines), 2: (1, 0), 3: (1, 0)}

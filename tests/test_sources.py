import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from shoplens.sources import office
from shoplens.sources.office import read_office_lines, read_xlsx
from shoplens.sources.readers import read_any, read_lexicon, read_lines, read_table, read_words
from shoplens.sources.writers import save_results, write_csv

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def pack(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def relations(*pairs):
    return f"<Relationships {RELS}>" + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in pairs) + "</Relationships>"


def test_csv(spark, tmp_path, rows):
    body = 'id,name,score,when,flag\n1,"a, ""b""\nc",1.5,2024-01-02,true\n2,NA,nan,,false\n3,x,,2024-01-03,\n'
    (tmp_path / "t.csv").write_text(body)
    df = read_table(spark, str(tmp_path / "t.csv"), multiline=True)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double", "string", "boolean"]
    assert rows(df) == [(1, 'a, "b"\nc', 1.5, "2024-01-02", True), (2, None, None, None, False), (3, "x", None, "2024-01-03", None)]
    typed = read_table(spark, str(tmp_path / "t.csv"), "id int, name string, score double, when date, flag boolean", True)
    assert [f.dataType.simpleString() for f in typed.schema] == ["int", "string", "double", "date", "boolean"]
    assert str(typed.orderBy("id").first()["when"]) == "2024-01-02"


def test_csv_sink(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "id long, s string")
    write_csv(df, str(tmp_path / "out"))
    assert rows(read_table(spark, str(tmp_path / "out"))) == [(1, 'a "q", b'), (2, None)]


def test_lines(spark, tmp_path, rows):
    (tmp_path / "a.txt").write_bytes("  안녕 \n\n\t\n　b\n".encode() + b"c\xffd\n")
    df = read_lines(spark, str(tmp_path))
    assert rows(df, "text") == [("b",), ("cd",), ("안녕",)]
    assert df.first()["path"].endswith("a.txt")


def test_parameter_files(spark, tmp_path):
    (tmp_path / "lex.json").write_text('{"좋": 2,\n "bad": -1}')
    assert read_lexicon(spark, str(tmp_path / "lex.json")) == [("좋", 2), ("bad", -1)]
    (tmp_path / "w.txt").write_text("것\n\n 들 \n것\n")
    assert sorted(read_words(spark, str(tmp_path / "w.txt"))) == ["것", "들"]


def test_office_lines(spark, tmp_path, rows):
    paragraphs = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in (" one ", "  ", "two"))
    pack(tmp_path / "a.docx", **{"word/document.xml": f"<w:document {W}><w:body>{paragraphs}</w:body></w:document>"})

    def slide(text):
        return (f"<p:sld {P} {A}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r>"
                f"<a:r><a:t>!</a:t></a:r></a:p><a:p/></p:txBody></p:sp></p:spTree></p:cSld></p:sld>")

    pack(tmp_path / "b.pptx", **{
        "ppt/presentation.xml": f'<p:presentation {P} {R}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations(("r1", "slides/s1.xml"), ("r2", "/ppt/slides/s2.xml")),
        "ppt/slides/s1.xml": slide("second"), "ppt/slides/s2.xml": slide("first")})
    df = read_office_lines(spark, str(tmp_path))
    assert rows(df, "line_no", "text") == [(1, "first!"), (1, "one"), (2, "second!"), (2, "two")]


def test_xlsx(spark, tmp_path, rows):
    sheet = (f'<worksheet {S}><sheetData>'
             '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>qty</t></is></c></row>'
             '<row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c></row>'
             '<row><c r="B3"><v>4.5</v></c></row></sheetData></worksheet>')
    pack(tmp_path / "t.xlsx", **{
        "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="x" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(("rId1", "worksheets/sheet1.xml")),
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>ap</t></r><r><t>ple</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": sheet})
    df = read_xlsx(spark, str(tmp_path / "t.xlsx"))
    assert df.columns == ["name", "qty"]
    assert rows(df) == [("apple", "3"), (None, "4.5")]


def test_spreadsheets_are_joined_by_column_name(spark, tmp_path, rows):
    for name, lines in {"a": [["name", "qty"], ["pear", "3"]], "b": [["qty", "name", "price", "price"], ["7", "fig", "9", "8", "x"]]}.items():
        body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in line) + "</row>" for line in lines)
        pack(tmp_path / f"{name}.xlsx", **{
            "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="x" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": relations(("rId1", "worksheets/sheet1.xml")),
            "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{body}</sheetData></worksheet>"})
    df = read_xlsx(spark, str(tmp_path))
    assert df.columns == ["name", "qty", "price", "price_2", "column_4"]
    assert rows(df) == [("fig", "7", "9", "8", "x"), ("pear", "3", None, None, None)]


def test_a_sheet_is_unpacked_row_by_row(spark, tmp_path):
    """The unpacked sheet takes many times the memory that reading it may take."""
    n = 30_000
    row = '<row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>' + "x" * 1000 + "</t></is></c><c><v>{}</v></c></row>"
    pack(tmp_path / "t.xlsx", **{
        "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="x" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(("rId1", "worksheets/sheet1.xml")),
        "xl/sharedStrings.xml": f"<sst {S}><si><t>shared</t></si></sst>"})
    with zipfile.ZipFile(tmp_path / "t.xlsx", "a", zipfile.ZIP_DEFLATED) as z, z.open("xl/worksheets/sheet1.xml", "w") as f:
        f.write(f"<worksheet {S}><sheetData>".encode())
        for i in range(n):
            f.write(row.format(i).encode())
        f.write(b"</sheetData></worksheet>")
    with zipfile.ZipFile(tmp_path / "t.xlsx") as archive:
        unpacked = archive.getinfo("xl/worksheets/sheet1.xml").file_size
        tracemalloc.start()
        read = sum(1 for _ in office._sheet_rows(archive))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert read == n and peak * 10 < unpacked
    df = read_xlsx(spark, str(tmp_path / "t.xlsx"))
    assert df.columns == ["shared", "x" * 1000, "0"]
    assert df.agg(F.count("*"), F.countDistinct("0"), F.min("shared")).first()[:] == (n - 1, n - 1, "shared")


def test_typed_cells_of_a_spreadsheet(spark, tmp_path, rows):
    styles = (f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/>'
              '<numFmt numFmtId="165" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/>'
              '<xf numFmtId="22"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
    sheet = (f'<worksheet {S}><sheetData>'
             '<row>' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABCDE", ("at", "day", "n", "ok", "bad"))) + '</row>'
             '<row><c r="A2" s="1"><v>40513.3513888889</v></c><c r="B2" s="2"><v>45292</v></c><c r="C2" s="3"><v>2.5</v></c>'
             '<c r="D2" t="b"><v>1</v></c><c r="E2" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
    pack(tmp_path / "t.xlsx", **{
        "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="x" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations(("rId1", "worksheets/sheet1.xml")),
        "xl/styles.xml": styles, "xl/worksheets/sheet1.xml": sheet})
    df = read_any(spark, str(tmp_path / "t.xlsx"))
    assert rows(df) == [("2010-12-01 08:26:00", "2024-01-01 00:00:00", 2.5, True, None)]


def test_dispatch(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "a.txt").write_text("one\n")
    (tmp_path / "b.txt").write_text(" \n")
    assert read_any(spark, str(tmp_path / "a.csv")).first().x == 1
    assert read_any(spark, str(tmp_path / "a.txt")).first().text == "one"
    with pytest.raises(ValueError, match="no text"):
        read_any(spark, str(tmp_path / "b.txt"))
    with pytest.raises(ValueError, match="unsupported"):
        read_any(spark, str(tmp_path / "a.pdf"))


def test_result_store(spark, tmp_path, rows):
    tables = {"a": spark.range(3), "b": spark.range(0)}
    manifest = save_results(tables, str(tmp_path), "job1")
    assert rows(manifest, "job_id", "name", "n_rows") == [("job1", "a", 3), ("job1", "b", 0)]
    assert spark.read.parquet(f"{tmp_path}/job1/a").count() == 3
    assert spark.read.parquet(f"{tmp_path}/job1/_manifest").count() == 2
    with pytest.raises(ValueError):
        save_results({}, str(tmp_path), "job2")


def test_result_store_commits_whole_runs(spark, tmp_path, rows):
    save_results({"a": spark.range(3)}, str(tmp_path), "job")
    broken = spark.range(2).select(F.raise_error(F.lit("stopped")).alias("x"))
    with pytest.raises(Exception, match="stopped"):
        save_results({"a": spark.range(5), "b": broken}, str(tmp_path), "job")
    # The run that was stopped has replaced nothing.
    assert spark.read.parquet(f"{tmp_path}/job/a").count() == 3 and spark.read.parquet(f"{tmp_path}/job/_manifest").count() == 1
    with pytest.raises(Exception, match="stopped"):
        save_results({"a": spark.range(5), "b": broken}, str(tmp_path), "new")
    assert not (tmp_path / "new" / "_manifest").exists()
    assert rows(save_results({"a": spark.range(7)}, str(tmp_path), "job"), "n_rows") == [(7,)]
    assert spark.read.parquet(f"{tmp_path}/job/a").count() == 7
    assert sorted(p.name for p in (tmp_path / "job").iterdir()) == ["_manifest", "a"]


def test_a_failing_table_does_not_stop_the_others(spark, tmp_path, rows):
    broken = spark.range(2).select(F.raise_error(F.lit("stopped")).alias("x"))
    save_results({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path), "job")
    manifest = save_results({"b": broken, "a": spark.range(5)}, str(tmp_path), "job", isolate=True)
    assert rows(manifest, "name", "n_rows", "path") == [("a", 5, f"{tmp_path}/job/a"), ("b", None, None)]
    assert "stopped" in manifest.where("name = 'b'").first().error
    assert spark.read.parquet(f"{tmp_path}/job/a").count() == 5
    # No table of the run before stands under the failed name.
    assert sorted(p.name for p in (tmp_path / "job").iterdir()) == ["_manifest", "a"]
    with pytest.raises(Exception, match="stopped"):
        save_results({"a": broken, "b": broken}, str(tmp_path), "job", isolate=True)
    assert spark.read.parquet(f"{tmp_path}/job/a").count() == 5

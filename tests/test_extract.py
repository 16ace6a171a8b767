import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import headers
from plumbline.plans import report, screen
from plumbline.sources import files

CSV = "Results of the study\n\n,Control,,Treated\nname,length,length,,width\nm1,1.5,2,3,4,extra\nm2,1,,3\n"
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {_S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Fig. 2" sheetId="1" r:id="rId1"/><sheet name="none" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {_S}><si><t>mean</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {_S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>level</t></is></c></row><row r="3"><c r="A3"><v>1.5</v></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {_S}><sheetData/></worksheet>")
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    (root / "sub").mkdir()
    (root / "a.csv").write_bytes(b"\xef\xbb\xbf" + CSV.encode())
    (root / "b.tsv").write_text("gene\tmean\nx\t1\n")
    (root / "c.json").write_text(json.dumps({"p": [1, 2, 3], "q": ["a"], "r": 5}))
    (root / "d.json").write_text(json.dumps([{"y": 1, "x": None}, {"x": 2.5}]))
    (root / "e.json").write_text("3")
    np.save(root / "f.npy", np.arange(3.0))
    np.savez(root / "g.npz", one=np.ones((2, 2)), two=np.zeros((2, 2, 2)))
    (root / "h.xlsx").write_bytes(workbook())
    (root / "i.xls").write_bytes(b"old")
    (root / "j.mat").write_bytes(b"mat")
    (root / "k.pdf").write_bytes(b"%PDF")
    (root / "sub" / "l.png").write_bytes(report.png(np.full((4, 4), 9, dtype=np.uint8)))
    (root / "sub" / "l.points.csv").write_text("x,y\n1,2\n")
    (root / "m.png").write_bytes(b"no image")
    (root / "n.doc").write_text("left out")
    (root / "o.xlsx").write_bytes(b"broken")
    return str(root)


def test_inventory(spark, folder):
    got = {r.relative_path: r.kind for r in files.inventory(spark, folder).collect()}
    assert len(got) == 15 and got["sub/l.points.csv"] == "chart_points" and got["a.csv"] == "table" and got["k.pdf"] == "pdf" and "n.doc" not in got
    assert {r.kind: r.files for r in files.kind_counts(files.inventory(spark, folder)).collect()} == {"table": 5, "array": 6, "pdf": 1, "image": 2}


def test_extraction(spark, folder):
    cells, statuses = screen.extract(spark, folder)
    got: dict[tuple, dict] = {}
    for r in cells.collect():
        got.setdefault((r.source_path.rsplit("/", 1)[-1], r.table_name, r.source_confidence), {})[(r.row_no, r.column)] = r.raw
    a = got[("a.csv", "a.csv", "raw_table")]
    assert a[(5, "length")] == "1.5" and a[(5, "length.2")] == "2" and a[(5, "col_4")] == "3" and a[(5, "col_6")] == "extra" and a[(6, "width")] == ""
    context = {r.column: r.column_context for r in cells.where("table_name = 'a.csv'").select("column", "column_context").distinct().collect()}
    assert context["name"] == "Results of the study" and context["length"] == "Results of the study | Control" and context["width"] == "Results of the study | Treated"
    assert got[("c.json", "c.json", "raw_table")][(2, "p")] == "2" and got[("c.json", "c.json", "raw_table")][(3, "q")] == ""
    assert got[("d.json", "d.json", "raw_table")] == {(1, "x"): "", (1, "y"): "1", (2, "x"): "2.5", (2, "y"): ""}
    assert got[("f.npy", "f.npy", "raw_table")][(3, "value")] == "2.0" and got[("g.npz", "one", "raw_table")][(1, "col_2")] == "1.0"
    assert got[("h.xlsx", "Fig. 2", "raw_table")][(3, "level")] == "7"
    assert ("l.png", "l.points.csv", "estimated") in got and ("l.points.csv", "l.points.csv", "raw_table") in got
    said = {r.source_path.rsplit("/", 1)[-1]: r.status for r in statuses.collect()}
    assert said == {"e.json": "json_not_tabular", "g.npz": "array_not_2d", "i.xls": "xlrd dependency missing", "j.mat": "unreadable", "k.pdf": "pdfplumber dependency missing", "m.png": "image_not_digitized", "o.xlsx": "unreadable"}


def test_header_rules(spark):
    rows = [(0, i, r) for i, r in enumerate([["1", "2"], ["gene", "mean"], ["3", "4"]])] + [(1, 0, ["a"]), (1, 1, ["b"])]
    got = headers.detect_headers(spark.createDataFrame(rows, "table_index int, row_i bigint, cells array<string>"))
    assert {r.table_index: r.header_i for r in got.collect()} == {0: 1, 1: 0}
    labels = spark.createDataFrame([(0, i, x) for i, x in enumerate(["a", "a", "a.2", ""])], "table_index int, col_i int, label string")
    assert [r.column for r in headers.unique_names(labels).orderBy("col_i").collect()] == ["a", "a.2", "a.2", "col_4"]


def test_whole_run_and_report(spark, folder, tmp_path):
    done = screen.screen_folder(spark, folder, "Fig. 2: Growth.\na, Cells.\nFig. 9: More.\nb, x.\n")
    assert done["summary"].first().source_data_status in ("auditable_numeric_data_present", "no_statistical_hits")
    assert "source_data_coverage" in {r.kind for r in done["leads"].collect()}
    text = report.render(done, str(tmp_path), {"exact_recovery_rate": 1.0})
    assert "局限" in text and (tmp_path / "report.md").exists()
    screen.write_document({"leads": done["leads"]}, str(tmp_path / "out" / "leads.json"))
    assert json.loads((tmp_path / "out" / "leads.json").read_text())["leads"]
    screen.write_json(done["classes"].select("column", "column_type"), str(tmp_path / "classes"))
    assert spark.read.json(str(tmp_path / "classes")).count() == done["classes"].count()


def test_report_of_the_fixture(spark, tmp_path):
    from plumbline.operators import evaluate

    report.render(screen.screen(evaluate.fixture_cells(spark)), str(tmp_path))
    assert (tmp_path / "report.md").read_text().count("### ") == 17 and list((tmp_path / "evidence_plots").glob("*.svg"))


def test_watch(spark, tmp_path):
    from plumbline.operators import audits, evaluate
    from plumbline.streaming.watch import watch

    evaluate.fixture_cells(spark).withColumn("col_i", F.col("col_i").cast("int")).write.parquet(str(tmp_path / "in"))
    watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == audits.audit(evaluate.fixture_cells(spark)).count()

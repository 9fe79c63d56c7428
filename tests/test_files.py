import io
import json
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from bomscope import __main__ as cli
from bomscope.api import Reader, as_bytes
from bomscope.config import Output
from bomscope.operators import canonical, evaluate, signals
from bomscope.plans import catalog
from bomscope.sinks import files, reports
from bomscope.sources import pdf, ranges, tables, truth
from bomscope.streaming.arrivals import watch

ROW = "source_pdf string, source_page int, source_section string, row_index int, device_tag string, quantity struct<kind:string,i:decimal(38,0),d:double,s:string>, description string, manufacturer string, model_number string, order_number string, schematic_position string, extra_fields map<string,string>, raw array<string>, warnings array<string>"


@pytest.fixture(scope="module")
def rows(spark):
    from decimal import Decimal

    return spark.createDataFrame([
        ("a.pdf", 2, "MC", 1, "-K2", ("float", None, 1.5, None), 'say "é"', None, "M", None, None, {}, ["x"], ["w1", "w2"]),
        ("a.pdf", 1, None, 0, "-K1", ("int", Decimal(3), None, None), "a\nb", "<&>", None, "O", "/1.2", {"foo": "é"}, ["1", None], []),
    ], ROW)


def test_csv(rows):
    got = files.to_bytes(files.write_csv, rows).decode("utf-8")
    head = "﻿source_pdf,source_page,source_section,row_index,device_tag,quantity,description,manufacturer,model_number,order_number,schematic_position,extra_fields,raw,warnings\r\n"
    assert got == head + 'a.pdf,1,,0,-K1,3,"a\nb",<&>,,O,/1.2,"{""foo"": ""é""}","[""1"", null]",\r\na.pdf,2,MC,1,-K2,1.5,"say ""é""",,M,,,{},"[""x""]",w1; w2\r\n'
    assert b"raw" not in files.to_bytes(files.write_csv, rows, cfg=Output(csv_separator=";", include_raw_column=False))


def test_json(rows, spark):
    audit = spark.createDataFrame([(2, ["x"])], "total_rows int, pages array<string>").first()
    got = json.loads(files.to_bytes(files.write_json, rows, audit, "a.pdf"))
    assert (got["source_pdf"], got["total_rows"], got["audit"]) == ("a.pdf", 2, {"total_rows": 2, "pages": ["x"]})
    assert got["rows"][0]["quantity"] == 3 and got["rows"][0]["extra_fields"] == {"foo": "é"} and got["rows"][1]["warnings"] == ["w1", "w2"]


def test_xlsx(rows):
    data = files.to_bytes(files.write_xlsx, {"a.pdf": rows, "x" * 40 + ".pdf": rows})
    z = zipfile.ZipFile(io.BytesIO(data))
    assert re.findall(r'<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode()) == ["a", "x" * 28]
    sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 3 and "&lt;&amp;&gt;" in sheet and '<c r="F2"><v>3</v></c>' in sheet and ' s="1"' in sheet
    one = zipfile.ZipFile(io.BytesIO(files.to_bytes(files.write_xlsx, {"a": rows, "b": rows}, cfg=Output(xlsx_sheet_per_pdf=False))))
    assert "item_list" in one.read("xl/workbook.xml").decode() and one.read("xl/worksheets/sheet1.xml").decode().count("<row ") == 5


def template(path, rows, sheet="klantlijst"):
    data = files.to_bytes(files.write_xlsx, {sheet: rows})
    with zipfile.ZipFile(io.BytesIO(data)) as a, zipfile.ZipFile(path, "w") as b:
        for i in a.infolist():
            b.writestr(i, a.read(i.filename))
        b.writestr("xl/vbaProject.bin", bytes(range(256)) * 9)


def test_template(rows, tmp_path):
    path = str(tmp_path / "t.xltm")
    template(path, rows)
    z = zipfile.ZipFile(io.BytesIO(files.to_bytes(files.write_template, rows, path)))
    old = zipfile.ZipFile(path)
    changed = [n for n in old.namelist() if old.read(n) != z.read(n)]
    assert z.namelist() == old.namelist() and changed == ["xl/worksheets/sheet1.xml"]
    sheet = z.read(changed[0]).decode()
    assert '<c r="A2"><v>3</v></c>' in sheet and ">Stuks<" in sheet and ">[MC] w1; w2<" in sheet and ">source_pdf<" in sheet and sheet.count("<row ") == 3
    with pytest.raises(FileNotFoundError):
        files.to_bytes(files.write_template, rows, str(tmp_path / "none"))
    template(path, rows, "other")
    with pytest.raises(ValueError, match="klantlijst"):
        files.to_bytes(files.write_template, rows, path)


def test_bulk_and_frame(rows, spark, tmp_path):
    for kind in ("csv", "json", "parquet"):
        files.bulk(rows, f"{tmp_path}/{kind}", kind)
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == spark.read.json(f"{tmp_path}/json").count() == 2
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv").orderBy("row_index").collect()
    assert [r.description for r in back] == ["a\nb", 'say "é"']
    frame = files.to_frame(rows)
    assert list(frame.columns) == files.TEXT_COLUMNS and list(frame["quantity"]) == ["3", "1.5"]


def test_output_path():
    assert files.output_path("/x/a.b.pdf", None, "csv") == "/x/a.b.csv" and files.output_path("/x/a.pdf", "/y", "procos") == "/y/a_procos.xltm"


def test_a_templates_other_cells_stay():
    old = '<row r="1" ht="20"><c r="A1" t="s"><v>0</v></c></row><row r="2" spans="1:12"><c r="A2" s="3"/><c r="C2"><v>9</v></c><c r="L2"><f>A2*2</f></c></row><row r="4"><c r="A4"><v>7</v></c><c r="AA4"><v>8</v></c></row><row r="6"><c r="A6"><v>1</v></c></row>'
    got = "".join(files.merge_rows(old, [[1, None, "x"], [2, "y", None], [3, None, None]]))
    rows = re.findall(r'<row.*?</row>', got)
    assert [re.search(r'r="(\d+)"', r)[1] for r in rows] == ["1", "2", "3", "4", "6"]
    assert rows[0] == old[: len(rows[0])] and rows[4] == old[-len(rows[4]) :]
    assert '<c r="A2" s="3"><v>1</v></c>' in rows[1] and "C2" in rows[1] and "<v>9</v>" not in rows[1] and '<c r="L2"><f>A2*2</f></c>' in rows[1] and 'spans="1:12"' in rows[1]
    assert '<c r="A4"><v>3</v></c>' in rows[3] and '<c r="AA4"><v>8</v></c>' in rows[3] and "<v>7</v>" not in rows[3]
    assert "".join(files.merge_rows(old, [])) == old and "".join(files.merge_rows("", [[5]])) == '<row r="2"><c r="A2"><v>5</v></c></row>'


def test_ranges(spark):
    assert ranges.parse("33-35, 47") == [[33, 34, 35], [47]] and ranges.parse("35-33") == [[]] and ranges.parse(",,") == []
    with pytest.raises(ValueError):
        ranges.parse("a-b")
    df = spark.createDataFrame([("d", "33-35, 47"), ("e", "35-33")], "doc string, spec string")
    assert [tuple(r) for r in ranges.page_runs(df).orderBy("run_idx", "pos").collect()] == [("d", 0, 0, 33), ("d", 0, 1, 34), ("d", 0, 2, 35), ("d", 1, 0, 47)]


def make_pdf(pages, deflate=True):
    """A PDF file of pages given as lists of (x, y from the bottom, text)."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /MediaBox [0 0 600 400] /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(len(pages)))}] >>"]
    out = [f"{n} 0 obj\n{o}\nendobj\n".encode() for n, o in enumerate(objects, 1)]
    for i, words in enumerate(pages):
        shown = "\n".join(f"BT /F1 8 Tf 1 0 0 1 {x} {y} Tm ({t}) Tj ET" for x, y, t in words) + "\n10 10 m 20 20 l S 5 5 50 50 re S"
        body = zlib.compress(shown.encode("latin-1")) if deflate else shown.encode("latin-1")
        out.append(f"{3 + 2 * i} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>\nendobj\n".encode())
        out.append(f"{4 + 2 * i} 0 obj\n<< /Length {len(body)} {'/Filter /FlateDecode ' if deflate else ''}>>\nstream\n".encode() + body + b"\nendstream\nendobj\n")
    return b"%PDF-1.4\n" + b"".join(out) + b"trailer << /Root 1 0 R >>\n%%EOF"


def parts_page(n, heading="PARTS LIST"):
    x = [40, 120, 200, 330, 430]
    page = [(40, 370, heading)]
    for i, cells in enumerate([["Item", "Qty", "Description", "Type", "Supplier"], *[[f"-K{k}", str(k + 1), f"Relay {k} /1.{k}", f"T{k}", "Acme"] for k in range(n)]]):
        page += [(a, 340 - 20 * i, c) for a, c in zip(x, cells, strict=True)]
    return page


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pdf")
    wiring = [(50, 50, "wiring diagram"), (300, 200, "X1")]
    (path / "a.pdf").write_bytes(make_pdf([wiring, parts_page(11), parts_page(6), wiring]))
    (path / "b.pdf").write_bytes(make_pdf([wiring], deflate=False))
    (path / "bad.pdf").write_bytes(b"not a pdf")
    return path


def test_pdf_pages(spark, folder):
    documents, pages, grids, errors = pdf.read_documents(spark, str(folder))
    assert [(r.doc, r.error[:10]) for r in errors.collect()] == [("bad.pdf", "ValueError")]
    assert sorted(r.doc for r in documents.collect()) == ["a.pdf", "b.pdf", "bad.pdf"]
    got = {(r.doc, r.page): r for r in pages.collect()}
    assert set(got) == {("a.pdf", i) for i in range(1, 5)} | {("b.pdf", 1)}
    assert got["a.pdf", 2].text.startswith("PARTS LIST\nItem Qty") and (got["a.pdf", 2].n_lines, got["a.pdf", 2].n_rects, got["a.pdf", 2].width) == (1, 1, 600.0)
    grid = grids.where("page = 2").first().grid
    assert grid[0] == ["Item", "Qty", "Description", "Type", "Supplier"] and grid[1] == ["-K0", "1", "Relay 0 /1.0", "T0", "Acme"] and len(grid) == 12


def test_files_of_one_name_stay_apart_and_a_failing_file_harms_no_other(spark, tmp_path):
    for d, n in (("x", 6), ("y", 11)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "a.pdf").write_bytes(make_pdf([parts_page(n)]))
    (tmp_path / "deep.pdf").write_bytes(b"deep")
    calls = []

    def reader(data):
        if data == b"deep":
            raise RecursionError("pages in a ring")
        return pdf.read_plain(data)

    found = pdf.read_documents(spark, str(tmp_path), reader)
    assert sorted(r.doc for r in found.documents.collect()) == ["deep.pdf", "x/a.pdf", "y/a.pdf"]
    assert {r.doc: len(r.grid) for r in found.grids.collect()} == {"x/a.pdf": 7, "y/a.pdf": 12}
    assert [tuple(r) for r in found.errors.collect()] == [("deep.pdf", "RecursionError: pages in a ring")]
    assert found.pages.count() == 2 and not calls


def test_one_parse_for_pages_grids_and_errors(spark, folder):
    counted = spark.sparkContext.accumulator(0)

    def reader(data):
        counted.add(1)
        return pdf.read_plain(data)

    found = pdf.read_documents(spark, str(folder), reader)
    assert found.pages.count() == 5 and found.grids.count() > 0 and found.errors.count() == 1
    assert counted.value == 3


def test_signals_of_ones_own_and_passes_over_all_pages(spark, folder):
    reader = Reader(spark, str(folder / "a.pdf"))

    def fails_on_two(row):
        if row["page"] == 2:
            raise KeyError("nothing")
        return 5

    extra = {"wide": lambda p: F.when(p["width"] > 500, 1.5), "odd": signals.per_page(fails_on_two, "page"), "wrong": lambda p: p["no_such_column"]}
    passes = {"first": lambda s: s.where("page = 1").selectExpr("doc", "page", "total_score + 100 AS score"), "broken": lambda s: s.select("nothing")}
    plain = {r.page: r for r in reader.classify().scores.collect()}
    got = {r.page: r for r in reader.classify(extra=extra, passes=passes).scores.collect()}
    assert [got[2].odd.score, got[1].odd.score] == [0, 5] and "KeyError" in got[2].odd.error and got[1].odd.error is None
    assert {r.wide.score for r in got.values()} == {1.5} and all(r.wrong.score == 0 and r.wrong.error for r in got.values())
    assert got[3].total_score - plain[3].total_score == 6.5 and got[3].first.score == 0 and got[3].broken.error
    assert got[1].first.score == plain[1].total_score - plain[1].continuity.score + 6.5 + 100


def test_expected_ranges_and_acceptance(spark, tmp_path):
    path = tmp_path / "truth.yaml"
    path.write_text("pdf_dir: x\nfixtures:\n  - pdf: a.pdf\n    total_pages: 4\n    expected:\n      - pages: [2, 3]\n        title: Parts\n        approx_row_count: 17\n  - pdf: none.pdf\n    total_pages: 1\n")
    documents, expected = truth.expected_runs(spark, str(path))
    assert documents.count() == 2 and [tuple(r) for r in expected.collect()] == [("a.pdf", 2, 3, "Parts", 17)]
    found = spark.createDataFrame([("a.pdf", 2, 4)], "doc string, start_page int, end_page int")
    rows = lambda n, said: spark.createDataFrame([("a.pdf", said)] * n, "source_pdf string, description string")
    check = lambda r, f=found: evaluate.acceptance(expected, f, r).first()
    assert check(rows(10, "x")).accepted and check(rows(10, "x")).extra == 1
    assert not check(rows(9, "x")).enough_rows and not check(rows(10, " ")).accepted and not check(rows(10, "\ufffd")).accepted
    assert check(rows(10, "x"), found.where("end_page = 0")).missed == 1
    with pytest.raises(ValueError):
        truth.expected_runs(spark, {"fixtures": [{"pdf": "a", "expected": [{"pages": [3, 2]}]}]})


def test_command_line(spark, folder, tmp_path, capsys):
    assert cli.main(["classify", str(folder / "a.pdf"), "--json"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert [(r["start_page"], r["end_page"], r["total_rows"]) for r in found["runs"]] == [(2, 3, 17)] and len(found["page_scores"]) == 4
    assert cli.main(["classify", str(folder / "a.pdf")]) == 0 and "from page 2 to 3, 17 rows" in capsys.readouterr().out
    assert cli.main(["classify", str(folder / "none.pdf")]) == 2
    assert cli.main(["extract", str(folder / "a.pdf"), "--format", "csv", "--output", str(tmp_path)]) == 0
    assert (tmp_path / "a.csv").read_text("utf-8-sig").count("Relay") == 2 * 17
    assert cli.main(["extract", str(folder / "a.pdf"), "--format", "json", "--output", str(tmp_path), "--pages", "3"]) == 0
    got = json.loads((tmp_path / "a.json").read_text())
    assert got["total_rows"] == 6 and got["rows"][5]["schematic_position"] == "/1.5" and got["rows"][5]["quantity"] == 6
    assert cli.main(["extract", str(folder / "a.pdf"), "--output", str(tmp_path), "--pages", "2-3"]) == 0 and zipfile.is_zipfile(tmp_path / "a.xlsx")
    assert cli.main(["extract", str(folder / "b.pdf"), "--output", str(tmp_path)]) == 0 and not (tmp_path / "b.xlsx").exists()
    assert cli.main(["extract", str(folder / "none.pdf")]) == 1


def test_one_call_for_the_content_of_a_file(spark, folder):
    reader = Reader(spark, str(folder))
    found = reader.extract(reader.found_runs())
    assert as_bytes(found, "a.pdf", "csv").decode("utf-8-sig").count("Relay") == 2 * 17
    assert json.loads(as_bytes(found, "a.pdf", "json"))["total_rows"] == 17
    assert zipfile.is_zipfile(io.BytesIO(as_bytes(found, "a.pdf", "xlsx")))
    with pytest.raises(ValueError):
        as_bytes(found, "a.pdf", "doc")


def test_arrivals(spark, folder, tmp_path):
    _, pages, grids, _ = pdf.read_documents(spark, str(folder))
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages")
    grids.write.parquet(f"{tmp_path}/grids")
    own = tables.read_grids(spark, f"{tmp_path}/grids")
    watch(spark, f"{tmp_path}/pages", lambda batch: own.join(batch.select("doc", "page"), ["doc", "page"], "left_semi"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 17 and spark.read.parquet(f"{tmp_path}/out/audit").count() == 2


def test_search_and_union(rows):
    assert [r.row_index for r in canonical.search(rows, text_search="SAY").collect()] == [1]
    assert canonical.search(rows, sections=["MC"]).count() == 1 and canonical.search(rows, text_search="(", literal=True).count() == 0
    assert canonical.union({"p": rows, "q": rows}).columns[0] == "pdf" and canonical.union({}) is None


def test_spans(spark):
    df = spark.createDataFrame([([3, 4],), ([7],), ([],)], "pages array<int>")
    assert [r[0] for r in df.select(reports.page_span()).collect()] == ["3-4", "7", "—"]
    many = spark.createDataFrame([([[3, 4], [7], []],), ([[]],), (None,), ([[1, 2, 3], [9, 10]],)], "runs array<array<int>>")
    assert [r[0] for r in many.select(reports.run_list("runs")).collect()] == ["3-4, 7", "—", "—", "1-3, 9-10"]
    assert len(catalog.QUERIES) > 40

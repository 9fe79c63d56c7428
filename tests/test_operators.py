import dataclasses

from pyspark.sql import functions as F

from bomscope.config import ClassifierConfig, ColumnHeader, Continuity, ExtractorConfig, RowCount, SectionDetection, Title, VectorDensity, Zone
from bomscope.operators import canonical, columns, evaluate, rows, runs, sections, signals, tables
from bomscope.plans.lifecycle import extract

E = ExtractorConfig()
RAW = "doc string, page int, parser string, table_index int, headers array<string>, rows array<array<string>>, n_cols int, n_rows int"


def grid(n, width=4):
    return [["h"] * width] + [["x"] * width for _ in range(n)]


def test_row_count_bands(spark):
    cases = {1: ("none", 0.0), 2: ("negative", -2.0), 4: ("negative", -2.0), 5: ("weak", 1.0), 9: ("weak", 1.0), 10: ("strong", 3.0)}
    df = spark.createDataFrame([(str(n), 1, 0, grid(n)) for n in cases] + [("narrow", 1, 0, grid(12, 2)), ("tie", 1, 0, grid(6)), ("tie", 1, 1, grid(6)), ("null", 1, 0, [None, ["a", None, "  "]])], "doc string, page int, table_index int, grid array<array<string>>")
    got = {r.doc: r.row_count for r in signals.row_count(df, RowCount()).collect()}
    assert {n: (got[str(n)].qualification, got[str(n)].score) for n in cases} == cases
    assert got["narrow"].score == 0 and got["tie"].table_index == 0 and got["tie"].per_table == [6, 6] and got["null"].rows == 0


def test_vector_density_and_title(spark):
    df = spark.createDataFrame([(500, None, None), (500, 1, 0), (1499, 0, 0), (1000, 300, 200)], "a int, b int, c int")
    assert [r[0].score for r in df.select(signals.vector_density(F.col("a"), F.col("b"), F.col("c"), VectorDensity())).collect()] == [2.0, 0.0, 0.0, -1.0]
    pages = spark.createDataFrame([("  PARTS\n LIST and stuklijst",), ("nothing",), (None,), ("b�o�m",)], "t string")
    got = [r[0] for r in pages.select(signals.title("t", Title(patterns=["(", *Title().patterns]))).collect()]
    assert [(g.score, g["count"]) for g in got] == [(3.0, 2), (0.0, 0), (0.0, 0), (3.0, 1)]
    assert got[0].snippet == "PARTS LIST and stuklijst"


def test_column_header_picks_the_better_row_and_table(spark):
    heads = ["Item", "Qty", "Description", "Type"]
    df = spark.createDataFrame([("a", 1, 0, [["title", None, "", ""], heads]), ("a", 1, 1, [heads, ["x"] * 4]), ("b", 1, 0, [["x", "y"]]), ("c", 1, 0, [["Tag", "Qty", "Brand"], ["1"]])], "doc string, page int, table_index int, grid array<array<string>>")
    got = {r.doc: r.column_header for r in signals.column_header(df, ColumnHeader()).collect()}
    assert (got["a"].qualification, got["a"].table_index, got["a"].header_row, got["a"].headers) == ("strong", 0, 1, heads)
    assert (got["b"].score, got["b"].table_index) == (0.0, None) and (got["c"].qualification, got["c"].score) == ("weak", 5.0)


def test_continuity_reads_totals_before_any_bonus(spark):
    df = spark.createDataFrame([("d", p, float(s)) for p, s in enumerate([12, 5, 5, 0, 7], 1)] + [("gap", 1, 9.0), ("gap", 3, 9.0)], "doc string, page int, total_score double")
    got = sorted(tuple(r) for r in signals.continuity(df, Continuity()).select("doc", "page", "continuity.score").collect())
    assert [s for d, _, s in got if d == "d"] == [0, 2, 0, 2, 0] and [s for d, _, s in got if d == "gap"] == [0, 0]


def cluster(spark, pages, cfg=None):
    df = spark.createDataFrame([("d", i, float(s), list(fp), n) for i, (s, fp, n) in enumerate(pages, 1)], "doc string, page int, total_score double, best_table_headers array<string>, rows int")
    return [(r.start_page, r.end_page) for r in runs.cluster(df, cfg or ClassifierConfig()).orderBy("run_idx").collect()]


def test_clustering(spark):
    assert cluster(spark, [(13, "ab", 5), (7, "ab", 5), (6, "ab", 5), (13, "ab", 5)]) == [(1, 2), (4, 4)]
    assert cluster(spark, [(13, "abc", 5), (13, "abcd", 5), (13, "ade", 5)]) == [(1, 2), (3, 3)]
    assert cluster(spark, [(13, "abc", 5), (9, "", 5), (13, "xyz", 5)]) == [(1, 2), (3, 3)]
    assert cluster(spark, [(11.9, "ab", 50)] * 3) == []
    assert cluster(spark, [(13, "ab", 2)]) == []
    loose = dataclasses.replace(ClassifierConfig(), clustering=dataclasses.replace(ClassifierConfig().clustering, max_gap=1))
    assert cluster(spark, [(13, "ab", 5), (1, "", 0), (13, "ab", 5)], loose) == [(1, 3)]


def raw(spark, *made):
    out = []
    for i, (page, parser, heads, body) in enumerate(made):
        out.append(("d", page, parser, i, heads, body, len(heads), len(body)))
    return spark.createDataFrame(out, RAW)


def test_table_selection_and_preference(spark):
    heads = lambda n: ["Qty", *["x"] * (n - 1)]
    made = [(1, "pymupdf", heads(6), [["1"]] * 12), (1, "pymupdf", heads(7), [["1"]] * 3), (1, "pymupdf", heads(6), [["1"]] * 3), (1, "pymupdf", heads(3), [["1"]]), (1, "pymupdf", heads(12), [["1"]])]
    made += [(1, "pdfplumber", heads(4), [["1"]]), (2, "pdfplumber", ["Qty.", "a", "b", "c"], [["1"]]), (3, "pdfplumber", heads(5), [["1"]] * 6), (4, "pymupdf", heads(5), [])]
    got = tables.select_tables(raw(spark, *made), E)
    assert sorted((r.page, r.parser, r.table_index) for r in got.collect()) == [(1, "pdfplumber", 5), (1, "pymupdf", 2), (3, "pdfplumber", 7)]
    assert sorted((r.page, r.parser) for r in tables.prefer(got).collect()) == [(1, "pymupdf"), (3, "pdfplumber")]
    pages = spark.createDataFrame([("d", p) for p in (1, 2, 3)], "doc string, page int")
    said = {r.page: r.warning for r in tables.consensus(pages, got, 1).collect()}
    assert said == {1: "page 1: pymupdf=3 pdfplumber=1 diff=2 tolerance=1", 2: None, 3: "page 3: pymupdf=0 pdfplumber=6 diff=6 tolerance=1"}


def test_header_promotion(spark):
    made = [(1, "pymupdf", ["PARTS", "", "", ""], [["Tag", "Qty", "Descr", "x"], ["a", "1", "b", "c"]]), (2, "pymupdf", ["Tag", "Qty", "a", "b"], [["x", "Qty", "y", "z"]]), (3, "pymupdf", ["a", "b", "c", "d"], [])]
    got = {r.page: (r.headers[1], r.n_rows, r.promoted) for r in tables.promote_headers(raw(spark, *made), E.column_mapping).collect()}
    assert got == {1: ("Qty", 1, True), 2: ("Qty", 1, False), 3: ("b", 0, False)}


def parsed(spark, heads, body, cfg=E):
    return rows.parse_rows(columns.map_columns(raw(spark, (1, "pymupdf", heads, body)), cfg.column_mapping), cfg).orderBy("row_pos").collect()


def test_row_parser(spark):
    body = [[""] * 5, ["+MC", "", "", "", ""], ["", "2", "Relay", "x", "y"], ["-K1", "1", "Fuse", "", ""], ["", "", "Relay spare", "", ""], ["", "4", "", "", ""], ["", "1", "ragged"], ["", "1", "long", "a", "b", "c"]]
    got = parsed(spark, ["Item", "Qty", "Description", "Foo", "Foo"], body)
    assert [r.is_section_header for r in got] == [True, False, False, True, False, False, False]
    data = [r for r in got if not r.is_section_header]
    assert [r.device_tag for r in data] == ["+MC", "-K1", "Relay spare", "Relay spare", "Relay spare"]
    assert data[0].extra_fields == {"foo": "x", "foo__col_4": "y"} and data[3].extra_fields == {"foo": "", "foo__col_4": ""} and data[4].extra_fields == {"foo": "a", "foo__col_4": "b", "col_5": "c"}
    assert data[3].raw == ["", "1", "ragged"]


def test_merging_and_positional_tags(spark):
    got = parsed(spark, ["", "Qty", "Description", "Designation"], [["T1", "1", "A", "B"], ["T2", "1", "", "B"], ["T3", "1", "A", "A"], ["T4", "1", "A", ""]])
    assert [(r.device_tag, r.description) for r in got] == [("T1", "A\nB"), ("T2", "B"), ("T3", "A"), ("T4", "A")]


def test_uniform_rows(spark):
    pages = spark.createDataFrame([("d", 0, 0, 1), ("d", 0, 1, 2)], "doc string, run_idx int, pos int, page int")
    heads = ["Item", "Qty", "Description", "Type"]
    body = [["-K1", "3m", "Relay /12.3 x /4.5", "M�"], ["-K2", "2.0", "&EFS040/21.1:B", " N "], ["-K3", "1,5", "", "x"]]
    docs = spark.createDataFrame([("d",), ("none",)], "doc string")
    got = extract(docs, raw(spark, (1, "pymupdf", heads, body)), pages, None, E)
    out = got.rows.orderBy("row_index").collect()
    assert [r.schematic_position for r in out] == ["/12.3", "&EFS040/21.1:B", None]
    assert [r.warnings for r in out] == [["encoding_replacement_char_found:model_number", "quantity_unparseable:'3m'"], [], ["required_field_missing:description"]]
    assert out[1].model_number == "N" and out[1].quantity.d == 2.0 and out[2].description is None
    audit = {r.source_pdf: r for r in got.audit.collect()}
    assert (audit["d"].total_rows, audit["d"].rows_with_warnings, audit["d"].encoding_warnings_total, audit["d"].pages_without_table, audit["d"].note) == (3, 2, 1, [2], None)
    assert audit["d"].fields_never_populated == ["manufacturer", "order_number"] and audit["none"].note == "no_page_runs_provided"
    sheet = {r.row_index: r for r in canonical.import_sheet(got.rows).collect()}
    assert [sheet[i].aantal for i in range(3)] == ["3m", "2", "1.5"]
    assert sheet[0].opmerking == "encoding_replacement_char_found:model_number; quantity_unparseable:'3m'" and sheet[1].opmerking is None
    r = spark.createDataFrame([("MC", ["a", "b"]), ("MC", []), (None, [])], "source_section string, warnings array<string>").select(canonical.remark()).collect()
    assert [x[0] for x in r] == ["[MC] a; b", "[MC]", None]


def test_section_labels(spark):
    runs_ = spark.createDataFrame([("d", 0, 0, 1), ("d", 0, 1, 2), ("d", 1, 0, 5), ("one", 0, 0, 1)], "doc string, run_idx int, pos int, page int")
    tokens = [("d", 1, t) for t in ("+MC", "ACME", "12")] + [("d", 2, t) for t in ("+MC", "ACME")] + [("d", 5, t) for t in ("+FIELD", "ACME")] + [("one", 1, "+MC")]
    got = sections.labels(spark.createDataFrame(tokens, "doc string, page int, token string"), runs_)
    assert {(r.doc, r.run_idx): r.label for r in got.collect()} == {("d", 0): "+MC", ("d", 1): "+FIELD", ("one", 0): None}
    assert {r.page: r.source_section for r in sections.page_labels(got, runs_).where("doc = 'd'").collect()} == {1: "+MC", 2: "+MC", 5: "+FIELD"}
    words = [(0.0, 0.0, 5.0, 5.0, "far"), (60.0, 1.0, 70.0, 9.0, " top "), (1.0, 80.0, 9.0, 90.0, "low"), (1.0, 80.0, 9.0, 90.0, "x" * 16), (1.0, 80.0, 9.0, 90.0, "y")]
    page = spark.createDataFrame([("d", 1, 100.0, 100.0, words)], "doc string, page int, width double, height double, words array<struct<x0:double,y0:double,x1:double,y1:double,word:string>>")
    assert sorted(r.token for r in sections.zone_tokens(page, SectionDetection()).collect()) == ["low", "top"]
    assert sections.zone_tokens(page, SectionDetection(zones=[Zone(0, 0, 0.1, 0.1)])).count() == 1


def test_evaluation(spark):
    make = lambda *x: spark.createDataFrame([("d", *r) for r in x], "doc string, start_page int, end_page int")
    expected, found = make((33, 35), (47, 51), (90, 92)), make((33, 36), (45, 48), (49, 51), (70, 71))
    got = {r.exp_start: (r.got_start, r.found, r.ends_right) for r in evaluate.best_overlap(expected, found).collect()}
    assert got == {33: (33, True, True), 47: (49, True, False), 90: (None, False, False)}
    assert evaluate.extra_pages(expected, found).first().extra == 5

"""Queries over the driver's tables, one or more for every operator, by way of the adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ClassifierConfig, ColumnHeader, ExtractorConfig, Title, VectorDensity
from ..functions import matching, quantity, text
from ..operators import audit, canonical, columns, evaluate, rows, runs, sections, signals, tables
from ..sinks import files, reports
from ..sources import ranges
from . import adapters as A
from . import lifecycle

C, E = ClassifierConfig(), ExtractorConfig()
#: Words that occur in the conversations, in place of titles of drawings, which don't.
TITLES = ["ation", "th[aeiou]r", "qu[ei]", "zz+top", "no[a-z]*ing"]
HEADER_WORDS = [
    "quantty", "modelnumber", "omschrijvng", "mount", "cost", "name", "date", "rate", "code", "page", "prop", "placement", "part number", "mpn", "no", "note",
    "unit", "size", "price", "remark", "Qty.", "Qty. :", "Pcs:", "AANTAL", "  Device\n Tag ", "Sr� No", "", "Description...", "Order  No.", "schematic/postion", "pos", "typ", "typo", "item list",
]
#: Documents of the list without a single page.
WITHOUT_PAGES = ["none 1", "none 2"]
QUANTITIES = [
    "", "  ", " 7 ", "+5", "-3", "00012", "1_000", "1,5", "1,234", "1.", ".5", "1e3", "3m", "1x", "1d", "0x1A", "1 000", "1.234,5", "1,234,567", "12345678901234567890", "1__0", "_1", "1e", ".", "+", "-.5e-2", "7f", "it's", "a\"b",
]
RANGES = ["33-35,47-51", "33-35, 47", "35-33", ",,", " 7 , 9 - 11 ", "5", "2-2,2"]


def _literal(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"i int, {name} string")


def _joined(c: str | Column) -> Column:
    return F.concat_ws("|", c)


def title_signal(spark: SparkSession, d: str) -> DataFrame:
    s = A.turns(spark, d).select("doc", "page", signals.title("text", Title(patterns=TITLES)).alias("t"))
    return s.select("doc", "page", "t.score", F.col("t.count").alias("n_patterns"), _joined("t.patterns").alias("patterns"))


def title_snippet(spark: SparkSession, d: str) -> DataFrame:
    s = A.turns(spark, d).select("doc", "page", signals.title("text", Title(patterns=TITLES[:1])).alias("t"))
    return s.where("t.found").select("doc", "page", "t.snippet")


def title_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The snippet of the first of all patterns that a page has, in the settings' order."""
    s = A.turns(spark, d).select("doc", "page", signals.title("text", Title(patterns=TITLES)).alias("t"))
    return s.where("t.found").select("doc", "page", "t.snippet")


def title_unicode(spark: SparkSession, d: str) -> DataFrame:
    """The settings' own title patterns on titles parted by blanks of several alphabets, and in capitals with accents."""
    gap = F.expr("element_at(array(' ', '\u00a0', '\u2003 ', '\n', '', '-'), int(p_partkey % 6) + 1)")
    page = F.concat(F.lit("Sheet "), F.col("p_partkey").cast("string"), F.lit(": PARTS"), gap, F.lit("List, "), "p_name")
    s = A.load(spark, d, "part").select("p_partkey", signals.title(page, C.signals.title).alias("t"))
    return s.select("p_partkey", "t.score", F.col("t.count").alias("n_patterns"))


def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose descriptions are missing, empty or blanks of any kind."""
    said = F.expr("CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' \u00a0 ' WHEN 2 THEN NULL ELSE p_name END")
    none = F.lit(None).cast("string")
    row = [F.lit("d").alias("doc"), F.lit(1).alias("page"), F.col("p_partkey").alias("row_index"), F.lit("1").alias("quantity"), said.alias("description"), none.alias("device_tag"), F.col("p_type").alias("model_number")]
    row += [none.alias(f) for f in ("manufacturer", "order_number", "schematic_position")]
    rows = A.load(spark, d, "part").select(*row, F.create_map().cast("map<string,string>").alias("extra_fields"), F.array().cast("array<string>").alias("raw"))
    out = canonical.require_fields(canonical.project(rows, E.post_processing), E.validation)
    return out.select("row_index", "description", _joined("warnings").alias("warnings"))


def header_normalize(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit("  "), F.initcap("p_name"), F.when(F.col("p_partkey") % 3 == 0, "\n\tNo. :").when(F.col("p_partkey") % 3 == 1, " :. ").otherwise(".:"), F.when(F.col("p_partkey") % 5 == 0, "�").otherwise(""))
    p = A.load(spark, d, "part").select("p_partkey", dirty.alias("h"))
    return p.select("p_partkey", text.header_a("h").alias("a"), text.header_b("h").alias("b"), text.header_c("h").alias("c"))


def header_match(spark: SparkSession, d: str) -> DataFrame:
    words = A.load(spark, d, "part").select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("h")).unionByName(_literal(spark, HEADER_WORDS, "h").select("h")).distinct()
    m = matching.column_match("h", E.column_mapping.synonyms)
    found = words.select("h", matching.page_category("h", C.signals.column_header.synonyms).alias("category"), m.alias("m"), matching.is_quantity("h", E.column_mapping.synonyms["quantity"]).alias("is_quantity"))
    return found.select("h", "category", F.col("m.category").alias("field"), "m.method", "m.distance", "m.synonym", "is_quantity")


def column_header_signal(spark: SparkSession, d: str) -> DataFrame:
    s = signals.column_header(A.grids(spark, d), ColumnHeader()).select("doc", "page", "column_header.*")
    return s.select("doc", "page", "score", "categories_found", "qualification", _joined("categories").alias("categories"), _joined("headers").alias("headers"), "table_index", "header_row", F.col("tables_scanned").cast("long").alias("tables_scanned"))


def row_count_signal(spark: SparkSession, d: str) -> DataFrame:
    s = signals.row_count(A.grids(spark, d), C.signals.row_count).select("doc", "page", "row_count.*")
    return s.select("doc", "page", "score", "rows", "qualification", "table_index", F.col("candidates").cast("long").alias("candidates"), _joined(F.col("per_table").cast("array<string>")).alias("per_table"))


def vector_density(spark: SparkSession, d: str) -> DataFrame:
    cfg = VectorDensity(quiet_threshold=8, noisy_threshold=14)
    s = A.html_pages(spark, d)
    return s.select("doc", signals.vector_density(F.col("n_lines"), F.col("n_curves"), F.col("n_rects"), cfg).alias("v")).select("doc", "v.score", "v.primitives")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return signals.page_scores(A.order_pages(spark, d), A.grids(spark, d), C)


def page_score(spark: SparkSession, d: str) -> DataFrame:
    s = _scores(spark, d)
    return s.select("doc", "page", F.col("title.score").alias("title"), F.col("column_header.score").alias("header"), F.col("row_count.score").alias("row_score"), F.col("vector_density.score").alias("density"), "total_score", "best_table_index", _joined("best_table_headers").alias("headers"), "rows")


def _continued(spark: SparkSession, d: str) -> DataFrame:
    return signals.continuity(_scores(spark, d), C.signals.continuity)


def continuity(spark: SparkSession, d: str) -> DataFrame:
    return _continued(spark, d).select("doc", "page", F.col("continuity.score").alias("bonus"), "total_score")


def runs_islands(spark: SparkSession, d: str) -> DataFrame:
    return runs.islands(_continued(spark, d), C.scoring.weak_match, C.clustering.max_gap).select("doc", "page", "island")


def runs_fold(spark: SparkSession, d: str) -> DataFrame:
    return runs.assign_runs(_continued(spark, d), C).select("doc", "island", "part", "page", _joined("prints").alias("prints"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    r = lifecycle.classify(A.order_pages(spark, d), A.grids(spark, d), C).runs
    return r.select("doc", "run_idx", "start_page", "end_page", _joined(F.col("pages").cast("array<string>")).alias("pages"), F.round("mean_score", 6).alias("mean_score"), _joined("column_fingerprint").alias("fingerprint"), "total_rows", F.round("confidence", 6).alias("confidence"), "signals_summary.strong_pages", "signals_summary.weak_pages")


def top10_pages(spark: SparkSession, d: str) -> DataFrame:
    """The ten best pages of each document, which is what the operator is for; five documents are bound as one of 40 pages."""
    bound = _continued(spark, d).withColumn("page", F.expr("int(bigint(doc) % 5 * 8) + page")).withColumn("doc", F.expr("string(bigint(doc) div 5)"))
    return runs.top_pages(bound).select("doc", "page", "rank", "total_score")


def page_report(spark: SparkSession, d: str) -> DataFrame:
    p = reports.page_rows(_continued(spark, d))
    return p.select("doc", "page_number", "total_score", "row_count", *[F.col(f"signals.{s}").alias("row_score" if s == "row_count" else s) for s in reports.SIGNALS])


def _promoted(spark: SparkSession, d: str) -> DataFrame:
    return tables.promote_headers(A.raw_tables(spark, d), E.column_mapping)


def promote_header(spark: SparkSession, d: str) -> DataFrame:
    return _promoted(spark, d).select("doc", "page", "parser", "table_index", "promoted", _joined("headers").alias("headers"), "n_rows", "n_cols")


def select_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.select_tables(_promoted(spark, d), E).select("doc", "page", "parser", "table_index", "n_rows", "n_cols")


def parser_preference(spark: SparkSession, d: str) -> DataFrame:
    return tables.prefer(tables.select_tables(_promoted(spark, d), E)).select("doc", "page", "parser", "table_index", "n_rows")


def consensus(spark: SparkSession, d: str) -> DataFrame:
    return tables.consensus(A.page_runs(spark, d), tables.select_tables(_promoted(spark, d), E), 1).select("doc", "page", "primary_rows", "secondary_rows", "warning")


def pages_without_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.pages_without_table(A.page_runs(spark, d), tables.select_tables(_promoted(spark, d), E)).select("doc", "page")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return columns.map_columns(tables.prefer(tables.select_tables(_promoted(spark, d), E)), E.column_mapping)


def map_columns(spark: SparkSession, d: str) -> DataFrame:
    return columns.mapping_rows(_mapped(spark, d))


def merged_columns(spark: SparkSession, d: str) -> DataFrame:
    return rows.merged_columns(_mapped(spark, d)).select("doc", "page", "canonical_field", "columns")


def section_rows(spark: SparkSession, d: str) -> DataFrame:
    marked = rows.mark_rows(rows.explode_rows(_mapped(spark, d)), E)
    return marked.select("doc", "page", "row_pos", "is_section_header", F.get("raw", 0).alias("first_cell"))


def inherit_tag(spark: SparkSession, d: str) -> DataFrame:
    return rows.parse_rows(_mapped(spark, d), E).where("not is_section_header").select("doc", "page", "row_pos", "device_tag", "inherited_device_tag")


def extra_fields(spark: SparkSession, d: str) -> DataFrame:
    p = rows.parse_rows(_mapped(spark, d), E).where("not is_section_header")
    return p.select("doc", "page", "row_pos", "description", F.to_json("extra_fields").alias("extra"))


def parse_quantity(spark: SparkSession, d: str) -> DataFrame:
    said = A.lines(spark, d).select(F.col("qty").alias("raw")).unionByName(_literal(spark, QUANTITIES, "raw").select("raw"))
    q = said.groupBy("raw").agg(F.count("*").alias("n")).withColumn("q", quantity.parse("raw")).withColumn("warning", quantity.warning("raw", F.col("q")))
    return q.select("raw", "n", "q.kind", F.col("q.i").cast("string").alias("i"), "q.d", "q.s", "warning")


def _extracted(spark: SparkSession, d: str) -> lifecycle.Extracted:
    pages = A.page_runs(spark, d)
    documents = pages.select("doc").distinct().unionByName(_literal(spark, WITHOUT_PAGES, "doc").select("doc"))
    return lifecycle.extract(documents, A.raw_tables(spark, d), pages, None, E)


def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    r = _extracted(spark, d).rows
    return r.select("source_pdf", "source_page", "source_section", "row_index", "device_tag", quantity.as_text("quantity").alias("quantity"), F.col("quantity.kind").alias("quantity_kind"), "description", "manufacturer", "model_number", "order_number", "schematic_position", F.to_json("extra_fields").alias("extra_fields"), _joined("raw").alias("raw"), _joined("warnings").alias("warnings"))


def validation_audit(spark: SparkSession, d: str) -> DataFrame:
    a = _extracted(spark, d).audit
    return a.select("source_pdf", "total_rows", "note", "rows_with_warnings", "encoding_warnings_total", _joined("consensus_warnings").alias("consensus"), _joined(F.col("pages_with_consensus_issues").cast("array<string>")).alias("issue_pages"), _joined(F.col("pages_without_table").cast("array<string>")).alias("tableless"), _joined("fields_never_populated").alias("never"))


def _sectioned(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).rows.withColumn("source_section", F.expr("CASE WHEN source_page % 3 = 0 THEN concat('S', source_page) END"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return audit.metrics(_sectioned(spark, d))


def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return audit.fill_rates(_extracted(spark, d).rows).select("source_pdf", "field", F.round("filled", 6).alias("filled"))


def search_filter(spark: SparkSession, d: str) -> DataFrame:
    r = canonical.search(_extracted(spark, d).rows, text_search="SEE /1[0-9]|green")
    return r.select("source_pdf", "row_index", "description")


def search_literal(spark: SparkSession, d: str) -> DataFrame:
    r = canonical.search(_extracted(spark, d).rows, pdf="3", text_search="/12.3", literal=True)
    return r.select("source_pdf", "row_index", "description")


def union_docs(spark: SparkSession, d: str) -> DataFrame:
    r = _extracted(spark, d).rows.select("source_pdf", "row_index", "device_tag")
    return canonical.union({"even": r.where("source_pdf % 2 = 0"), "odd": r.where("source_pdf % 2 = 1")})


def import_sheet(spark: SparkSession, d: str) -> DataFrame:
    return canonical.import_sheet(_extracted(spark, d).rows)


def order_sheet(spark: SparkSession, d: str) -> DataFrame:
    return canonical.order_sheet(canonical.import_sheet(_extracted(spark, d).rows))


def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d).rows.select(*files.csv_columns())


def _turn_runs(spark: SparkSession, d: str) -> DataFrame:
    return A.turn_words(spark, d).select("doc", "run_idx", "pos", "page")


def zone_tokens(spark: SparkSession, d: str) -> DataFrame:
    return sections.zone_tokens(A.turn_words(spark, d), E.section_detection)


def section_labels(spark: SparkSession, d: str) -> DataFrame:
    every = A.turn_words(spark, d).select("doc", "page", F.explode("words.word").alias("token")).where("length(token) between 2 and 15").distinct()
    return sections.labels(every, _turn_runs(spark, d))


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    tokens = sections.zone_tokens(A.turn_words(spark, d), E.section_detection)
    return sections.page_labels(sections.labels(tokens, _turn_runs(spark, d)), _turn_runs(spark, d))


def _ranges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = A.load(spark, d, "orders").selectExpr("string(o_orderkey div 6) AS doc", "o_orderkey AS k", "int(o_orderkey % 6) AS i", "int(o_custkey % 7) AS w")
    return o.where("i % 2 = 0").selectExpr("doc", "i * 5 + 1 AS start_page", "i * 5 + 1 + w AS end_page"), o.where("i % 2 = 1").selectExpr("doc", "i * 5 - 3 AS start_page", "i * 5 - 3 + w AS end_page")


def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.overlaps(*_ranges(spark, d))


def best_overlap(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_overlap(*_ranges(spark, d))


def extra_pages(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.extra_pages(*_ranges(spark, d))


def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    return ranges.page_runs(_literal(spark, RANGES, "spec").select(F.col("spec").alias("doc"), "spec"))


def page_spans(spark: SparkSession, d: str) -> DataFrame:
    r = A.page_runs(spark, d).groupBy("doc", "run_idx").agg(F.collect_list("page").alias("pages"))
    return r.select("doc", "run_idx", reports.page_span().alias("span"))


def run_lists(spark: SparkSession, d: str) -> DataFrame:
    """All runs of a document as one text; a document whose number divides by 5 has none."""
    r = A.page_runs(spark, d).groupBy("doc", "run_idx").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    every = r.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("run_idx", "pages"))), lambda x: x["pages"]).alias("runs"))
    return every.select("doc", reports.run_list(F.when(F.expr("bigint(doc) % 5 = 0"), F.array().cast("array<array<int>>")).otherwise(F.col("runs"))).alias("said"))


def acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Ranges and rows made from orders against what is expected of them."""
    expected, found = _ranges(spark, d)
    rows = A.load(spark, d, "orders").selectExpr("string(o_orderkey div 6) AS source_pdf", "CASE WHEN o_custkey % 4 = 0 THEN '   ' WHEN o_custkey % 50 = 1 THEN 'a�' ELSE o_orderpriority END AS description")
    out = evaluate.acceptance(expected.withColumn("approx_rows", F.expr("end_page - start_page")), found, rows)
    return out.withColumn("described", F.round("described", 6))


def section_names(spark: SparkSession, d: str) -> DataFrame:
    return audit.sections(_sectioned(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    title_signal, title_snippet, title_snippets, title_unicode, required_fields, header_normalize, header_match, column_header_signal, row_count_signal, vector_density, page_score, continuity, runs_islands, runs_fold, run_summary,
    top10_pages, page_report, promote_header, select_table, parser_preference, consensus, pages_without_table, map_columns, merged_columns, section_rows, inherit_tag, extra_fields,
    parse_quantity, canonical_rows, validation_audit, metrics, fill_rates, search_filter, search_literal, union_docs, import_sheet, order_sheet, csv_rows, zone_tokens, section_labels,
    page_sections, overlap_join, best_overlap, extra_pages, page_ranges, page_spans, run_lists, acceptance, section_names,
)}

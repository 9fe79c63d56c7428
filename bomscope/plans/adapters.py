"""Pages and tables made from the driver's tables, by arithmetic on their keys, so that SQL can make the same.

Orders are pages, eight to a document; their lines are the rows of a parts list, with dirt put in by key. Turns of
conversations are pages of text. Every eighth rule below is some case that real drawings have: section rows, blank rows,
title rows over the header, misspelt headers, a missing parser, decoy tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import literal
from ..operators.tables import PRIMARY, SECONDARY

HEADERS = [
    ["Item", "Qty", "Description", "Type", "Supplier", "Foo"],
    ["Pos.", "Quantty", "Omschrijvng", "Model No", "Fabrikant", "Foo"],
    ["", "Amount", "Function text", "Type number", "Make", "Designation"],
    ["Tag", "Pcs", "Descr", "Model", "Brand", "Foo"],
]
TITLE = ["PARTS LIST", "", "", "", "", ""]
DECOYS = {1: (["A", "Qty", "B"], ["a", "1", "b"], 5), 2: (["Item", "Qty", "Description", "Type", "Make", "Foo"], ["-X1", "1", "Decoy", "T", "M", ""], 7)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, rn, l_partkey, tag, qty, descr, model, maker, note): the cells of an order's lines."""
    every = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")).join(load(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
    return every.selectExpr(
        "l_orderkey AS o",
        "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn",
        "l_partkey",
        "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('-K', l_linenumber) END AS tag",
        "CASE WHEN l_partkey % 7 = 0 THEN '1,5' WHEN l_partkey % 11 = 0 THEN '3m' WHEN l_partkey % 13 = 0 THEN '' ELSE string(int(l_quantity)) END AS qty",
        "concat(p_name, CASE WHEN l_partkey % 17 = 0 THEN ' see /12.3' ELSE '' END, CASE WHEN l_partkey % 19 = 0 THEN '�' ELSE '' END) AS descr",
        "p_type AS model",
        "s_name AS maker",
        "CASE WHEN l_suppkey % 3 = 0 THEN concat('x', l_suppkey) ELSE '' END AS note",
    )


def _place(o: str = "o") -> list[Column]:
    return [F.expr(f"string({o} div 8)").alias("doc"), F.expr(f"int({o} % 8) + 1").alias("page")]


def _strings(values: list[str]) -> Column:
    return literal(values)


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, parser, table_index, headers, rows, n_cols, n_rows, o)"""
    own = lines(spark, sf_dir)
    row = F.struct("rn", F.array("tag", "qty", "descr", "model", "maker", "note").alias("cells"))
    seen = F.col("l_partkey") % 4 != 0  # the second parser misses some rows
    grouped = own.groupBy("o").agg(F.array_sort(F.collect_list(row)).alias("one"), F.array_sort(F.collect_list(F.when(seen, row))).alias("two"))  # an order's lines
    o = F.col("o")
    section = F.when(o % 3 == 0, F.array(F.array(F.concat(F.lit("+S"), (o % 10).cast("string")), *[F.lit("")] * 5)))
    tail = F.when(o % 4 == 1, F.array(_strings([""] * 6)))
    none = F.array().cast("array<array<string>>")
    kind = o % 4
    headers = F.when(kind == 3, _strings(TITLE))
    for k in range(3):
        headers = F.when(kind == k, _strings(HEADERS[k])).otherwise(headers)

    def body(which: str) -> Column:
        return F.concat(F.coalesce(section, none), F.transform(which, lambda x: x["cells"]), F.coalesce(tail, none))

    def table(parser: str, index: int, heads: Column, rows: Column, there: Column) -> Column:
        return F.when(there, F.struct(F.lit(parser).alias("parser"), F.lit(index).alias("table_index"), heads.alias("headers"), rows.alias("rows")))

    titled = F.when(kind == 3, F.array(_strings(HEADERS[3]))).otherwise(none)
    first = o % 9 != 4  # else the first parser is missing
    both = grouped.select("o", headers.alias("headers"), body("one").alias("one"), body("two").alias("two"))
    found = [table(PRIMARY, 0, F.col("headers"), F.concat(titled, "one"), first & (F.size("one") > 0)), table(SECONDARY, 0, F.col("headers"), F.concat(titled, "two"), F.size("two") > 0)]
    found += [table(PRIMARY, i, _strings(heads), F.array(_strings(cells)), first & (o % every == 0)) for i, (heads, cells, every) in DECOYS.items()]
    out = both.select("o", F.inline(F.array_compact(F.array(*found))))  # all of an order's tables from one row
    return out.select(*_place(), "parser", "table_index", "headers", "rows", F.size("headers").alias("n_cols"), F.size("rows").alias("n_rows"), "o")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary parser's tables as grids, header first."""
    t = raw_tables(spark, sf_dir).where(F.col("parser") == PRIMARY)
    return t.select("doc", "page", "table_index", F.concat(F.array("headers"), "rows").alias("grid"))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order that has lines: text and counts of drawn lines by its key."""
    o = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o")).distinct()
    text = F.expr("CASE WHEN o % 6 = 0 THEN 'Sheet 3\nPARTS  LIST of panel' WHEN o % 10 = 0 THEN 'Stuklijst kast' ELSE 'wiring diagram' END")
    return o.select(*_place(), text.alias("text"), F.expr("int(o * 37 % 2000)").alias("n_lines"), F.expr("int(o % 5)").alias("n_curves"), F.lit(None).cast("int").alias("n_rects"))


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs for each document: its first four and its last four pages."""
    return order_pages(spark, sf_dir).selectExpr("doc", "int((page - 1) div 4) AS run_idx", "int((page - 1) % 4) AS pos", "page")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages."""
    return load(spark, sf_dir, "conversations").selectExpr("string(conv_id) AS doc", "int(turn) + 1 AS page", "text")


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages of 100 x 100 with their words in boxes, four conversations to a document."""
    t = load(spark, sf_dir, "conversations").selectExpr("string(conv_id div 4) AS doc", "int(conv_id % 4) * 100 + int(turn) + 1 AS page", "int(conv_id % 4) AS run_idx", "int(turn) AS pos", "split(regexp_replace(lower(text), '[^a-z]+', ' '), ' ') AS w")
    words = F.expr("transform(w, (x, i) -> struct(double(i * 7 % 100) AS x0, double(i * 13 % 100) AS y0, double(i * 7 % 100 + 5) AS x1, double(i * 13 % 100 + 4) AS y1, x AS word))")
    return t.select("doc", "page", "run_idx", "pos", F.lit(100.0).alias("width"), F.lit(100.0).alias("height"), words.alias("words"))


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages, their list items, links and paragraphs standing for drawn lines, curves and rectangles."""
    count = lambda tag: F.expr(f"int((length(html) - length(replace(html, '{tag}', ''))) / {len(tag)})")
    return load(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc"), F.lit(1).alias("page"), count("<li").alias("n_lines"), count("<a").alias("n_curves"), count("<p").alias("n_rects"))

"""Some of the catalog's queries against their SQL; all of them at a larger size are for the driver."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = ["title_signal", "header_match", "row_count_signal", "runs_fold", "consensus", "parse_quantity", "canonical_rows", "validation_audit", "section_labels", "best_overlap", "page_ranges"]


def plain(v):
    if v is None or repr(v) == "<NA>" or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and v == int(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want, got = con.execute(__spark_entry__.oracle_sql()[name]).df(), __spark_entry__.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    shape = lambda df: sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False, name=None))
    assert shape(got) == shape(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_snippets_of_all_title_patterns(spark):
    test_query_is_its_sql(spark, "title_snippets")
    first, every = (__spark_entry__.queries()[n](spark, SF).count() for n in ("title_snippet", "title_snippets"))
    assert every > first > 0


def test_every_query_has_sql_or_a_reason():
    without = {n for n in __spark_entry__.queries() if n not in __spark_entry__.oracle_sql()}
    assert all(n.startswith("op") or n == "pipeline" for n in without)

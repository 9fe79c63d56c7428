import pytest
from pyspark.sql import functions as F

from bomscope.config import CLASSIFIER_SYNONYMS, EXTRACTOR_SYNONYMS, ClassifierConfig, load_yaml, override
from bomscope.functions import matching, quantity, text

# header: classifier (category), mapper (field, distance), selection
MATCHES = {
    "quantty": ("quantity", "quantity", 1, True), "modelnumber": ("model", "model_number", 1, False), "omschrijvng": ("description", "description", 1, False),
    "mount": ("location", "quantity", 1, True), "cost": ("quantity", "device_tag", 2, True), "name": ("description", "manufacturer", 2, False), "code": ("description", "model_number", 2, False),
    "page": ("device_tag", "device_tag", 2, False), "prop": (None, "device_tag", 2, False), "placement": ("location", "device_tag", 0, False), "part number": ("model", "order_number", 0, False),
    "no": ("device_tag", None, 0, False), "note": ("description", None, 0, False), "unit": (None, None, 0, False), "price": (None, None, 0, False), "Qty.": ("quantity", "quantity", 0, False),
}
NUMBERS = {
    "": None, "  ": None, " 7 ": ("int", 7), "+5": ("int", 5), "-3": ("int", -3), "00012": ("int", 12), "1_000": ("int", 1000), "9223372036854775808": ("int", 9223372036854775808), "٣": ("int", 3),
    "1,5": ("float", 1.5), "1,234": ("float", 1.234), "1.": ("float", 1.0), ".5": ("float", 0.5), "1e3": ("float", 1000.0), "inf": ("float", float("inf")), "-infinity": ("float", float("-inf")),
    "3m": ("text", "3m"), "1x": ("text", "1x"), "1d": ("text", "1d"), "0x1A": ("text", "0x1A"), "1 000": ("text", "1 000"), "1.234,5": ("text", "1.234,5"), "1,234,567": ("text", "1,234,567"), "1__0": ("text", "1__0"),
}


def column(spark, values, *exprs):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_header_matches(spark):
    m = matching.column_match("v", EXTRACTOR_SYNONYMS)
    got = column(spark, list(MATCHES), "v", matching.page_category("v", CLASSIFIER_SYNONYMS), m["category"], m["distance"], matching.is_quantity("v", EXTRACTOR_SYNONYMS["quantity"]))
    assert {r[0]: r[1:] for r in got} == MATCHES


def test_headers_are_normalised_three_ways(spark):
    got = column(spark, [" Qty. : ", "Sr� No", "A \n B..", "...", None], text.header_a("v"), text.header_b("v"), text.header_c("v"))
    assert got == [("qty", "qty.", "qty. :"), ("sr. no", "sr. no", "sr� no"), ("a b", "a b", "a b.."), (None, "", "..."), (None, "", "")]
    assert [text.word_a("Qty. :"), text.word_b("Qty. :"), text.word_c(" Qty. ")] == ["qty", "qty.", "qty."]


def test_quantities(spark):
    q = quantity.parse("v")
    got = {r[0]: r[1:] for r in column(spark, list(NUMBERS), "v", q["kind"], q["i"], q["d"], q["s"], quantity.warning("v", q))}
    for raw, want in NUMBERS.items():
        kind, i, d, s, warning = got[raw]
        assert (None if kind is None else (kind, {"int": i, "float": d, "text": s}[kind])) == want, raw
        assert warning == (f"quantity_unparseable:{raw!r}" if want and want[0] == "text" else None)
    nan = column(spark, ["nan"], quantity.parse("v")["d"])[0][0]
    assert nan != nan
    odd = ["it's", 'say "x"', "both ' and \"", "back\\slash\n"]
    assert [r[0] for r in column(spark, odd, quantity.quoted(F.col("v")))] == [repr(x) for x in odd]


@pytest.mark.parametrize(("value", "number"), [("1x", True), ("3m", True), ("3 m", True), ("1,5", True), ("3mm", False), ("1.234,5", False), ("10 pcs", False), (".5", False), ("1e3", False), (None, False)])
def test_looks_numeric(spark, value, number):
    assert column(spark, [value], text.looks_numeric("v")) == [(number,)]


def test_small_text_rules(spark):
    assert [r[0] for r in column(spark, ["12", "--", "__", "²³", "x", "+MC", "É1", "ⅧⅧ"], text.trivial("v"))] == [True] * 5 + [False] * 3
    assert column(spark, ["a b​c﻿"], text.clean_blanks("v")) == [("a b c ",)]
    assert column(spark, ["a\x01b\tc�"], text.page_text("v")) == [("a.b\tc.",)]
    assert column(spark, ["  x \n"], text.strip("v")) == [("x",)]
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), ([], ["a"])], "a array<string>, b array<string>")
    assert [round(r[0], 3) for r in sets.select(text.jaccard("a", "b")).collect()] == [0.333, 1.0, 0.0]


def test_settings(tmp_path):
    cfg = override(ClassifierConfig(), {"scoring": {"weak_match": 5.0}, "signals": {"title": {"patterns": ["x"]}}})
    assert (cfg.scoring.weak_match, cfg.scoring.strong_match, cfg.signals.title.patterns, cfg.signals.title.weight) == (5.0, 12.0, ["x"], 3.0)
    with pytest.raises(ValueError, match="unknown"):
        override(ClassifierConfig(), {"no_such": 1})
    path = tmp_path / "c.yaml"
    path.write_text("clustering: {max_gap: 2}\n")
    assert load_yaml(str(path), ClassifierConfig()).clustering.max_gap == 2
    assert sum(map(len, CLASSIFIER_SYNONYMS.values())) == sum(map(len, EXTRACTOR_SYNONYMS.values())) == 61

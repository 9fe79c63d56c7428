"""Settings of both halves of the engine, with the values it ships with, and loading of YAML overrides."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

# The words that column headers use. Their order decides ties.
CLASSIFIER_SYNONYMS: dict[str, list[str]] = {
    "device_tag": ["device tag", "tag", "item", "item no", "item number", "pos", "position", "nr", "no", "sr no", "sr. no", "ref", "reference", "part"],
    "quantity": ["quantity", "qty", "qty reqd", "qty req", "aantal", "stuks", "amount", "pcs", "count"],
    "description": ["description", "descr", "designation", "declaration", "omschrijving", "function text", "note", "notes"],
    "model": ["model number", "model", "model no", "type number", "type", "mpn", "part number", "part no"],
    "manufacturer": ["manufacturer", "manuf", "make", "brand", "fabrikant", "leverancier", "vendor", "supplier"],
    "order_number": ["order number", "order no", "order nr", "artikelnummer", "gpn", "sku", "catalog number"],
    "location": ["schematic/position", "schematic/postion", "schematic", "placement", "location", "mounting", "mount"],
}
EXTRACTOR_SYNONYMS: dict[str, list[str]] = {
    "device_tag": ["device tag", "device tag placement", "device tag/placement", "tag", "tag/placement", "placement", "item", "item no", "item number", "pos", "position", "nr", "sr no", "sr. no", "ref", "reference", "part"],
    "quantity": ["quantity", "qty", "qty reqd", "qty req", "aantal", "stuks", "amount", "pcs", "count"],
    "description": ["description", "descr", "designation", "declaration", "omschrijving", "function text"],
    "model_number": ["model number", "model", "model no", "type number", "type"],
    "order_number": ["order number", "order no", "order nr", "artikelnummer", "part number", "part no", "mpn", "gpn", "sku", "catalog number"],
    "manufacturer": ["manufacturer", "manuf", "make", "brand", "fabrikant", "leverancier", "vendor", "supplier"],
    "schematic_position": ["schematic/position", "schematic/postion", "schematic", "placement", "location", "mounting"],
}
# Titles of parts-list pages.
TITLE_PATTERNS = [
    r"\bitem[\s_-]*list\b", r"\bparts?[\s_-]*list\b", r"\bbill\s+of\s+materials?\b", r"\bB\.?O\.?M\.?\b", r"\bstuklijst\b", r"\bonderdelenlijst\b",
    r"\bmateriaallijst\b", r"\bequipment\s+list\b", r"\bcomponent\s+list\b", r"\bmateriallist\b", r"\barticle\s+list\b",
]
#: The uniform output fields, in order.
CANONICAL_FIELDS = ["device_tag", "quantity", "description", "manufacturer", "model_number", "order_number", "schematic_position"]


@dataclass(frozen=True)
class Title:
    enabled: bool = True
    weight: float = 3.0
    patterns: list[str] = field(default_factory=lambda: list(TITLE_PATTERNS))


@dataclass(frozen=True)
class ColumnHeader:
    enabled: bool = True
    strong_weight: float = 10.0
    weak_weight: float = 5.0
    strong_threshold: int = 4
    weak_threshold: int = 3
    fuzzy_max_distance: int = 2
    synonyms: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in CLASSIFIER_SYNONYMS.items()})


@dataclass(frozen=True)
class RowCount:
    enabled: bool = True
    strong_threshold: int = 10
    strong_weight: float = 3.0
    weak_threshold: int = 5
    weak_weight: float = 1.0
    negative_threshold: int = 5
    negative_weight: float = -2.0


@dataclass(frozen=True)
class VectorDensity:
    enabled: bool = True
    weight: float = 2.0
    quiet_threshold: int = 500
    noisy_threshold: int = 1500
    noisy_penalty: float = -1.0


@dataclass(frozen=True)
class Continuity:
    enabled: bool = True
    weight: float = 2.0
    base_threshold: float = 7.0


@dataclass(frozen=True)
class Signals:
    title: Title = Title()
    column_header: ColumnHeader = ColumnHeader()
    row_count: RowCount = RowCount()
    vector_density: VectorDensity = VectorDensity()
    continuity: Continuity = Continuity()


@dataclass(frozen=True)
class Scoring:
    strong_match: float = 12.0
    weak_match: float = 7.0


@dataclass(frozen=True)
class Clustering:
    min_fingerprint_similarity: float = 0.6
    min_total_rows_per_run: int = 3
    max_gap: int = 0


@dataclass(frozen=True)
class ClassifierConfig:
    signals: Signals = Signals()
    scoring: Scoring = Scoring()
    clustering: Clustering = Clustering()


@dataclass(frozen=True)
class ColumnMapping:
    fuzzy_max_distance: int = 2
    synonyms: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in EXTRACTOR_SYNONYMS.items()})


@dataclass(frozen=True)
class TableSelection:
    min_columns: int = 4
    max_columns: int = 11
    require_quantity_header: bool = True
    min_data_rows: int = 1


@dataclass(frozen=True)
class SectionHeaders:
    enabled: bool = True
    max_filled_cells: int = 2


@dataclass(frozen=True)
class RowParsing:
    drop_empty_rows: bool = True
    section_header_detection: SectionHeaders = SectionHeaders()


@dataclass(frozen=True)
class PostProcessing:
    normalize_newlines: bool = False
    trim_whitespace: bool = True
    extract_schematic_position_regex: str | None = r"(/\d+\.\d+|&EFS\d+/[\d.:AB]+)"


@dataclass(frozen=True)
class Validation:
    cross_parser_row_count_tolerance: int = 1
    required_fields: list[str] = field(default_factory=lambda: ["description"])
    flag_unicode_replacement: bool = True


@dataclass(frozen=True)
class Zone:
    """A page rectangle in fractions of width and height, from the top left."""

    x_min: float
    y_min: float
    x_max: float
    y_max: float


@dataclass(frozen=True)
class SectionDetection:
    enabled: bool = True
    max_token_length: int = 15
    zones: list[Zone] = field(default_factory=lambda: [Zone(0.0, 0.70, 1.0, 1.0), Zone(0.50, 0.0, 1.0, 0.15)])


@dataclass(frozen=True)
class Output:
    default_format: str = "xlsx"
    csv_separator: str = ","
    xlsx_sheet_per_pdf: bool = True
    include_raw_column: bool = True
    include_warnings_column: bool = True


@dataclass(frozen=True)
class ExtractorConfig:
    column_mapping: ColumnMapping = ColumnMapping()
    table_selection: TableSelection = TableSelection()
    row_parsing: RowParsing = RowParsing()
    post_processing: PostProcessing = PostProcessing()
    validation: Validation = Validation()
    section_detection: SectionDetection = SectionDetection()
    output: Output = Output()


def override(base: Any, given: Mapping[str, Any] | None) -> Any:
    """A settings object with the given (nested) values in place; unknown names are an error."""
    if not given:
        return base
    names = {f.name for f in fields(base)}
    if unknown := set(given) - names:
        raise ValueError(f"unknown settings {sorted(unknown)} for {type(base).__name__}")
    new = {}
    for name, value in given.items():
        old = getattr(base, name)
        if is_dataclass(old):
            value = override(old, value)
        elif name == "zones":
            value = [Zone(**z) for z in value]
        new[name] = value
    return replace(base, **new)


def load_yaml(path: str, base: Any) -> Any:
    """Settings from a YAML file over a base. Needs the yaml library."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return override(base, yaml.safe_load(f))


def flatten(synonyms: Mapping[str, list[str] | None], normalize) -> list[tuple[str, str, str]]:
    """(category, normalised, original) in order, without empty entries."""
    every = ((category, word) for category, words in synonyms.items() for word in words or [] if word is not None)
    return [(category, norm, str(word)) for category, word in every if (norm := normalize(str(word)))]

"""Page ranges given by hand: "33-35,47"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(spec: str) -> list[list[int]]:
    """Runs of pages; blank parts vanish, a reversed range has no pages, anything but numbers is an error."""
    out = []
    for part in filter(None, map(str.strip, spec.split(","))):
        low, dash, high = part.partition("-")
        out.append(list(range(int(low), int(high) + 1)) if dash else [int(low)])
    return out


def page_runs(specs: DataFrame) -> DataFrame:
    """(doc, spec) -> (doc, run_idx, pos, page), for many documents at once; runs without pages vanish."""
    parts = F.filter(F.transform(F.split("spec", ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = specs.select("doc", F.posexplode(parts).alias("run_idx", "part")).select("doc", "run_idx", F.split("part", "-", 2).alias("e"))
    low = F.trim(F.get("e", 0)).cast("int")
    ends = ends.select("doc", "run_idx", low.alias("low"), F.coalesce(F.trim(F.get("e", 1)).cast("int"), low).alias("high")).where("low <= high")
    return ends.select("doc", "run_idx", F.posexplode(F.sequence("low", "high")).alias("pos", "page"))

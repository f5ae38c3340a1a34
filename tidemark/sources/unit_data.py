"""Static data units as data: files of JSON rows, and a manifest that says what they are for.

A unit is a file, or a folder of part files as Spark writes it, whose name ends in the
unit suffix; each line is one JSON object. The manifest beside the units lists them in
order with their target, key and columns.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import named_below, read_text, write_text
from tidemark.sources.units import UNIT_SUFFIX

MANIFEST = "units.manifest"


class UnitFile(NamedTuple):
    """What a unit of this name brings up to date."""

    file_name: str
    table_name: str
    key: tuple[str, ...]
    columns: tuple[str, ...]
    insert_only: tuple[str, ...] = ()


def _checked(units: list[UnitFile]) -> list[UnitFile]:
    names = [u.file_name for u in units]
    for unit in units:
        if not unit.file_name.lower().endswith(UNIT_SUFFIX):
            raise ValueError(f"{unit.file_name} is not the name of a unit")
        if names.count(unit.file_name) > 1:
            raise ValueError(f"{unit.file_name} is listed twice")
        if not unit.key:
            raise ValueError(f"{unit.file_name} has no key")
        if len(set(unit.columns)) < len(unit.columns):
            raise ValueError(f"{unit.file_name} lists a column twice")
        unknown = sorted({*unit.key, *unit.insert_only} - set(unit.columns))
        if unknown:
            raise ValueError(f"{unit.file_name} does not list {', '.join(unknown)} among its columns")
    return units


def write_manifest(spark: SparkSession, path: str, units: list[UnitFile]) -> None:
    """The manifest of the units below `path`, one JSON object a line, in unit order."""
    text = "".join(json.dumps(u._asdict()) + "\n" for u in _checked(units))
    write_text(spark, f"{path}/{MANIFEST}", text)


def read_manifest(spark: SparkSession, path: str) -> list[UnitFile]:
    """The units below `path` in order; raises on entries that cannot be applied."""
    units = []
    for line in read_text(spark, f"{path}/{MANIFEST}").splitlines():
        if line.strip():
            entry = json.loads(line)
            units.append(
                UnitFile(
                    entry["file_name"], entry["table_name"], tuple(entry["key"]), tuple(entry["columns"]),
                    tuple(entry.get("insert_only", ())),
                )
            )
    return _checked(units)


def _unit_name(path):
    """Name of the unit a file belongs to: its own name or its folder's; else empty."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    suffix = UNIT_SUFFIX.replace(".", r"\.")
    return F.regexp_extract(plain, rf"(?i)^.*/([^/]+{suffix})(?:/[^/]*)?$", 1)


def require_listed(spark: SparkSession, path: str, units: list[UnitFile]) -> None:
    """Raises when the unit names below `path` and those of the manifest differ.

    A unit without rows is a valid one (it empties its target), so a missing unit must
    not pass for it.
    """
    found = named_below(spark, path, lambda name: name.lower().endswith(UNIT_SUFFIX))
    names = set(found)
    if len(names) < len(found):
        raise ValueError("two units bear one name")
    listed = {u.file_name for u in units}
    if names - listed:
        raise ValueError(f"not in the manifest: {', '.join(sorted(names - listed))}")
    if listed - names:
        raise ValueError(f"no such unit: {', '.join(sorted(listed - names))}")


def read_unit_rows(spark: SparkSession, path: str) -> tuple[list[UnitFile], DataFrame]:
    """The manifest's units, and (file_name, line) of every line that is not blank."""
    units = read_manifest(spark, path)
    require_listed(spark, path, units)
    lines = (
        spark.read.option("recursiveFileLookup", "true").text(path)
        .select(_unit_name(F.col("_metadata.file_path")).alias("file_name"), F.col("value").alias("line"))
        .filter((F.col("file_name") != "") & (F.trim("line") != ""))
    )
    return units, lines

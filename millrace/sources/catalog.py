"""The catalog of sources as a DataFrame: a short list that is written by hand, read on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalog import violations

SOURCE = "name string, location string, format string, pipeline string, decision string, decision_reason string, contains_pii boolean, completeness int, consistency int, actuality int, reliability int, refresh string, lag_days int, records long, declared_mb double"
_KEYS = [c.split()[0] for c in SOURCE.split(", ")]


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a catalog file, JSON or (where a YAML reader is installed) YAML.

    Unknown keys, repeated names and rows that break a rule are refused, with all their names.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    return catalog_of(spark, found["sources"])


def catalog_of(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """A catalog from its entries, checked like a file."""
    names = [s.get("name") for s in sources]
    faults = [f"{s.get('name')}: unknown key {k}" for s in sources for k in s if k not in _KEYS] + [f"{n}: more than once" for n in sorted({n for n in names if names.count(n) > 1}, key=str)]
    rows = spark.createDataFrame([tuple(s.get(k) for k in _KEYS) for s in sources], SOURCE)
    faults += [f"{r['name']}: {', '.join(r['broken'])}" for r in violations(rows).collect()]
    if faults:
        raise ValueError("; ".join(faults))
    return rows


def source_named(catalog: DataFrame, name: str) -> DataFrame:
    """The one source of that name."""
    found = catalog.where(catalog["name"] == name)
    if found.count() != 1:
        raise KeyError(name)
    return found


def unknown_names(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the names that are asked for (column ``name``) those that the catalog doesn't have."""
    return asked.join(catalog.select("name"), "name", "left_anti")


def narrowed(catalog: DataFrame, names: list[str] | None) -> DataFrame:
    """The sources to run: those asked for, if any are; a decision to leave one out stands all the same."""
    return catalog if names is None else catalog.where(catalog["name"].isin(names))

"""Dictionaries from YAML files, as DataFrames of fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, category string, aliases array<string>, match_patterns array<string>"


def load_skills(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file {skills: [{name, category, aliases, patterns}]}; missing lists are empty. Files are small and read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        rows = (yaml.safe_load(f) or {}).get("skills") or []
    return skills(spark, [(r.get("name"), r.get("category"), r.get("aliases") or [], r.get("patterns") or []) for r in rows])


def load_vocabulary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The lists of a vocabulary file by name: (value, weight) frames of entries that are texts, or maps of a value (the first text of the entry) and a weight; 1 where there is none. Other fields of an entry go into `fields`, a map of texts."""
    import yaml

    with open(path, encoding="utf-8") as f:
        lists = {k: v for k, v in (yaml.safe_load(f) or {}).items() if isinstance(v, list)}
    out = {}
    for name, entries in lists.items():
        rows = []
        for e in entries:
            e = e if isinstance(e, dict) else {"value": e}
            value = next((str(v) for v in e.values() if isinstance(v, str)), None)
            rows.append((value, float(e.get("weight", 1)), {str(k): str(v) for k, v in e.items() if k != "weight"}))
        out[name] = spark.createDataFrame(rows, "value string, weight double, fields map<string, string>")
    return out


def skills(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)

"""Typed settings: defaults, overridden by the environment, then by a table of overrides."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    source_dirs: str = ""
    inbox_dir: str = ""
    library_dir: str = ""
    covers_dir: str = ""
    archive_dir: str = ""
    processed_dir: str = ""
    formats: str = "epub,pdf,mobi,azw3,djvu,cbr,cbz,fb2"
    title_threshold: float = 0.85
    ambiguous_from: float = 0.70
    enrich: bool = False
    enrich_seconds: float = field(default=1.0)
    log_days: int = 90
    backups_kept: int = 14
    page_size: int = 50
    watch_seconds: int = 5


def parse(kind: str, text: str) -> object:
    """A value of the field's type from text; ValueError if it isn't one."""
    if kind == "bool":
        if text.lower() not in ("1", "0", "true", "false", "yes", "no"):
            raise ValueError(f"not a truth value: {text}")
        return text.lower() in ("1", "true", "yes")
    return {"int": int, "float": float, "str": str}[kind](text)


PREFIX = "TOMEWRIGHT_"


def load(overrides: dict[str, str] | None = None, env: dict[str, str] | None = None, machine: dict[str, str] | None = None) -> Settings:
    """Settings from defaults, a file of the machine, ``TOMEWRIGHT_<NAME>`` variables and overrides, the last the strongest."""
    env = os.environ if env is None else env
    chosen = {}
    for f in fields(Settings):
        for text in ((machine or {}).get(f.name), env.get(PREFIX + f.name.upper()), (overrides or {}).get(f.name)):
            if text is not None:
                chosen[f.name] = parse(f.type, str(text))
    return Settings(**chosen)


def resolved(spark: SparkSession, overrides: DataFrame, env: dict[str, str] | None = None, machine: dict[str, str] | None = None) -> DataFrame:
    """``name, value, origin`` of every setting; origins are override, environment, machine and default."""
    env = os.environ if env is None else env
    rows = [(f.name, str(f.default), (machine or {}).get(f.name), env.get(PREFIX + f.name.upper())) for f in fields(Settings)]
    known = spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in rows], "name string, preset string, machine string, environment string")
    met = known.join(overrides.select("name", F.col("value").alias("override")), "name", "left")
    origin = F.when(F.col("override").isNotNull(), "override").when(F.col("environment").isNotNull(), "environment").when(F.col("machine").isNotNull(), "machine").otherwise("default")
    return met.select("name", F.coalesce("override", "environment", "machine", "preset").alias("value"), origin.alias("origin"))


def exported(settings: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row ``json``: the overrides and the resolved settings, each by name."""
    entries = lambda df, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(name))
    both = entries(overrides, "overrides").crossJoin(entries(settings, "settings"))  # a row each
    return both.select(F.to_json(F.struct("overrides", "settings")).alias("json"))


def imported(overrides: DataFrame, documents: DataFrame) -> DataFrame:
    """Overrides after those of an export (a column ``json``) are put in; names that are no setting are left out."""
    given = F.from_json("json", "overrides map<string, string>")["overrides"]
    new = documents.select(F.explode(given).alias("name", "value")).where(F.col("name").isin([f.name for f in fields(Settings)]))
    kept = overrides.select("name", "value").join(new, "name", "left_anti")
    return kept.unionByName(new)
